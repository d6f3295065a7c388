"""Deduplication by business key, upserts with action counts, range replacement."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .contract import Blocked


def dedupe(df: DataFrame, keys: list[str], order_by: list[Column]) -> DataFrame:
    """The first row of each key; ``order_by`` must be a total order. Spark plans a per-task group limit."""
    w = Window.partitionBy(*keys).orderBy(*order_by)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def one_per_key(source: DataFrame, keys: list[str]) -> None:
    """Raises if a key occurs twice or is null: such a row would be inserted beside its twin, or again on each run."""
    null = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    if source.groupBy(*keys).agg(F.count("*").alias("_n")).where((F.col("_n") > 1) | null).limit(1).collect():
        raise Blocked(f"several source rows for one key of {keys}, or a null key")


def merge(target: DataFrame, source: DataFrame, keys: list[str], compare: str) -> DataFrame:
    """All rows after the upsert, with ``_action``: insert, update, unchanged or kept (no source row).

    One full outer join; on equal ``compare`` every target column stays as it is. A source with a
    repeated or null key is blocked before anything is joined.
    """
    one_per_key(source, keys)
    t = target.select(*(F.col(c).alias(f"t_{c}") for c in target.columns), F.lit(True).alias("_t"))
    s = source.select(*(F.col(c).alias(f"s_{c}") for c in target.columns), F.lit(True).alias("_s"))
    on = reduce(lambda a, b: a & b, [F.col(f"t_{k}") == F.col(f"s_{k}") for k in keys])
    action = F.when(F.col("_t").isNull(), "insert").when(F.col("_s").isNull(), "kept").when(F.col(f"t_{compare}").eqNullSafe(F.col(f"s_{compare}")), "unchanged").otherwise("update")
    joined = t.join(s, on, "full_outer").withColumn("_action", action)
    new = F.col("_action").isin("insert", "update")
    return joined.select(*(F.when(new, F.col(f"s_{c}")).otherwise(F.col(f"t_{c}")).alias(c) for c in target.columns), "_action")


def actions(merged: DataFrame) -> DataFrame:
    return merged.groupBy(F.col("_action").alias("action")).agg(F.count("*").alias("n"))


def changed(merged: DataFrame) -> bool:
    """Whether a merge has anything to write; without a change the write can be left out."""
    return not merged.where(F.col("_action").isin("insert", "update")).isEmpty()


def replace_range(target: DataFrame, new: DataFrame, inside: Column) -> DataFrame:
    """What ``inside`` selects is replaced by ``new``, which may be empty."""
    return target.where(~F.coalesce(inside, F.lit(False))).unionByName(new)
