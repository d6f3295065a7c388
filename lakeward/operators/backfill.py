"""Backfill and restatement over versioned history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scd2 import apply, build, overlapping


def affected(dim: DataFrame, key: str, low: Column, high: Column) -> DataFrame:
    return overlapping(dim, low, high).agg(F.count("*").alias("versions"), F.count_distinct(key).alias("clients"))


def totals(facts: DataFrame, low: int, high: int) -> DataFrame:
    """Control totals of a range of date keys, taken before and after."""
    return facts.where(F.col("date_key").between(low, high)).agg(F.count("*").alias("n_rows"), F.sum("amount_usd").cast("decimal(18,2)").alias("amount"), F.count_distinct("client_id").alias("clients"))


def rewind(log: DataFrame, low: Column, high: Column) -> tuple[DataFrame, DataFrame]:
    """(log without the window, the lsns taken out)."""
    inside = (F.col("commit_ts") >= low) & (F.col("commit_ts") < high)
    return log.where(~inside), log.where(inside).select("lsn")


def unwind(dim: DataFrame, history: DataFrame, log: DataFrame, lsns: DataFrame, key: str, tracked: list[str], carried: list[str]) -> tuple[DataFrame, DataFrame]:
    """(dimension, log) as if the events of those lsns had never come.

    Keys that they touch are rebuilt from their other events: later versions lose what they carried
    from an unwound one, and what was a no-op because of one becomes a version.
    """
    out = history.join(lsns, "lsn", "left_semi").select(key).distinct()
    events = history.join(out, key, "left_semi").join(lsns, "lsn", "left_anti")
    rebuilt, again = build(events, key, tracked, carried)
    return dim.join(out, key, "left_anti").unionByName(rebuilt), log.join(out, key, "left_anti").unionByName(again)


def restate(dim: DataFrame, history: DataFrame, log: DataFrame, corrected: DataFrame, low: Column, high: Column, key: str, tracked: list[str], carried: list[str]) -> tuple[DataFrame, DataFrame]:
    """A window of the log replayed with corrected events: rewind, unwind, replay, in one flow."""
    _, lsns = rewind(log, low, high)
    lsns = lsns.unionByName(corrected.select("lsn")).distinct()
    left, rest = unwind(dim, history, log, lsns, key, tracked, carried)
    kept = history.join(lsns, "lsn", "left_anti")
    return apply(left, kept, corrected, rest, key, tracked, carried)


def delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: the change of each control total."""
    a = after.select(*(F.col(c).alias(f"after_{c}") for c in after.columns))
    return before.crossJoin(F.broadcast(a)).select(*((F.col(f"after_{c}") - F.col(c)).alias(f"delta_{c}") for c in before.columns))
