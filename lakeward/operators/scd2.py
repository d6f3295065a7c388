"""Type 2 history from change events, as window chains instead of a row loop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import OPEN_END, OPEN_START, row_hash, surrogate_key
from .control import sequence_gaps


def fresh(events: DataFrame, log: DataFrame | None) -> DataFrame:
    """Events whose lsn was never applied: a lookup per lsn, so late lower ones are not lost."""
    return events if log is None else events.join(log.select("lsn"), "lsn", "left_anti")


def seed(snapshot: DataFrame, key: str, tracked: list[str], carried: list[str]) -> DataFrame:
    """A snapshot's rows as events that open the history."""
    return snapshot.select(F.lit(0).cast("long").alias("lsn"), key, F.to_timestamp(F.lit(OPEN_START)).cast("timestamp_ntz").alias("commit_ts"), F.lit("seed").alias("op"), *tracked, *carried)


def actions(events: DataFrame, key: str, tracked: list[str]) -> DataFrame:
    """Events with the tracked attributes carried forward and ``action_taken`` for each lsn."""
    w = Window.partitionBy(key).orderBy("lsn")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    known = F.coalesce(F.max((F.col("op") != "delete").cast("int")).over(before), F.lit(0)) == 1
    ignored = (F.col("op") == "delete") & ~known
    chain = events.withColumn("_ignored", ignored)
    live = Window.partitionBy(key, "_ignored").orderBy("lsn")
    upto = live.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    chain = chain.select(*(F.last(c, ignorenulls=True).over(upto).alias(c) if c in tracked else F.col(c) for c in chain.columns))
    chain = chain.withColumn("record_hash", row_hash(*tracked))
    same = F.lag("record_hash").over(live).eqNullSafe(F.col("record_hash")) & (F.lag("op").over(live) != "delete") & (F.col("op") != "delete")
    taken = F.when(F.col("_ignored"), "delete_for_unknown_key_ignored").when(F.coalesce(same, F.lit(False)), "no_change_noop").when(F.col("op") == "delete", "soft_delete_tombstone").otherwise("new_version")
    return chain.withColumn("action_taken", taken).drop("_ignored")


def build(events: DataFrame, key: str, tracked: list[str], carried: list[str]) -> tuple[DataFrame, DataFrame]:
    """(dimension, apply log) from all events of the keys, in any order of arrival.

    Tracked attributes make versions; carried ones ride along, and what a no-op carries is dropped.
    Events are applied in order of lsn; of a key's versions with one commit_ts only the last stays,
    with what the others brought, as the others were never valid for any time.
    A key's rows are one window group: a hot key is one sorted, spillable group.
    """
    done = actions(events, key, tracked)
    w = Window.partitionBy(key).orderBy("lsn")
    version = F.col("action_taken").isin("new_version", "soft_delete_tombstone")
    upto = Window.partitionBy(key, "_version").orderBy("lsn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    done = done.withColumn("_version", version)
    done = done.select(*(F.last(c, ignorenulls=True).over(upto).alias(c) if c in carried else F.col(c) for c in done.columns))
    superseded = F.col("_version") & (F.lead("commit_ts").over(Window.partitionBy(key, "_version").orderBy("commit_ts", "lsn")) == F.col("commit_ts"))
    done = done.withColumn("action_taken", F.when(superseded, "superseded_same_ts").otherwise(F.col("action_taken")))
    kept = done.where(version).drop("_version")
    following = F.lead("commit_ts").over(w)
    dim = kept.select(
        surrogate_key(key, "commit_ts").alias("sk"),
        key,
        *tracked,
        *carried,
        F.col("commit_ts").alias("valid_from"),
        F.coalesce(following, F.to_timestamp(F.lit(OPEN_END)).cast("timestamp_ntz")).alias("valid_to"),
        following.isNull().alias("is_current"),
        (F.col("op") == "delete").alias("is_deleted"),
        F.col("lsn").alias("source_lsn"),
        F.col("op").alias("source_op"),
        "record_hash",
    )
    return dim, done.select("lsn", key, "op", "commit_ts", "action_taken")


def apply(dim: DataFrame, history: DataFrame, batch: DataFrame, log: DataFrame, key: str, tracked: list[str], carried: list[str]) -> tuple[DataFrame, DataFrame]:
    """(dimension, log) after a batch. Keys that the batch touches are rebuilt from all of their
    events, so a late lower lsn or a backfill lands where it belongs; the other keys stay."""
    new = fresh(batch, log)
    touched = new.select(key).distinct()
    events = history.join(touched, key, "left_semi").unionByName(new)
    rebuilt, again = build(events, key, tracked, carried)
    return dim.join(touched, key, "left_anti").unionByName(rebuilt), log.join(touched, key, "left_anti").unionByName(again)


def current(dim: DataFrame) -> DataFrame:
    return dim.where("is_current AND NOT is_deleted")


def as_of(facts: DataFrame, dim: DataFrame, key: str, at: str, keep: list[str]) -> DataFrame:
    """Each fact with the version valid at its time.

    Facts and versions of a key run through one sorted window, each fact taking the last version
    before it, so a hot key costs its facts plus its versions and not their product. Versions of a
    key must not overlap. A null key or time finds none.
    """
    version = F.struct("valid_from", "valid_to", *keep)
    given = facts.select(F.col(key).alias("_k"), F.col(at).alias("_at"), F.lit(1).alias("_kind"), F.struct(*facts.columns).alias("_fact"))
    found = dim.select(F.col(key).alias("_k"), F.col("valid_from").alias("_at"), F.lit(0).alias("_kind"), version.alias("_version"))
    both = given.unionByName(found, allowMissingColumns=True)
    upto = Window.partitionBy("_k").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = both.withColumn("_version", F.last("_version", ignorenulls=True).over(upto)).where("_kind = 1")
    valid = F.col("_k").isNotNull() & (F.col("_at") < F.col("_version.valid_to"))
    return last.select("_fact.*", *(F.when(valid, F.col("_version").getField(c)).alias(c) for c in keep))


def overlapping(dim: DataFrame, low: Column, high: Column) -> DataFrame:
    """Versions that touch [low, high); those that closed exactly at low count too."""
    return dim.where((F.col("valid_from") < high) & (F.col("valid_to") >= low))


def lsn_gaps(events: DataFrame) -> DataFrame:
    """Ranges of missing numbers, as the lsns (after, before) that stand around each."""
    return sequence_gaps(events, F.col("lsn"))


def invariants(dim: DataFrame, key: str) -> DataFrame:
    """One row per invariant with the number of violations."""
    w = Window.partitionBy(key).orderBy("valid_from", "source_lsn")
    several = dim.where("is_current").groupBy(key).agg(F.count("*").alias("n")).where("n > 1").agg(F.count("*").alias("violations")).select(F.lit("one_current").alias("invariant"), "violations")
    broken = dim.withColumn("_next", F.lead("valid_from").over(w)).where("_next is not null and _next <> valid_to").agg(F.count("*").alias("violations")).select(F.lit("contiguous").alias("invariant"), "violations")
    inverted = dim.where("NOT valid_from < valid_to").agg(F.count("*").alias("violations")).select(F.lit("positive_interval").alias("invariant"), "violations")
    return several.unionByName(broken).unionByName(inverted)


def orphans(facts: DataFrame, dim: DataFrame, key: str) -> DataFrame:
    return facts.join(dim.select(key).distinct(), key, "left_anti")
