"""Data-quality gate: rules as expressions, evaluated in one pass over the rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .contract import Blocked

BLOCK, QUARANTINE, WARN = "BLOCK", "QUARANTINE", "WARN"


@dataclass(frozen=True)
class Rule:
    """``failed`` is a condition; null counts as not failed. ``detail`` is text for the evidence."""

    name: str
    severity: str
    failed: Column
    detail: Column
    action: str = ""


def evaluate(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """Adds ``_failures``, an array of (check_name, severity, on_failure, detail) of the rules that fail."""
    made = [
        F.when(
            F.coalesce(r.failed, F.lit(False)),
            F.struct(F.lit(r.name).alias("check_name"), F.lit(r.severity).alias("severity"), F.lit(r.action or r.severity.lower()).alias("on_failure"), F.coalesce(r.detail.cast("string"), F.lit("null")).alias("detail")),
        )
        for r in rules
    ]
    return df.withColumn("_failures", F.filter(F.array(*made), lambda x: x.isNotNull()))


def evidence(checked: DataFrame, key: str) -> DataFrame:
    """One row per failure."""
    return checked.select(F.col(key).cast("string").alias("record_key"), F.explode("_failures").alias("_f")).select("record_key", "_f.*")


def has(severity: str) -> Column:
    return F.exists("_failures", lambda x: x["severity"] == severity)


def stop_if_blocked(checked: DataFrame) -> None:
    """Raises before any write if a row fails a BLOCK rule; looks for one row only."""
    hit = checked.where(has(BLOCK)).limit(1).collect()
    if hit:
        raise Blocked(", ".join(f.check_name for f in hit[0]._failures if f.severity == BLOCK))


def split(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(clean, quarantined): exact complements; quarantined rows carry failed_checks and raw_payload."""
    names = [c for c in checked.columns if c != "_failures"]
    bad = has(QUARANTINE)
    reasons = F.concat_ws(" | ", F.transform(F.filter("_failures", lambda x: x["severity"] == QUARANTINE), lambda x: x["check_name"]))
    clean = checked.where(~bad).drop("_failures")
    held = checked.where(bad).select(*names, reasons.alias("failed_checks"), F.to_json(F.struct(*names)).alias("raw_payload"))
    return clean, held


def new_only(held: DataFrame, open_rows: DataFrame, key: str) -> DataFrame:
    """Quarantined rows that have no open row yet."""
    return held.join(open_rows.select(key).distinct(), key, "left_anti")


def release(open_rows: DataFrame, clean_now: DataFrame, key: str, as_of: Column) -> DataFrame:
    """Sets resolved_at where the row passes every QUARANTINE rule now; an earlier one stays."""
    now = clean_now.select(key).distinct().withColumn("_ok", F.lit(True))
    return open_rows.join(now, key, "left").withColumn("resolved_at", F.coalesce("resolved_at", F.when(F.col("_ok"), as_of))).drop("_ok")


def age(open_rows: DataFrame, since: str, as_of: Column, days: int = 7) -> DataFrame:
    old = F.datediff(as_of, F.col(since))
    return open_rows.withColumn("age_days", old).withColumn("ageing_action", F.when(old > days, "ESCALATE").otherwise("WAIT"))


def bound(df: DataFrame, day: str, as_of: Column, days: int = 90) -> tuple[DataFrame, DataFrame]:
    """(restatable, too old) by event date."""
    fresh = F.coalesce(F.col(day) >= F.date_sub(as_of, days), F.lit(False))
    return df.where(fresh), df.where(~fresh)


def summary(found: DataFrame) -> DataFrame:
    return found.groupBy("severity", "check_name").agg(F.count("*").alias("n"))
