"""Load control: watermarks, manifests, lateness, gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .contract import Blocked


def read_at_watermark(df: DataFrame, master: DataFrame, table: str, stamp: str) -> DataFrame:
    """Rows of the last successful load; without one the read is blocked. The filter reaches the scan."""
    row = master.where(F.col("table_name") == table).first()
    if row is None or row.last_load_status != "SUCCESS":
        raise Blocked(f"no successful load of {table}")
    return df.where(F.col(stamp) == F.lit(row.latest_loaded_ts))


def register_files(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """The manifest after a delivery found(source_file, file_hash).

    A delivered file is INGESTED (new), SKIPPED_DUPLICATE (equal content) or RE_INGESTED_CORRECTION
    (other content); files that were not delivered keep their row, with status NOT_DELIVERED.
    """
    old = manifest.select("source_file", F.col("file_hash").alias("_hash"), F.col("ingest_count").alias("_count"))
    joined = found.select("source_file", "file_hash").join(old, "source_file", "full_outer")
    status = F.when(F.col("file_hash").isNull(), "NOT_DELIVERED").when(F.col("_hash").isNull(), "INGESTED").when(F.col("_hash") == F.col("file_hash"), "SKIPPED_DUPLICATE").otherwise("RE_INGESTED_CORRECTION")
    count = F.coalesce("_count", F.lit(0)) + F.when(F.col("file_hash").isNull(), 0).otherwise(1)
    return joined.select("source_file", F.coalesce("file_hash", "_hash").alias("file_hash"), count.cast("int").alias("ingest_count"), status.alias("status"))


def reingest(target: DataFrame, delivered: DataFrame, manifest: DataFrame) -> DataFrame:
    """Rows after a delivery: a corrected file's rows replace its old ones, a duplicate's are left out."""
    by = manifest.select("source_file", "status")
    gone = by.where("status = 'RE_INGESTED_CORRECTION'").select("source_file")
    new = by.where(F.col("status").isin("INGESTED", "RE_INGESTED_CORRECTION")).select("source_file")
    return target.join(gone, "source_file", "left_anti").unionByName(delivered.join(new, "source_file", "left_semi"))


def attempts(tries: DataFrame) -> DataFrame:
    """History rows of load attempts (table_name, load_ts, n_files, n_rows, error): SUCCESS, FAILED or NO_FILES."""
    status = F.when(F.col("error").isNotNull(), "FAILED").when(F.col("n_files") == 0, "NO_FILES").otherwise("SUCCESS")
    rows = F.when(status == "SUCCESS", F.col("n_rows")).otherwise(F.lit(0)).cast("long")
    return tries.select("table_name", "load_ts", status.alias("load_status"), "n_files", rows.alias("records_loaded"), F.col("error").alias("error_message"))


def update_master(master: DataFrame, history: DataFrame) -> DataFrame:
    """One row per table after the attempts: the status of the last real one and the last successful load's time.

    An empty landing folder (NO_FILES) touches nothing; a failure leaves the watermark where it was.
    """
    real = history.where("load_status <> 'NO_FILES'")
    new = real.groupBy("table_name").agg(
        F.max_by("load_status", "load_ts").alias("_status"), F.max(F.when(F.col("load_status") == "SUCCESS", F.col("load_ts"))).alias("_ts"), F.sum("records_loaded").alias("_n")
    )
    joined = master.join(new, "table_name", "full_outer")
    return joined.select("table_name", F.coalesce("_status", "last_load_status").alias("last_load_status"), F.coalesce("_ts", "latest_loaded_ts").alias("latest_loaded_ts"), (F.coalesce("total_records", F.lit(0)) + F.coalesce("_n", F.lit(0))).cast("long").alias("total_records"))


def file_lag(rows: DataFrame, label: str, day: str) -> DataFrame:
    """Per file label the days between the label and its last event; late beyond one day."""
    lag = F.datediff(F.col("file_label_date"), F.col("max_event_date"))
    by = rows.groupBy(F.col(label).alias("file_label_date")).agg(F.count("*").alias("row_count"), F.min(day).alias("min_event_date"), F.max(day).alias("max_event_date"))
    return by.withColumn("lag_days", lag).withColumn("is_late", lag > 1)


def label_date(path: str | Column) -> Column:
    """The date in a file's name: its first eight digits in a row."""
    return F.try_to_date(F.regexp_extract(F.col(path) if isinstance(path, str) else path, r"(\d{8})", 1), "yyyyMMdd")


def missing_days(days: DataFrame, day: str) -> DataFrame:
    """Days between the first and the last for which nothing came."""
    spine = days.agg(F.min(day).alias("a"), F.max(day).alias("b")).where("a is not null").select(F.explode(F.sequence("a", "b")).alias(day))
    return spine.join(days.select(day).distinct(), day, "left_anti")


def sequence_gaps(df: DataFrame, number: Column) -> DataFrame:
    """Breaks in the numbers at the end of ids, as (after, before).

    Numbers meet per range of 2**16; what is left of a range is its first and last number, and
    those meet per range of ranges, so even far-apart numbers never gather in one task: the last
    level has 2**16 ranges at most.
    """
    level = df.select(number.cast("long").alias("_lo")).where("_lo is not null").distinct().withColumn("_hi", F.col("_lo"))
    found = []
    for bits in (16, 32, 48, 64):
        group = F.shiftright("_lo", min(bits, 63))
        level = level.withColumn("_r", group)
        found.append(level.select(F.col("_hi").alias("after"), F.lead("_lo").over(Window.partitionBy("_r").orderBy("_lo")).alias("before")).where("before > after + 1"))
        level = level.groupBy("_r").agg(F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi")).drop("_r")
    signs = level.agg(F.max(F.when(F.col("_lo") < 0, F.col("_hi"))).alias("after"), F.min(F.when(F.col("_lo") >= 0, F.col("_lo"))).alias("before")).where("before > after + 1")
    for part in found[1:]:
        found[0] = found[0].unionByName(part)
    return found[0].unionByName(signs)
