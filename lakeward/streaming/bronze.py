"""Micro-batch ingestion, audited and idempotent, and event-time features."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.contract import Contract
from ..sources import ingest

AUDIT = "batch_id long, query_name string, target_table string, records_processed long, status string, error_message string"


def trigger(mode: str) -> dict:
    """availableNow drains and stops; continuous is a batch each minute."""
    if mode == "availableNow":
        return {"availableNow": True}
    if mode == "continuous":
        return {"processingTime": "1 minute"}
    raise ValueError(f"unknown trigger mode {mode!r}")


def read_files(spark: SparkSession, path: str, schema: StructType | str, kind: str = "json", **options) -> DataFrame:
    """A file stream with lineage columns; JSON lines also get ``_rescued``, what the schema does not declare, null of nothing."""
    lineage = [F.col("_metadata.file_path").alias("_source_file"), F.col("_metadata.file_modification_time").alias("_source_file_modification_time")]
    if kind != "json":
        return spark.readStream.schema(schema).options(**options).format(kind).load(path).select("*", *lineage)
    known = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    rows = spark.readStream.options(**options).format("text").load(path).where("trim(value) <> ''")
    rows = rows.select(F.from_json("value", known).alias("_row"), rescued(F.col("value"), known.fieldNames()).alias("_rescued"), *lineage)
    return rows.select("_row.*", "_rescued", "_source_file", "_source_file_modification_time")


def read_csv_files(spark: SparkSession, path: str, most: int = 1000) -> DataFrame:
    """A stream of CSV files' paths, at most ``most`` a batch, for ``by_header``; their content is not read here."""
    rows = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("maxFilesPerTrigger", most).option("pathGlobFilter", "*.csv").load(path)
    return rows.select("path")


def by_header(contract: Contract) -> Callable[[DataFrame], DataFrame]:
    """The transform of a batch of CSV paths: each file's columns go by its own header, not by position."""

    def run(batch: DataFrame) -> DataFrame:
        return ingest.read_csv_by_header(batch.sparkSession, [r.path for r in batch.collect()], contract)

    return run


def rescued(raw: Column, known: list[str]) -> Column:
    """JSON of the keys that the schema does not declare, null of none."""
    rest = F.map_filter(F.from_json(raw, "map<string,string>"), lambda k, _: ~k.isin(*known))
    return F.when(F.size(rest) > 0, F.to_json(rest))


def start(rows: DataFrame, name: str, sink: str, audit: str, checkpoint: str, mode: str = "availableNow", stamp: Column | None = None, transform: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Writes each micro-batch to its own folder and an audit row beside it.

    A batch that runs again overwrites its own folder, so each file is captured once.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        out = transform(batch) if transform else batch
        if stamp is not None:
            out = out.withColumn("delta_created_ts", stamp)
        spark = batch.sparkSession
        path = f"{sink}/batch_id={batch_id}"
        status, error = "SUCCESS", None
        n = 0
        try:
            out.write.mode("overwrite").parquet(path)
            n = spark.read.schema(out.schema).parquet(path).count()
        except Exception as e:
            status, error = "FAILED", str(e)[:500]
            raise
        finally:
            spark.createDataFrame([(batch_id, name, sink, n, status, error)], AUDIT).coalesce(1).write.mode("overwrite").parquet(f"{audit}/{name}/{batch_id}")

    return rows.writeStream.queryName(name).option("checkpointLocation", checkpoint).trigger(**trigger(mode)).foreachBatch(write).start()


def await_all(queries: list[StreamingQuery]) -> None:
    """All are started before any is awaited; whichever fails first raises, while the others still run."""
    waiting = list(queries)
    while waiting:
        for q in list(waiting):
            if q.awaitTermination(0.2):
                waiting.remove(q)
                if q.exception():
                    raise q.exception()


def overdue(started: dict[str, dt.datetime], now: dt.datetime, most_s: int = 86_400) -> list[str]:
    """Names of continuous runs that last longer than ``most_s`` seconds and raise an alarm."""
    return sorted(name for name, at in started.items() if (now - at).total_seconds() > most_s)


def velocity(events: DataFrame, key: str, ts: str, value: str, width: str = "1 hour", late: str | None = None) -> DataFrame:
    """Count and sum per key and tumbling window: the same function for batch and stream (with ``late``)."""
    if late is not None:
        events = events.withWatermark(ts, late)
    return events.groupBy(F.window(ts, width).alias("w"), key).agg(F.count("*").alias("n_events"), F.sum(F.col(value)).alias("total")).select(key, F.col("w.start").alias("window_start"), "n_events", "total")


def score(features: DataFrame, most: int = 20, amount: float = 2000.0) -> DataFrame:
    """The shared scorer of both paths."""
    return features.withColumn("risk", F.least(F.lit(1.0), F.round(0.5 * F.col("n_events") / most + 0.5 * F.col("total").cast("double") / amount, 6)))


def divergence(batch: DataFrame, live: DataFrame, keys: list[str], tolerance: float = 0.01) -> DataFrame:
    """Rows whose scores differ beyond the tolerance or that only one path has."""
    joined = batch.select(*keys, F.col("risk").alias("batch_risk")).join(live.select(*keys, F.col("risk").alias("live_risk")), keys, "full_outer")
    return joined.where("batch_risk is null or live_risk is null or abs(batch_risk - live_risk) > " + str(tolerance))
