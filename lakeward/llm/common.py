"""Helpers that the training-data operators share."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BATCH_BYTES = 4 << 20
BATCH_ROWS = 4096
MAX_ROUNDS = 60
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
HOT_GROUPS = 100_000
HOT_LEAST = 1000


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches end at a number of bytes, so very long texts can't pile up in one batch."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    bounded_batches(df.sparkSession)
    return df.mapInArrow(fn, schema)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that spark.checkpoint.dir names. Only a local session, as in tests, may have none and gets one of its own."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = sc.getConf().get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "lakeward-checkpoints"))
    return sc._jsc.sc().getCheckpointDir().get()


def materialise(df: DataFrame) -> DataFrame:
    """Cuts the lineage: the rows are written as Parquet to the shared checkpoint folder and read again.

    The shuffle files of the plan that is written go as soon as the table stands.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    table = spark.read.schema(df.schema).parquet(path)
    table._written = path
    if _SCRATCH:
        _SCRATCH[-1].append(table)
    return table


_SCRATCH: list[list[DataFrame]] = []


@contextmanager
def scratch() -> Iterator[list[DataFrame]]:
    """The list of all tables that ``materialise`` makes inside, to ``discard`` when their result is written."""
    _SCRATCH.append([])
    try:
        yield _SCRATCH[-1]
    finally:
        _SCRATCH.pop()


def discard(*tables: DataFrame) -> None:
    """Deletes tables of ``materialise`` that no plan still to be run reads."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table._written)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def join_hot(rows: DataFrame, groups: DataFrame, keys: list[str], size: str) -> DataFrame:
    """Inner join of ``rows`` with one row per key of ``groups``, whose column ``size`` says how many rows hold the key.

    A key that holds more than one in HOT_GROUPS rows, and HOT_LEAST at least, would meet in one
    task. There are at most HOT_GROUPS such keys, so they are broadcast and their rows stay where
    they are; all other rows are dealt by key. Both inputs are read twice, so give written tables.
    """
    total = groups.agg(F.sum(size)).first()[0] or 0
    hot = groups.where(F.col(size) > max(HOT_LEAST, total // HOT_GROUPS))
    if hot.isEmpty():
        return rows.join(groups, keys)
    common = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(groups, keys)
    return common.unionByName(rows.join(F.broadcast(hot), keys))


def whole_row(df: DataFrame) -> Column:
    """All columns in one, so that no name of the caller's can clash with one of ours; a name may hold dots."""
    return F.struct(*(F.col("`" + c.replace("`", "``") + "`") for c in df.columns))


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def shingle_hashes(text: str, size: int = 3, seed: int = 42) -> list[int]:
    """XXH64 of each run of ``size`` words, A-Z in lower case, joined by blanks; fewer words make one run."""
    words = text.encode().lower().split()
    if not words:
        return []
    digest = xxhash.xxh64_intdigest
    if len(words) < size:
        return [digest(b" ".join(words), seed)]
    return [digest(b" ".join(run), seed) for run in zip(*(words[i:] for i in range(size)), strict=False)]


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of undirected links between longs, as (node, root) with root the smallest node.

    Alternates large-star and small-star rounds (Kiveris et al., Connected Components in MapReduce
    and Beyond) until nothing changes. Each round is a partial minimum per node and a join that
    adaptive execution can split at a hot node; nothing is gathered on the driver but two counts.
    """
    edges = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    edges = materialise(edges)
    seen = None
    for _ in range(MAX_ROUNDS):
        both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(low.select("u", F.col("m").alias("v")))
        edges = materialise(small.where("u <> v").distinct())
        now = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if seen == (now.n, now.x):
            break
        seen = (now.n, now.x)
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
