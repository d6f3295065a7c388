"""Readers of landing files, lineage, load audit and archiving."""

from __future__ import annotations

import csv
import datetime as dt
from collections import defaultdict
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.contract import Contract, assert_known, normalise
from .files import Files

TRY = "table_name string, load_ts timestamp, n_files long, n_rows long, error string"


def read_json_array(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Files that hold one JSON array each."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_cdc(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """One JSON object per line, with nested before and after images; blank lines are no rows."""
    return spark.read.schema(schema).json(path)


def flatten_images(changes: DataFrame, columns: list[str]) -> DataFrame:
    """A change log's ``columns`` from the after image, or the before image of a delete."""
    return changes.select(*(c for c in changes.columns if c not in ("before", "after")), *(F.coalesce(F.col("after").getField(c), F.col("before").getField(c)).alias(c) for c in columns))


def read_csv_by_header(spark: SparkSession, source: str | list[str], contract: Contract, number_rows: bool = False) -> DataFrame:
    """CSV files whose headers differ, each group of equal headers read by its own names.

    Only the first line of each file reaches the driver; names may be quoted. Undeclared columns
    block before a row is read; ``_source_file`` and ``_raw`` (the row as JSON) are added, and with
    ``number_rows`` also ``_row_number``, counted in each file from 1. No files give no rows.
    """
    files = pending(spark, source, ".csv") if isinstance(source, str) else sorted(source)
    groups: dict[tuple[str, ...], list[str]] = defaultdict(list)
    for f in files:
        names = next(csv.reader([Files(spark, f).first_line(f).lstrip("﻿")]), [])
        groups[tuple(n.strip() for n in names)].append(f)
    if not groups:
        empty = ", ".join([*(f"`{c}` string" for c in contract.columns), "_source_file string", "_raw string", *(["_row_number int"] if number_rows else [])])
        return normalise(spark.createDataFrame([], empty), contract)
    parts = []
    for names, own in groups.items():
        assert_known(list(names), contract)
        schema = ", ".join(f"`{n}` string" for n in names)
        rows = spark.read.schema(schema).option("header", True).option("escape", '"').csv(own)
        extra = [F.col("_metadata.file_name").alias("_source_file"), F.to_json(F.struct(*(F.col(f"`{n}`") for n in names))).alias("_raw")]
        if number_rows:
            extra += [F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_place")]
        rows = rows.select(*(F.col(f"`{n}`") for n in names), *extra)
        if number_rows:
            by = Window.partitionBy("_source_file").orderBy("_block", "_place")
            rows = rows.withColumn("_row_number", F.row_number().over(by)).drop("_block", "_place")
        parts.append(normalise(rows, contract))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def with_lineage(df: DataFrame, load_ts: Column) -> DataFrame:
    """Source file, its modification time, load time and load day, of a frame that reads files."""
    return df.select("*", F.col("_metadata.file_path").alias("_source_file"), F.col("_metadata.file_modification_time").alias("_source_file_modification_time"), load_ts.alias("delta_created_ts"), F.to_date(load_ts).alias("delta_created_dt"))


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(source_file, file_hash): the first 16 digits of the SHA-256 of each file's bytes."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("source_file"), F.substring(F.sha2("content", 256), 1, 16).alias("file_hash"))


def pending(spark: SparkSession, folder: str, suffix: str = "", label: str = "") -> list[str]:
    """Landing files still to load; ``label`` replays only those whose name contains it."""
    name = lambda f: f.rsplit("/", 1)[-1]
    return [f for f in Files(spark, folder).names(folder) if name(f).endswith(suffix) and label in name(f) and not name(f).startswith((".", "_"))]


def load(spark: SparkSession, table: str, folder: str, suffix: str, work: Callable[[list[str]], int], at: dt.datetime) -> DataFrame:
    """One attempt to load what is pending, as a row for ``control.attempts``; a failure is recorded, not raised.

    ``work`` takes the files and returns the rows that it wrote; an empty landing folder never calls it.
    """
    files = pending(spark, folder, suffix)
    rows, error = 0, None
    if files:
        try:
            rows = work(files)
        except Exception as e:
            error = str(e)[:500]
    return spark.createDataFrame([(table, at, len(files), rows, error)], TRY)


def drain(spark: SparkSession, files: list[str], archive: str, table: str, stamp: str) -> list[str]:
    """Moves loaded files to the archive, last of all; returns those that could not be moved."""
    store = Files(spark, archive)
    return [f for f in files if not store.move(f, f"{archive}/{table}/{stamp}")]
