"""Versioned Parquet tables: atomic commits, pinned reads, restore, bundles.

A table is a list of data folders, each written once and never changed, and a version of the store
is a small file that lists them. A commit writes its own new folders, then makes the next version's
file, which must not exist yet: of two writers of one version the second is refused and its folders
go, whatever it wrote. An append adds a folder, a replacement rewrites only the folders that hold
rows to replace, so neither reads the whole table. Several tables in one bundle change together.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import Files


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._files = Files(spark, self.root)

    def version(self) -> int:
        """The present version of the whole store, 0 before any commit."""
        found = [int(n.rsplit("/", 1)[-1].split(".")[0]) for n in self._files.names(f"{self.root}/_commits") if n.endswith(".json")]
        return max(found, default=0)

    def _state(self, version: int) -> dict[str, list[dict]]:
        if not version:
            return {}
        rows = self.spark.read.text(f"{self.root}/_commits/{version:08d}.json").collect()
        return json.loads("".join(r.value for r in rows))

    def _put(self, name: str, df: DataFrame, partition_by: list[str] | None) -> dict:
        path = f"{self.root}/{name}/{uuid.uuid4().hex}"
        writer = df.write.mode("error")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
        return {"path": path, "by": partition_by or []}

    def _commit(self, version: int, state: dict[str, list[dict]], made: list[dict]) -> int:
        if not self._files.create(f"{self.root}/_commits/{version:08d}.json", json.dumps(state)):
            for entry in made:
                self._files.delete(entry["path"])
            raise RuntimeError(f"another commit took version {version}")
        return version

    def commit_bundle(self, tables: dict[str, DataFrame], partition_by: dict[str, list[str]] | None = None, base: int | None = None) -> int:
        """Writes the tables anew and commits once, on top of version ``base`` (the present one)."""
        base = self.version() if base is None else base
        made = {name: [self._put(name, df, (partition_by or {}).get(name))] for name, df in tables.items()}
        return self._commit(base + 1, self._state(base) | made, [e for entries in made.values() for e in entries])

    def write(self, name: str, df: DataFrame, partition_by: list[str] | None = None) -> int:
        return self.commit_bundle({name: df}, {name: partition_by} if partition_by else None)

    def append(self, name: str, df: DataFrame, partition_by: list[str] | None = None) -> int:
        """Adds the rows as a folder of their own; new columns are null in old rows."""
        base = self.version()
        state = self._state(base)
        entry = self._put(name, df, partition_by)
        return self._commit(base + 1, state | {name: [*state.get(name, []), entry]}, [entry])

    def replace(self, name: str, df: DataFrame, inside: Column) -> int:
        """Replaces what ``inside`` selects, also by nothing; folders without such rows stay as they are."""
        base = self.version()
        state = self._state(base)
        hit = F.coalesce(inside, F.lit(False))
        stay, made = [], []
        for entry in state[name]:
            part = self._folder([entry])
            if part.where(hit).isEmpty():
                stay.append(entry)
            else:
                made.append(self._put(name, part.where(~hit), entry["by"]))
        made.append(self._put(name, df, None))
        return self._commit(base + 1, state | {name: stay + made}, made)

    def _folder(self, entries: list[dict]) -> DataFrame:
        return self.spark.read.option("mergeSchema", True).parquet(*(e["path"] for e in entries))

    def has(self, name: str) -> bool:
        return name in self._state(self.version())

    def read(self, name: str, version: int | None = None) -> DataFrame:
        entries = self._state(self.version() if version is None else version)[name]
        # Folders without partitions are one scan; Spark takes partitions from one root at a time.
        plain = [e for e in entries if not e["by"]]
        parts = ([self._folder(plain)] if plain else []) + [self._folder([e]) for e in entries if e["by"]]
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)

    def restore(self, version: int) -> int:
        """Makes an old version the present one, as a new commit."""
        return self._commit(self.version() + 1, self._state(version), [])


def append_partitioned(df: DataFrame, path: str, day: str = "delta_created_dt") -> None:
    """The append-only sink, partitioned by load day alone."""
    df.write.mode("append").partitionBy(day).parquet(path)
