"""Files through Hadoop's file system: any store that Spark reads, never the driver's disk alone."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession, root: str):
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self.path(root).getFileSystem(self._conf)

    def path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(name)

    def exists(self, name: str) -> bool:
        return self._fs.exists(self.path(name))

    def names(self, folder: str) -> list[str]:
        """Full paths of the files and folders in a folder, in order; none where there is no folder."""
        if not self.exists(folder):
            return []
        return sorted(s.getPath().toString() for s in self._fs.listStatus(self.path(folder)))

    def create(self, name: str, content: str = "") -> bool:
        """Makes a file that must not exist yet; False if it does. As atomic as the store's own create."""
        try:
            out = self._fs.create(self.path(name), False)
        except Exception as e:
            if "AlreadyExists" in str(e):
                return False
            raise
        out.write(bytearray(content.encode()))
        out.close()
        return True

    def first_line(self, name: str) -> str:
        """The first line alone; the rest of the file is not read."""
        raw = self._fs.open(self.path(name))
        reader = self._jvm.java.io.BufferedReader(self._jvm.java.io.InputStreamReader(raw, "UTF-8"))
        try:
            return reader.readLine() or ""
        finally:
            reader.close()

    def move(self, name: str, folder: str) -> bool:
        self._fs.mkdirs(self.path(folder))
        return self._fs.rename(self.path(name), self.path(f"{folder}/{name.rsplit('/', 1)[-1]}"))

    def delete(self, name: str) -> None:
        self._fs.delete(self.path(name), True)


@contextmanager
def exclusive(spark: SparkSession, lock: str) -> Iterator[None]:
    """Holds a lock file while a job runs; a second run is refused."""
    files = Files(spark, lock)
    if not files.create(lock):
        raise RuntimeError(f"another run holds {lock}")
    try:
        yield
    finally:
        files.delete(lock)
