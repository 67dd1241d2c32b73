"""Sources of entity sets, and the snapshot store that takes writes.

A stored set is a folder of immutable Parquet snapshots and a pointer file that names the current
one. A write derives the next snapshot from the current one with DataFrame operations and then
replaces the pointer; readers of the old snapshot are not disturbed. Pointers are read and written
through Spark's file system, so the folder may lie in any store that Spark reaches. Each set's
commit is atomic; several sets are committed one after the other under one lock.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

LOCK = threading.RLock()


def files(path: str, kind: str = "parquet", schema: str | None = None, **options) -> Callable[[SparkSession], DataFrame]:
    """parquet, orc, json or csv."""

    def load(spark: SparkSession) -> DataFrame:
        reader = spark.read.format(kind).options(**options)
        return (reader.schema(schema) if schema else reader).load(path)

    return load


def view(of: Callable[[SparkSession], DataFrame], *columns: str) -> Callable[[SparkSession], DataFrame]:
    return lambda spark: of(spark).select(*columns)


class SnapshotStore:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _path(self, name: str):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def current(self, set_name: str) -> str:
        path, fs = self._path(f"{set_name}/_CURRENT")
        stream = fs.open(path)
        try:
            return bytes(stream.readNBytes(1000)).decode()
        finally:
            stream.close()

    def create(self, set_name: str, df: DataFrame) -> None:
        self.commit({set_name: df})

    def source(self, set_name: str) -> Callable[[SparkSession], DataFrame]:
        return lambda spark: spark.read.parquet(f"{self.folder}/{set_name}/{self.current(set_name)}")

    def commit(self, frames: dict[str, DataFrame]) -> None:
        """All snapshots are written before the first pointer moves."""
        with LOCK:
            names = {}
            for set_name, df in frames.items():
                names[set_name] = uuid.uuid4().hex
                df.write.parquet(f"{self.folder}/{set_name}/{names[set_name]}")
            for set_name, name in names.items():
                path, fs = self._path(f"{set_name}/_CURRENT")
                new, _ = self._path(f"{set_name}/_CURRENT.{name}")
                stream = fs.create(new, True)
                try:
                    stream.write(bytearray(name.encode()))
                finally:
                    stream.close()
                context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(new.toUri(), self.spark._jsc.hadoopConfiguration())
                options = self.spark._jvm.org.apache.hadoop.fs.Options.Rename
                array = self.spark.sparkContext._gateway.new_array(options, 1)
                array[0] = options.OVERWRITE
                context.rename(new, path, array)
