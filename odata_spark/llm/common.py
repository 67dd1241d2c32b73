"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WS = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


_shipped: set[str] = set()
_scratch: ContextVar[list[str] | None] = ContextVar("scratch", default=None)


def ship(spark: SparkSession) -> None:
    """Gives the executors this package, whatever their search path; once for each application.

    Every operator that runs Python on the executors calls it.
    """
    if spark.sparkContext.applicationId in _shipped:
        return
    _shipped.add(spark.sparkContext.applicationId)
    package = Path(__file__).resolve().parent.parent
    folder = Path(tempfile.mkdtemp())
    target = folder / f"{package.name}.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, p.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(target))  # Spark serves it to the executors
    atexit.register(shutil.rmtree, folder, ignore_errors=True)


BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession, most: int = 2 << 20) -> None:
    """Batches of rows that go to Python hold about `most` bytes, not 10,000 rows of any length; a session's own setting stands."""
    if spark.conf.get(BATCH_BYTES, None) is None:
        spark.conf.set(BATCH_BYTES, str(most))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster shares; a private one only in local mode with nothing set."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="odata_spark_"))
    return spark.sparkContext.getCheckpointDir()


def write(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df written to a new folder of the shared one, and read again; and that folder."""
    ship(df.sparkSession)
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and read it back: cuts lineage, survives lost executors."""
    out, path = write(df, name)
    if (made := _scratch.get()) is not None:
        made.append(path)
    return out


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables materialised inside are deleted at the end."""
    made: list[str] = []
    token = _scratch.set(made)
    try:
        yield
    finally:
        _scratch.reset(token)
        remove(spark, made)


def remove(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


BITS = 26


def _bit(key: str) -> Column:
    return F.pmod(F.xxhash64(F.col(key), F.lit(9)), F.lit(1 << BITS))


def bitmap(keys: DataFrame, key: str) -> DataFrame:
    """A bitmap of hashed keys, for might_hold: at most 2 ** (BITS - 6) rows of 64 bits, whatever the number of keys."""
    return keys.select(_bit(key).alias("__bit")).groupBy(F.shiftright("__bit", 6).alias("__word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(__bit % 64 as int))")).alias("__bits"))


def might_hold(df: DataFrame, key: str, bits: DataFrame) -> DataFrame:
    """df with `__maybe`: false only for rows whose key is not in the bitmap. It is broadcast, so df is not shuffled."""
    df = df.withColumn("__bit", _bit(key)).withColumn("__word", F.shiftright("__bit", 6))
    found = df.join(F.broadcast(bits), "__word", "left").withColumn("__maybe", F.coalesce(F.expr("(shiftright(__bits, cast(__bit % 64 as int)) & 1L) = 1L"), F.lit(False)))
    return found.drop("__word", "__bit", "__bits")


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, UPPER.lower())


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of doc_id as text, mod n; a null id counts as the empty string."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))
