"""Durable intermediate results and size-checked lookups.

Anything read more than once, or that must not change between two passes, is written as a
Parquet table below the session's checkpoint folder, so that it survives the loss of
executors.
"""

import atexit
import shutil
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_BYTES = 64 << 20
_LOCAL_DIR = "spark.outvote.localStaging"
_owners: list["Staged"] = []


class Staged:
    """The tables staged for one result; ``release`` deletes them and no others."""

    def __init__(self):
        self.paths: list[str] = []
        self.names: list[str] = []

    def release(self, spark: SparkSession) -> int:
        dropped = 0
        while self.names:
            spark.sql(f"drop table if exists {self.names.pop()}")
        while self.paths:
            files, target = _hadoop(spark, self.paths.pop())
            dropped += bool(files.delete(target, True))
        return dropped


_staged = Staged()


@contextmanager
def owned():
    """Tables staged inside the block belong to the handle it gives; the innermost block wins.

    ``with owned() as tables: result = ...``; when the result has been used, ``tables.release(spark)``.
    """
    handle = Staged()
    _owners.append(handle)
    try:
        yield handle
    finally:
        _owners.remove(handle)


def row_bytes(numbers: int = 12) -> int:
    """Bound for a row of that many numbers in a broadcast table: 8 bytes each, labels and overhead."""
    return 100 + 8 * numbers


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by the session; a private one only in local mode."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(_LOCAL_DIR, None)
    if not named:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="outvote-")
        atexit.register(shutil.rmtree, named, True)
        spark.conf.set(_LOCAL_DIR, named)
    return named.rstrip("/")


def new_path(spark: SparkSession) -> str:
    """A path for a table of this run."""
    return f"{checkpoint_dir(spark)}/outvote-{uuid.uuid4().hex}"


def _hadoop(spark, path):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def written(spark: SparkSession, path: str) -> None:
    """Marks a written table to be deleted by ``release`` or when the driver ends."""
    files, target = _hadoop(spark, path)
    files.deleteOnExit(target)
    (_owners[-1] if _owners else _staged).paths.append(path)


def stage(df: DataFrame, by=()) -> DataFrame:
    """Write ``df`` once, with one folder per value of ``by`` if given, and return a frame over what was written."""
    spark = df.sparkSession
    path = new_path(spark)
    (df.write.partitionBy(*by) if by else df.write).parquet(path)
    written(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def stage_bucketed(df: DataFrame, key: str, buckets: int) -> DataFrame:
    """Write ``df`` once as a table of ``buckets`` buckets by ``key``, one file each, and return a frame over it.

    Tables with equal numbers of buckets join on the key without a shuffle. The table's name lives in the session's catalog; where
    that outlasts the driver, ``release`` must be called.
    """
    spark = df.sparkSession
    path, name = new_path(spark), f"outvote_{uuid.uuid4().hex}"
    dealt = df.repartition(buckets, key)  # by the hash that buckets use, so each task writes one bucket
    dealt.write.format("parquet").bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(name)
    written(spark, path)
    (_owners[-1] if _owners else _staged).names.append(name)
    return spark.table(name)


def release(spark: SparkSession) -> int:
    """Delete the tables staged outside any ``owned`` block; frames built on them become unreadable."""
    return _staged.release(spark)


def fits_broadcast(df: DataFrame, width: int = row_bytes()) -> bool:
    """Whether so many rows of about this size stay below the broadcast budget.

    Counts no more rows than the budget allows. Give it a staged frame: this is an action.
    """
    most = max(BROADCAST_BYTES // width, 1)
    return df.limit(most + 1).count() <= most


def lookup(df: DataFrame, small: DataFrame, keys, how="left", width: int = row_bytes()) -> DataFrame:
    """Join per-key facts to rows: broadcast after a row count, else a shuffled join.

    ``small`` must be staged (it is counted, then read again) and have one row per key. The
    shuffled join relies on adaptive execution to split a key that holds a large share of
    the rows.
    """
    if not keys:
        row = F.broadcast(small.withColumn("_one", F.lit(1)))  # one row
        return df.withColumn("_one", F.lit(1)).join(row, "_one", how).drop("_one")
    if fits_broadcast(small, width):
        small = F.broadcast(small)
    return df.join(small, list(keys), how)
