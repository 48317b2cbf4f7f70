"""The folder that all nodes share, for tables between two jobs."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used where ``spark.checkpoint.dir`` is unset and all runs on one machine.
ONE_MACHINE = "file:///tmp/sedge-shared"
#: Rows that are broadcast at most (short ones: some 50 bytes).
BROADCAST_ROWS = 100_000
#: Ids of 64 bits alone that are broadcast at most.
BROADCAST_IDS = 1_000_000
#: Spark's setting by which the shuffles of a job go when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has ``limit`` rows or fewer."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``.

    Without that setting, a session on one machine gets a local folder; on a
    cluster that is an error, as executors would write to disks of their own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all nodes share")
        base = ONE_MACHINE
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, **options) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a cut in the lineage
    which survives lost executors.  The shuffles that made it are removed, as nothing
    reads them again.  ``options`` are the writer's."""
    return _written(df, shared_folder(df.sparkSession, name), **options)


@contextmanager
def shuffles_removed(spark: SparkSession):
    """Jobs herein leave no shuffles: what they write is read instead."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def _written(df: DataFrame, path: str, **options) -> DataFrame:
    with shuffles_removed(df.sparkSession):
        df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession, name: str):
    """Gives ``hold(df, name)``, which stores tables that nothing reads after the block:
    they are removed at its end."""
    base = shared_folder(spark, name)
    try:
        yield lambda df, part: _written(df, f"{base}/{part}", compression="zstd")
    finally:
        remove(spark, base)


class Rounds:
    """Tables of an iteration: each round is written, and the one before it is
    removed as soon as the next is there."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base, self.n = spark, shared_folder(spark, name), 0

    def hold(self, df: DataFrame) -> DataFrame:
        held = _written(df, f"{self.base}/{self.n}")
        if self.n:
            remove(self.spark, f"{self.base}/{self.n - 1}")
        self.n += 1
        return held


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
