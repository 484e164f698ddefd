"""Stage boundaries: a table written once to shared storage and read back."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder named by `spark.checkpoint.dir` (or set on the context).

    Without one, a single-machine session gets a temporary folder; a cluster session is an
    error, as its executors would not see each other's files.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="wardlight-"))
        current = spark.sparkContext.getCheckpointDir()
    return current.rstrip("/")


def fitted(df: DataFrame) -> dict:
    """The single row of a fit (ranges, cutoffs) as plain values.

    Fits have a fixed number of columns whatever the data size; as literals they cost
    the plans that apply them nothing.
    """
    return df.first().asDict()


#: Shuffle files of a finished write are of no use any more.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def file_system(spark: SparkSession, path: str):
    """Spark's file system of a path, and the path in its form."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


@contextmanager
def short_shuffles(spark: SparkSession):
    """Queries that run inside drop their shuffle files at their end.

    Without this the files stay until the driver collects its garbage, so a job of many
    stored steps holds the shuffles of all of them at once. What is read later is stored, so
    a lost executor still costs a repetition of the running step only.
    """
    was = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, was)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as Parquet under the shared root and return the stored table.

    Used where a table is read more than once downstream (fit, threshold, apply):
    the plan behind it runs once, later readers prune columns, and losing an
    executor re-reads files instead of re-running the lineage.
    """
    spark = df.sparkSession
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    with short_shuffles(spark):
        df.write.mode("error").parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)
    stored.stored_at = path
    return stored


def drop_stage(*tables: DataFrame) -> None:
    """Delete stored tables that nothing will read any more (others are left alone)."""
    for table in tables:
        path = getattr(table, "stored_at", None)
        if path:
            fs, where = file_system(table.sparkSession, path)
            fs.delete(where, True)
