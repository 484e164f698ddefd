"""Incremental forms of cleaning, user-day counts and sensitivity totals.

Event time must be TIMESTAMP (watermarks reject TIMESTAMP_NTZ); keep the session time
zone at UTC so days agree with the batch operators.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from wardlight.operators.features import LOGS
from wardlight.sources.stage import file_system, shared_root
from wardlight.streaming.snapshots import SnapshotTable

SUMS = {**LOGS["logon"].sums, **LOGS["device"].sums, "file_write_count": LOGS["file"].sums["file_write_count"]}


def read_parquet_stream(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """Stream the files of a folder that match a glob, or the table of that name if it is a folder of
    files itself; the schema is read from them."""
    fs, where = file_system(spark, f"{folder}/{pattern}")
    if fs.exists(where) and fs.getFileStatus(where).isDirectory():
        return spark.readStream.schema(spark.read.parquet(f"{folder}/{pattern}").schema).parquet(f"{folder}/{pattern}")
    schema = spark.read.option("pathGlobFilter", pattern).parquet(folder).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)


def dedupe_stream(cleaned: DataFrame, key: str = "id", date: str = "date", delay: str = "1 day") -> DataFrame:
    """First arrival per key; state is dropped once the watermark passes."""
    timed = cleaned.withColumn(date, F.col(date).cast("timestamp"))
    return timed.withWatermark(date, delay).dropDuplicatesWithinWatermark([key])


def clean_stream(raw: DataFrame, cleaner, delay: str = "1 day") -> DataFrame:
    """Clean a stream of raw rows with a batch cleaner, then keep the first arrival per id."""
    return dedupe_stream(cleaner(raw), "id", "date", delay)


def user_day_parts(events: DataFrame, date: str = "date", delay: str = "1 day") -> DataFrame:
    """Logon, device and file counts per (user, day, pc) of a stream of cleaned activity.

    `fold_user_days` adds the parts up and counts the pcs, so distinct pcs are exact and the state
    has one small row per user, open day and pc; a user on many pcs is many keys.
    """
    timed = events.withColumn(date, F.col(date).cast("timestamp")).withWatermark(date, delay)
    return timed.groupBy(F.window(date, "1 day").alias("w"), "user", "pc").agg(
        *[F.sum(F.expr(e)).alias(n) for n, e in SUMS.items()],
    ).select("user", F.to_date("w.start").alias("email_day"), "pc", *SUMS)


def fold_user_days(parts: DataFrame) -> DataFrame:
    """The user-days of stored parts, with the exact number of distinct pcs."""
    return parts.groupBy("user", "email_day").agg(*[F.sum(n).alias(n) for n in SUMS], F.count("pc").alias("unique_pcs"))


def sensitivity_totals(scored: DataFrame, delay: str = "1 day") -> DataFrame:
    """Sums, maximum and tier counts per (user, day) of a stream of scored events.

    A day's totals leave the state once the watermark has passed its end; events that
    come later than `delay` are not counted.
    """
    tier = F.col("event_score")
    timed = scored.withColumn("__at", F.col("email_day").cast("timestamp")).withWatermark("__at", delay)
    return timed.groupBy("user", "email_day", F.window("__at", "1 day").alias("w")).agg(
        F.sum(tier).alias("sum_score"), F.max(tier).alias("max_score"),
        F.count_if(tier >= 2).alias("sensitive_count"), F.count_if(tier == 3).alias("restricted_count"),
        F.count_if(tier > 0).alias("total_events")).where("max_score > 0").drop("w")


def start_table(df: DataFrame, path: str, name: str, keys: tuple[str, ...] = ()) -> StreamingQuery:
    """Run over what is available now into a table, with its checkpoint beside the other state of the cluster.

    Without keys rows are appended through the exactly-once file sink. With keys every batch
    updates their last state in a `SnapshotTable`.
    """
    writer = df.writeStream.outputMode("update" if keys else "append").trigger(availableNow=True).option(
        "checkpointLocation", f"{path}/_state")
    if not keys:
        return writer.format("parquet").option("path", f"{path}/{name}").start()
    table = SnapshotTable(df.sparkSession, f"{path}/{name}", df.schema, keys)
    return writer.foreachBatch(table.add).start()


def run_to_table(df: DataFrame, name: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Drain a stream into a new table under the shared root and read it back.

    With `keys` the stream updates one row per key, without it appends rows.
    """
    spark = df.sparkSession
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    start_table(df, path, name, keys).awaitTermination()
    if not keys:
        return spark.read.schema(df.schema).parquet(f"{path}/{name}")
    return SnapshotTable(spark, f"{path}/{name}", df.schema, keys).read()
