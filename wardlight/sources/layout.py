"""Stored tables laid out by key, so that later joins and windows on it need no shuffle."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from wardlight.sources.stage import shared_root, short_shuffles


def store_bucketed(df: DataFrame, name: str, by: tuple[str, ...], sort: tuple[str, ...] = (), buckets: int | None = None) -> DataFrame:
    """Write `df` into `buckets` buckets by the hash of `by` (sorted inside by `sort`) and return the stored table.

    Tables with the same keys and number of buckets (default: the session's shuffle partitions)
    join on those keys without an exchange. If the rows already lie by those keys, as after an
    aggregation on them, writing costs no further shuffle and each bucket is one file. The
    files are under the shared root; the name is the session's own.
    """
    spark = df.sparkSession
    table = f"{name.replace('-', '_')}_{uuid.uuid4().hex}"
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    writer = df.write.format("parquet").option("path", f"{shared_root(spark)}/{table}").bucketBy(n, *by)
    with short_shuffles(spark):
        (writer.sortBy(*sort) if sort else writer).saveAsTable(table)
    stored = spark.table(table)
    stored.stored_at = f"{shared_root(spark)}/{table}"
    return stored
