"""Sinks: day-partitioned tables, scored tables, metric reports, run counters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from wardlight.sources.stage import drop_stage, stage


def write_by_day(df: DataFrame, path: str, day: str = "day", watch=None) -> None:
    """Overwrite a Parquet table partitioned by day.

    The rebalance hint lets AQE split a hot day and merge small ones, so neither one
    huge file nor a file per (task, day) is written. `watch` may add an observation to the
    rows as they are written.
    """
    spread = df.hint("rebalance", day)
    (watch(spread) if watch else spread).write.mode("overwrite").partitionBy(day).parquet(path)


def replace_days(df: DataFrame, path: str, day: str = "day") -> None:
    """Overwrite the days that `df` has in a table written by day; all other days stay.

    Repeating it gives the same table.
    """
    df.hint("rebalance", day).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)


def merge_late(late: DataFrame, path: str, key: str, day: str = "day", order: str | None = None) -> None:
    """Add late rows to a table written by day: the days they touch are written anew, with one row per key.

    Only those days are read. The merged rows are stored before the days are replaced, so a
    run that fails can be repeated; a repeated one changes nothing.
    """
    from wardlight.operators.clean import keep_first

    spark = late.sparkSession
    late = stage(late, "late-rows")
    days = [r[0] for r in late.select(day).distinct().collect()]  # calendar days of one batch
    stored = spark.read.parquet(path)
    touched = stored.where(F.col(day).isin([d for d in days if d is not None]) | (F.lit(None in days) & F.col(day).isNull()))
    merged = stage(keep_first(touched.select(late.columns).unionByName(late), key, order), "merged-days")
    replace_days(merged, path, day)
    drop_stage(late, merged)


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def metrics_long(section: str, one_row: DataFrame) -> DataFrame:
    """A one-row report as (section, metric, value) rows."""
    names = one_row.columns
    texts = one_row.select(*[F.col(c).cast("string").alias(c) for c in names])
    return texts.unpivot([], names, "metric", "value").select(
        F.lit(section).alias("section"), "metric", "value")


def write_report(sections: dict[str, DataFrame], path: str) -> None:
    """Write one-row reports as JSON lines (section, metric, value)."""
    parts = [metrics_long(name, df) for name, df in sections.items()]
    reduce(DataFrame.unionByName, parts).write.mode("overwrite").json(path)


def table_counters(name: str, df: DataFrame, user: str | None = None,
                   date: str | None = None) -> DataFrame:
    """Rows, distinct users and date range of one table, as (section, metric, value)."""
    aggs = [F.count(F.lit(1)).alias("rows")]
    if user:
        aggs.append(F.countDistinct(user).alias("users"))
    if date:
        aggs += [F.min(date).alias("first"), F.max(date).alias("last")]
    return metrics_long(name, df.agg(*aggs))
