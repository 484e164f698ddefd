"""Chronological train / val / test splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from wardlight import fixed


def _fractions(train: float, val: float):
    # Doubles on purpose: int(90 * 0.7) is 62 in binary floating point.
    return F.lit(float(train)), F.lit(float(train + val))


def split_by_user(df: DataFrame, user: str = "user", day: str = "email_day",
                  train: float = fixed.TRAIN_FRACTION, val: float = fixed.VAL_FRACTION, place: str | None = None) -> DataFrame:
    """Add `dataset_split` from each user's own timeline, and a row's place in it (from 0) as `place`.

    Input is unique on (user, day), so a window holds at most one row per calendar day.
    """
    upto_train, upto_val = _fractions(train, val)
    timeline = Window.partitionBy(user)
    position = F.row_number().over(timeline.orderBy(day)) - 1
    size = F.count(F.lit(1)).over(timeline)
    return (
        df.withColumns({"__pos": position, "__size": size})
        .withColumn("dataset_split",
                    F.when(F.col("__pos") < F.floor(F.col("__size") * upto_train), "train")
                    .when(F.col("__pos") < F.floor(F.col("__size") * upto_val), "val")
                    .otherwise("test"))
        .withColumnsRenamed({"__pos": place} if place else {}).drop("__pos", "__size")
    )


def date_cutoffs(df: DataFrame, day: str = "email_day",
                 train: float = fixed.TRAIN_FRACTION, val: float = fixed.VAL_FRACTION) -> DataFrame:
    """One row (train_cutoff, val_cutoff): the distinct days at 70% and 85%.

    The distinct days of a log are as many as the calendar has, whatever its size.
    """
    upto_train, upto_val = _fractions(train, val)
    days = df.agg(F.array_sort(F.collect_set(F.to_date(day))).alias("days"))
    at = lambda share: F.get("days", F.floor(F.size("days") * share).cast("int"))
    return days.select(at(upto_train).alias("train_cutoff"), at(upto_val).alias("val_cutoff"))


def split_by_date(df: DataFrame, cutoffs: DataFrame, date: str = "date") -> DataFrame:
    """Add `dataset_split` from global day cutoffs (a one-row table)."""
    cut = cutoffs.select(F.struct("train_cutoff", "val_cutoff")).scalar()
    stamp = F.col(date)
    return df.withColumn(
        "dataset_split",
        F.when(stamp < cut["train_cutoff"], "train").when(stamp < cut["val_cutoff"], "val").otherwise("test"))
