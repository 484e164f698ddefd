"""Per-user scores and behavioural signals from user-day rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from wardlight.sources.readers import require_columns


def mark_members(df: DataFrame, members: DataFrame, flag: str = "is_insider", user: str = "user") -> DataFrame:
    """Add 0/1 membership of `user` in a table of distinct users."""
    listed = members.select(F.col(user).alias("__member")).distinct().withColumn("__hit", F.lit(1))
    joined = df.join(listed, F.col(user) == F.col("__member"), "left")
    return joined.withColumn(flag, F.coalesce("__hit", F.lit(0))).drop("__member", "__hit")


def user_scores(df: DataFrame, score: str, insiders: DataFrame | None = None, user: str = "user",
                split: str = "dataset_split") -> DataFrame:
    """Max, mean and exact p95 of a user's daily scores, and the user's usual split.

    Input is unique on (user, day): the percentile buffer of a user holds at most one
    value per calendar day. Users without any score get p95 = 0.
    """
    result = df.groupBy(F.col(user).alias("user")).agg(
        F.max(score).alias("score_max"),
        F.avg(score).alias("score_mean"),
        F.coalesce(F.percentile(score, F.lit(0.95)), F.lit(0.0)).alias("score_p95"),
        F.mode(split, deterministic=True).alias("dataset_split"),
    )
    return mark_members(result, insiders) if insiders is not None else result


_SIGNAL_INPUTS = ("user", "after_hours_ratio", "bcc_ratio", "file_to_removable", "file_total",
                  "usb_connect_count", "after_hours_logons", "logon_count", "unique_logon_pcs",
                  "dataset_split")


def behavior_signals(user_days: DataFrame) -> DataFrame:
    """One row per user: mean ratios, totals, smoothed rates, first employee name."""
    require_columns(user_days, _SIGNAL_INPUTS, "user-day table")
    name = (F.min_by("employee_name", F.when(F.col("employee_name").isNotNull(), F.col("email_day")))
            if "employee_name" in user_days.columns else F.lit(None).cast("string"))
    result = user_days.groupBy("user").agg(
        F.avg("after_hours_ratio").alias("after_hours_rate"),
        F.avg("bcc_ratio").alias("bcc_rate"),
        F.sum("file_to_removable").alias("total_file_exfil"),
        F.sum("file_total").alias("total_file_ops"),
        F.sum("usb_connect_count").alias("total_usb"),
        F.sum("after_hours_logons").alias("total_ah_logons"),
        F.sum("logon_count").alias("total_logons"),
        F.max("unique_logon_pcs").alias("max_unique_pcs"),
        F.mode("dataset_split", deterministic=True).alias("dataset_split"),
        name.alias("employee_name"),
    )
    return result.withColumns({
        "employee_name": F.coalesce("employee_name", F.col("user").cast("string")),
        "file_exfil_rate": F.col("total_file_exfil") / (F.col("total_file_ops") + 1),
        "ah_logon_rate": F.col("total_ah_logons") / (F.col("total_logons") + 1),
    })
