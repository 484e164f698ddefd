"""Content-sensitivity scores of email and file events, per day and per user."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from wardlight import fixed
from wardlight.functions import rules
from wardlight.functions.scale import clip


def _column(df: DataFrame, name: str):
    return F.coalesce(F.col(name).cast("int"), F.lit(0)) if name in df.columns else F.lit(0)


def score_email(df: DataFrame, keyword_rules=fixed.KEYWORD_RULES) -> DataFrame:
    """Score cleaned email events: (user, email_day, event_score), 0 is PUBLIC.

    A long message with an attachment is one tier up, at most 3. PUBLIC rows are left
    out by the aggregates, not filtered here: a filter on the score would be pushed to
    the scan and run every rule twice.
    """
    boost = ((_column(df, "content_length_words") > 500) & (_column(df, "has_attachment") == 1)).cast("int")
    return df.select(
        "user", "email_day",
        F.least(rules.keyword_tier("content", keyword_rules) + boost, F.lit(3)).alias("event_score"))


def file_event_score(df: DataFrame, keyword_rules=fixed.KEYWORD_RULES):
    """Expression of the file event tier (0..3)."""
    ext = rules.extension_tier("filename")
    to_usb = _column(df, "to_removable_media") == 1
    from_usb = _column(df, "from_removable_media") == 1
    written = to_usb & (_column(df, "is_write") == 1)
    floor = F.when(written, 2).when(to_usb | from_usb, 1).otherwise(0)
    metadata = F.greatest(ext, rules.signature_tier("content"), floor)
    # 3 is the top: content is read only when the metadata has not settled it.
    return F.when(metadata >= 3, 3).otherwise(
        F.greatest(metadata, rules.keyword_tier("content", keyword_rules))).cast("int")


def score_file(df: DataFrame, keyword_rules=fixed.KEYWORD_RULES) -> DataFrame:
    """Score cleaned file events: (user, email_day, event_score), 0 is PUBLIC."""
    score = file_event_score(df, keyword_rules)
    return df.select("user", F.col("day").alias("email_day"), score.alias("event_score"))


def sensitivity_daily(*scored: DataFrame) -> DataFrame:
    """Union scored sources and aggregate to one row per (user, day).

    PUBLIC events take no part: the mean is over the others, and a day with none has no row.
    """
    events = reduce(DataFrame.unionByName, scored)
    tier = F.col("event_score")
    daily = events.groupBy("user", "email_day").agg(
        (F.sum(tier) / F.nullif(F.count_if(tier > 0), F.lit(0))).alias("mean_score"),
        F.max(tier).alias("max_sensitivity_score"),
        F.count_if(tier >= 2).alias("sensitive_event_count"),
        F.count_if(tier == 3).alias("restricted_event_count"),
    ).where("max_sensitivity_score > 0")
    return daily.select(
        "user", "email_day",
        F.bround(clip("mean_score", 0.0, 3.0), 4).alias("sensitivity_score"),
        "max_sensitivity_score", "sensitive_event_count", "restricted_event_count",
        rules.tier_label("max_sensitivity_score").alias("top_sensitivity_label"),
    )


def sensitivity_user(daily: DataFrame) -> DataFrame:
    """Per-user sensitivity signal and totals."""
    return daily.groupBy("user").agg(
        F.avg("max_sensitivity_score").alias("content_sensitivity_rate"),
        F.sum("sensitive_event_count").alias("total_sensitive_events"),
        F.sum("restricted_event_count").alias("total_restricted_events"),
    )


def label_distribution(daily: DataFrame) -> DataFrame:
    """User-days per label with percentages; all four labels are listed."""
    counted = daily.agg(
        *[F.count_if(F.col("top_sensitivity_label") == label).alias(label) for label in fixed.TIER_LABELS])
    rows = counted.withColumn("total", F.expr(" + ".join(fixed.TIER_LABELS)))
    return rows.unpivot("total", list(fixed.TIER_LABELS), "label", "user_days").select(
        "label", "user_days",
        F.when(F.col("total") == 0, 0.0).otherwise(F.col("user_days") * 100.0 / F.col("total")).alias("percent"))
