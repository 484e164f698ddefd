"""Tables behind summaries and charts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from wardlight.functions.scale import min_max


def severity_summary(scored: DataFrame, severity: str, score: str) -> DataFrame:
    """Rows, users, severity tallies and score range (one row)."""
    tally = lambda name: F.count_if(F.col(severity) == name).alias(f"{name}_rows")
    return scored.agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct("user").alias("users"),
        tally("high"), tally("suspicious"), tally("normal"), tally("undetermined"),
        F.min(score).alias("score_min"), F.max(score).alias("score_max"))


def split_ranges(df: DataFrame, day: str = "email_day", split: str = "dataset_split") -> DataFrame:
    """Rows and day range of each split."""
    return df.groupBy(F.col(split).alias("dataset_split")).agg(
        F.count(F.lit(1)).alias("rows"), F.min(day).alias("first_day"), F.max(day).alias("last_day"))


def severity_floors(scored: DataFrame, severity: str, score: str) -> DataFrame:
    """Smallest score that carries each severity."""
    return scored.where(F.col(severity) != "undetermined").groupBy(F.col(severity).alias("severity")).agg(
        F.min(score).alias("min_score"), F.count(F.lit(1)).alias("rows"))


def daily_max(scored: DataFrame, score: str, day: str = "email_day") -> DataFrame:
    """Highest score of any user per day."""
    return scored.where(F.col(score).isNotNull()).groupBy(day).agg(F.max(score).alias("max_score"))


def top_users_by_mean(scored: DataFrame, score: str, n: int = 15) -> DataFrame:
    means = scored.where(F.col(score).isNotNull()).groupBy("user").agg(F.avg(score).alias("mean_score"))
    return means.orderBy(F.desc("mean_score"), F.asc("user")).limit(n)


def top_rows(scored: DataFrame, score: str, n: int = 20, day: str = "email_day") -> DataFrame:
    return (scored.where(F.col(score).isNotNull())
            .orderBy(F.desc(score), F.asc("user"), F.asc(day)).limit(n))


def timelines(scored: DataFrame, score: str, n: int = 5, day: str = "email_day") -> DataFrame:
    """Daily scores of the n users with the highest mean."""
    top = top_users_by_mean(scored, score, n).select("user")
    rows = scored.where(F.col(score).isNotNull()).select("user", day, score)
    return rows.join(top, "user", "left_semi").orderBy("user", day)


def repeatable_sample(df: DataFrame, keys, n: int = 15000, seed: int = 42) -> DataFrame:
    """At most n rows, chosen by a hash of the keys: the same rows on every run.

    The sample is the feature here (a scatter-plot feed): the n smallest hashes. Each task
    keeps its own n, so about n rows per task are merged; keys may repeat.
    """
    spot = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))
    return df.orderBy(spot, *keys).limit(n)


def histogram(df: DataFrame, value: str, bins: int, by: str | None = None) -> DataFrame:
    """Equal-width histogram per class: bin (0-based), edges, count, density, class mean.

    Every bin has a row, empty ones a count of 0.
    Bins span each class's own range and the last is closed. An all-equal class spans
    half a unit to either side.
    """
    group = [by] if by else []
    rows = df.where(F.col(value).isNotNull())
    stats = rows.groupBy(*group).agg(
        F.min(value).alias("__lo"), F.max(value).alias("__hi"), F.count(F.lit(1)).alias("__n"),
        F.avg(value).alias("class_mean"))
    flat = F.col("__lo") == F.col("__hi")
    stats = stats.select(
        *group, F.when(flat, F.col("__lo") - 0.5).otherwise(F.col("__lo")).alias("__lo"),
        F.when(flat, F.col("__hi") + 0.5).otherwise(F.col("__hi")).alias("__hi"), "__n", "class_mean")
    if by:
        tagged = rows.join(F.broadcast(stats), by)  # one row per class
    else:
        one = stats.select(F.struct("*")).scalar()
        tagged = rows.withColumns({c: one[c] for c in stats.columns})
    position = F.floor(min_max(value, F.col("__lo"), F.col("__hi")) * bins).cast("int")
    width = (F.col("__hi") - F.col("__lo")) / bins
    counted = tagged.withColumn("bin", F.least(position, F.lit(bins - 1))).groupBy(*group, "bin").agg(
        F.count(F.lit(1)).alias("found"))
    every = stats.where("__n > 0").withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    full = every.join(counted, [*group, "bin"], "left").withColumn("count", F.coalesce("found", F.lit(0)))
    return full.select(
        *group, "bin", (F.col("__lo") + F.col("bin") * width).alias("left_edge"),
        (F.col("__lo") + (F.col("bin") + 1) * width).alias("right_edge"), "count",
        (F.col("count") / (F.col("__n") * width)).alias("density"), "class_mean")
