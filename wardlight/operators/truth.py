"""Answer key: choosing the release that fits, and labelled user-days."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from wardlight.functions.text import release_label
from wardlight.functions.time import parse_timestamp
from wardlight.sources.readers import require_columns


def _with_release(key: DataFrame) -> DataFrame:
    require_columns(key, ["dataset", "user"], "answer key")
    return key.withColumn("release", release_label("dataset"))


def release_matches(key: DataFrame, scored_users: DataFrame) -> DataFrame:
    """Per release: distinct labelled users and how many of them were scored."""
    labelled = _with_release(key).select("release", "user").na.drop().distinct()
    present = scored_users.select("user").distinct().withColumn("__hit", F.lit(1))
    return labelled.join(present, "user", "left").groupBy("release").agg(
        F.count(F.lit(1)).alias("release_users"), F.count("__hit").alias("matches"))


def best_release(matches: DataFrame) -> DataFrame:
    """The release with most matches, then most users; none if nothing matches."""
    return (matches.where("matches > 0")
            .orderBy(F.desc("matches"), F.desc("release_users"), F.asc("release")).limit(1))


def describe_release(matches: DataFrame, scored_users: DataFrame) -> DataFrame:
    """One row: the chosen release, its counts, and a sentence about the choice."""
    counts = matches.agg(F.array_join(F.array_sort(F.collect_list(
        F.concat_ws("=", "release", F.col("matches").cast("string")))), ", ").alias("c")).scalar()
    scored = scored_users.select("user").distinct().agg(F.count(F.lit(1))).scalar()
    chosen = best_release(matches).withColumns({"scored_users": scored, "match_counts": counts})
    return chosen.withColumn("description", F.format_string(
        "release %s selected (%d/%d labelled users match %d scored users; matches by release: %s)",
        "release", "matches", "release_users", "scored_users", "match_counts"))


def labelled_users(key: DataFrame, scored_users: DataFrame, matches: DataFrame | None = None) -> DataFrame:
    """Users of the chosen release that were scored."""
    matches = matches if matches is not None else release_matches(key, scored_users)
    chosen = best_release(matches).select("release").scalar()
    listed = _with_release(key).where(F.col("release") == chosen)
    return listed.select("user").distinct().join(scored_users.select("user"), "user", "left_semi")


def expand_intervals(intervals: DataFrame, start: str = "start", end: str = "end",
                     user: str = "user") -> DataFrame:
    """Distinct (user, email_day) of every day in [start, end], with is_insider = 1.

    Days are the truncated endpoints, both included. A null endpoint or an end before
    the start gives no rows.
    """
    first, last = F.to_date(start), F.to_date(end)
    valid = intervals.where(first.isNotNull() & last.isNotNull() & (first <= last))
    days = valid.select(F.col(user).alias("user"), F.explode(F.sequence(first, last)).alias("email_day"))
    return days.distinct().withColumn("is_insider", F.lit(1))


def label_days(rows: DataFrame, intervals: DataFrame, day: str = "email_day", start: str = "start", end: str = "end",
               user: str = "user", bin_days: int = 64) -> DataFrame:
    """Add is_insider (1 if some interval of the user holds the day, else 0) without listing the days of intervals.

    Intervals are cut at the edges of bins of `bin_days` days and reduced per (user, bin) to
    disjoint stretches, so a row meets at most the stretches of its own bin; a long interval costs
    one row per bin. Days are the truncated endpoints, both included; a null endpoint, an end
    before the start and a null user or day label nothing. Every row stays, once.
    """
    number = lambda c: F.datediff(c, F.lit("1970-01-01").cast("date"))
    slot = lambda n: F.floor(n / bin_days).cast("int")
    ends = intervals.select(F.col(user).alias("__user"), number(F.to_date(start)).alias("lo"), number(F.to_date(end)).alias("hi"))
    cut = ends.where("lo <= hi AND __user IS NOT NULL").select(
        "__user", "lo", "hi", F.explode(F.sequence(slot(F.col("lo")), slot(F.col("hi")))).alias("__bin"))
    inside = cut.select("__user", "__bin", F.greatest("lo", F.col("__bin") * bin_days).alias("lo"),
                        F.least("hi", (F.col("__bin") + 1) * bin_days - 1).alias("hi")).distinct()
    # At most bin_days (bin_days + 1) / 2 different stretches per user and bin, whatever the number of intervals.
    held = inside.groupBy("__user", "__bin").agg(F.collect_list(F.struct("lo", "hi")).alias("stretches"))
    at = number(F.col(day))
    marked = rows.withColumn("__bin", slot(at)).join(
        held.withColumnRenamed("__bin", "__slot"), (F.col(user) == F.col("__user")) & (F.col("__bin") == F.col("__slot")), "left")
    hit = F.exists("stretches", lambda s: (s["lo"] <= at) & (at <= s["hi"]))
    return marked.withColumn("is_insider", F.coalesce(hit.cast("int"), F.lit(0))).drop("__bin", "__slot", "__user", "stretches")


def day_labels(key: DataFrame, scored_users: DataFrame) -> DataFrame:
    """Labelled user-days of the chosen release."""
    matches = release_matches(key, scored_users)
    chosen = best_release(matches).select("release").scalar()
    rows = _with_release(key).where(F.col("release") == chosen)
    rows = rows.join(scored_users.select("user"), "user", "left_semi")
    return expand_intervals(rows.withColumns({c: parse_timestamp(c) for c in ("start", "end")}))


def users_per_release(key: DataFrame) -> DataFrame:
    """Distinct labelled users per release."""
    return _with_release(key).groupBy("release").agg(F.countDistinct("user").alias("users"))
