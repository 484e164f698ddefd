"""Detection metrics with exact handling of tied scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from wardlight.functions.scale import at_least
from wardlight.operators.order_stats import fit_quantiles, running_sums
from wardlight.operators.signals import mark_members
from wardlight.operators.truth import label_days
from wardlight.sources.stage import stage


def _ratio(a, b):
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def f1(precision, recall):
    return F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(F.lit(0.0))


def detection_metrics(df: DataFrame, truth: str = "is_insider", score: str = "score",
                      predicted: str = "predicted") -> DataFrame:
    """ROC AUC, average precision, confusion counts, precision, recall and F1 (one row).

    Rows are folded to distinct scores first; ties share one step of both curves.
    ROC AUC is null when only one class is present; no positives gives no row.
    """
    y, p = F.col(truth) == 1, F.col(predicted) == 1
    counts = df.groupBy(F.coalesce(F.col(score).cast("double"), F.lit(0.0)).alias("score")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(y).alias("pos"),
        F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"))
    steps = running_sums(stage(counts, "score-counts"), "score", ["n", "pos"], descending=True)
    steps = steps.withColumns({
        "above": F.col("n_before") + F.col("n"), "found": F.col("pos_before") + F.col("pos"),
        "neg": F.col("n") - F.col("pos")})
    sums = steps.agg(
        F.sum(F.col("neg") * (F.col("pos_before") + F.col("pos") / 2)).alias("pairs"),
        F.sum(F.col("pos") * F.col("found") / F.col("above")).alias("area"),
        *[F.sum(c).alias(c) for c in ("n", "pos", "neg", "tp", "fp")])
    sums = sums.where("pos > 0").withColumns({
        "precision": _ratio(F.col("tp"), F.col("tp") + F.col("fp")),
        "recall": _ratio(F.col("tp"), F.col("pos"))})
    return sums.select(
        F.round(F.when(F.col("neg") > 0, F.col("pairs") / (F.col("pos") * F.col("neg"))), 4).alias("roc_auc"),
        F.round(F.col("area") / F.col("pos"), 4).alias("avg_precision"),
        F.round("precision", 4).alias("precision"), F.round("recall", 4).alias("recall"),
        F.round(f1(F.col("precision"), F.col("recall")), 4).alias("f1"),
        "tp", "fp", (F.col("neg") - F.col("fp")).alias("tn"), (F.col("pos") - F.col("tp")).alias("fn"),
        F.col("pos").alias("n_insiders"), F.col("n").alias("n_total"))


def day_metrics(scored: DataFrame, labels: DataFrame, score: str, severity: str,
                split: str = "dataset_split") -> DataFrame:
    """Day-level metrics on determined test rows; suspicious and high count as predicted."""
    test = _determined_test(scored, score, severity, split)
    joined = test.join(labels.select("user", "email_day", "is_insider"), ["user", "email_day"], "left")
    return detection_metrics(joined.withColumn("is_insider", F.coalesce("is_insider", F.lit(0))))


def interval_metrics(scored: DataFrame, intervals: DataFrame, score: str, severity: str,
                     split: str = "dataset_split") -> DataFrame:
    """`day_metrics` with labels from intervals (user, start, end), whose days are not listed."""
    return detection_metrics(label_days(_determined_test(scored, score, severity, split), intervals))


def _determined_test(scored: DataFrame, score: str, severity: str, split: str) -> DataFrame:
    test = scored.where((F.col(split) == "test") & (F.col(severity) != "undetermined"))
    return test.select("user", "email_day", F.col(score).alias("score"),
                       F.col(severity).isin("suspicious", "high").cast("int").alias("predicted"))


def user_max_metrics(scored: DataFrame, insiders: DataFrame, score: str, severity: str,
                     share: float = 0.93) -> DataFrame:
    """User-level metrics: a user's highest score against a quantile of **row** scores.

    Rows and user maxima live on different scales; `topk.survivors` is the form to
    prefer. Kept because published numbers use it.
    """
    rows = scored.where(F.col(severity) != "undetermined")
    cut = fit_quantiles(rows, score, [share])[0]
    users = mark_members(rows.groupBy("user").agg(F.max(score).alias("score")), insiders)
    return detection_metrics(users.withColumn("predicted", at_least("score", cut)))


def max_score_per_user(scored: DataFrame, score: str) -> DataFrame:
    return scored.groupBy("user").agg(F.max(score).alias("max_score"))
