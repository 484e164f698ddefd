"""Sliding windows of user-days and their reconstruction error."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window, functions as F

from wardlight import fixed
from wardlight.functions.scale import at_least, error_score, severity
from wardlight.operators.order_stats import fit_quantiles
from wardlight.operators.scaling import fit_ranges, scaled_features
from wardlight.sources.stage import stage


def trailing_windows(df: DataFrame, values, user: str = "user", day: str = "email_day",
                     rows: int = fixed.WINDOW_ROWS, output: str = "window") -> DataFrame:
    """Add an array of the last `rows` rows of the user (null until there are enough).

    Consecutive active rows, not calendar days. Input is unique on (user, day), so a
    user has at most one row per calendar day.
    """
    frame = Window.partitionBy(user).orderBy(day).rowsBetween(1 - rows, 0)
    window = F.collect_list(F.array(*values)).over(frame)
    return df.withColumn(output, window).withColumn(
        output, F.when(F.size(output) == rows, F.col(output)))


def scaled_windows(user_days: DataFrame, features, split: str = "dataset_split",
                   rows: int = fixed.WINDOW_ROWS) -> DataFrame:
    """Add `window`: trailing windows of features scaled by the ranges of train rows."""
    ranges = fit_ranges(user_days.where(F.col(split) == "train"), features, null_as_zero=True)
    return trailing_windows(user_days, scaled_features(features, ranges), rows=rows)


def fit_reconstruction(train_windows: DataFrame, dimension: int, latent: int = 32):
    """Linear autoencoder: centring and the leading `latent` components.

    Both fits are tree aggregations of a fixed-size summary (a mean, a covariance).
    """
    vectors = train_windows.select(array_to_vector(F.flatten("window")).alias("x"))
    return Pipeline(stages=[
        StandardScaler(inputCol="x", outputCol="centered", withMean=True, withStd=False),
        PCA(inputCol="centered", outputCol="latent", k=min(latent, dimension)),
    ]).fit(vectors)


def reconstruction_error(windows: DataFrame, model, dimension: int, output: str = "lstm_raw_error") -> DataFrame:
    """Mean squared reconstruction error per window; null without a full window.

    The components are orthonormal, so the error is (|x|^2 - |z|^2) / dimension.
    """
    zero = F.array_repeat(F.lit(0.0), dimension)
    flat = F.coalesce(F.flatten("window"), zero)
    projected = model.transform(windows.withColumn("x", array_to_vector(flat)))

    def squared(c: str):
        return F.aggregate(vector_to_array(c), F.lit(0.0), lambda acc, v: acc + v * v)

    error = F.greatest(squared("centered") - squared("latent"), F.lit(0.0)) / F.lit(float(dimension))
    return projected.withColumn(output, F.when(F.col("window").isNotNull(), error)).drop(
        "window", "x", "centered", "latent")


def score_errors(errors: DataFrame, raw: str = "lstm_raw_error", score: str = "lstm_score",
                 flag: str = "lstm_flag", label: str = "lstm_risk_severity",
                 split: str = "dataset_split") -> DataFrame:
    """Score, flag and severity from the p95 / p99 errors of train windows.

    A user's train rows come first, so a train window is one that ends on a train row.
    The flag (score >= 0.5) and the severity (error thresholds) may disagree.
    """
    train = errors.where((F.col(split) == "train") & F.col(raw).isNotNull())
    cuts = fit_quantiles(train, raw, [0.95, 0.99])
    scored = errors.withColumn(score, error_score(raw, *cuts))
    return scored.withColumns({flag: at_least(score, 0.5), label: severity(raw, *cuts)})


def score_windows(user_days: DataFrame, features=fixed.BEHAVIOR_FEATURES, latent: int = 32,
                  rows: int = fixed.WINDOW_ROWS) -> DataFrame:
    """Fit on train windows and score every user-day. `user_days` is a stored table.

    The windows are stored, so that the two fits and the scoring do not each sort every user.
    """
    features = list(features)
    dimension = rows * len(features)
    windows = stage(scaled_windows(user_days, features, rows=rows), "scaled-windows")
    train = windows.where((F.col("dataset_split") == "train") & F.col("window").isNotNull())
    model = fit_reconstruction(train, dimension, latent)
    errors = stage(reconstruction_error(windows, model, dimension), "window-errors")
    return score_errors(errors)
