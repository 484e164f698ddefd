"""Weighted risk score, investigation queue, explanations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from wardlight import fixed
from wardlight.functions.scale import clip
from wardlight.operators.scaling import min_max_columns
from wardlight.operators.signals import mark_members
from wardlight.sources.stage import stage

#: raw signal column -> normalised column, in signal order
NORMALIZED: dict[str, str] = {
    "score_p95": "lstm_p95_norm",
    "after_hours_rate": "after_hours_norm",
    "bcc_rate": "bcc_usage_norm",
    "file_exfil_rate": "file_exfil_norm",
    "total_usb": "usb_activity_norm",
    "max_unique_pcs": "multi_pc_norm",
    "sensitivity_share": "content_sensitivity_norm",
}
NORMS: tuple[str, ...] = tuple(f"{s}_norm" for s in fixed.SIGNALS)


def assemble_signals(scores: DataFrame, behavior: DataFrame, sensitivity: DataFrame | None = None) -> DataFrame:
    """Join per-user scores, signals and sensitivity; missing numbers become 0.

    All three are unique per user, so no side of these joins can be skewed.
    """
    signals = behavior.select("user", "employee_name", "after_hours_rate", "bcc_rate",
                              "file_exfil_rate", "total_usb", "max_unique_pcs")
    df = scores.select("user", "score_p95", "dataset_split").join(signals, "user", "left")
    if sensitivity is None:
        df = df.withColumn("content_sensitivity_rate", F.lit(0.0))
    else:
        df = df.join(sensitivity.select("user", "content_sensitivity_rate"), "user", "left")
    numbers = ["score_p95", "after_hours_rate", "bcc_rate", "file_exfil_rate", "total_usb",
               "max_unique_pcs", "content_sensitivity_rate"]
    return df.na.fill(0, subset=numbers).withColumns({
        "employee_name": F.coalesce("employee_name", F.col("user").cast("string")),
        "sensitivity_share": clip(F.col("content_sensitivity_rate") / 3.0, 0.0, 1.0),
    })


def weighted_sum(weights: dict[str, float]) -> Column:
    total = None
    for signal in fixed.SIGNALS:
        term = F.lit(float(weights[signal])) * F.col(f"{signal}_norm")
        total = term if total is None else total + term
    return total


def risk_scores(signals: DataFrame, insiders: DataFrame | None = None,
                weights: dict[str, float] | None = None) -> DataFrame:
    """Add the seven normalised signals and `risk_score`.

    `signals` comes from :func:`assemble_signals`; it is stored first because the
    ranges and the scores both read it.
    """
    table = stage(signals, "user-signals")
    scored = min_max_columns(table, NORMALIZED).drop("sensitivity_share")
    scored = scored.withColumn("risk_score", weighted_sum(weights or fixed.WEIGHTS))
    return mark_members(scored, insiders) if insiders is not None else scored


def explain(risk: DataFrame, thresholds: dict[str, float] | None = None) -> DataFrame:
    """Add `flags` (array of sentences) and `explanation` (joined by '; ')."""
    limits = thresholds or fixed.THRESHOLDS
    raised = F.array_compact(F.array(*[
        F.when(F.col(f"{s}_norm") >= limits[s], F.lit(fixed.FLAG_TEXTS[s])) for s in fixed.SIGNALS]))
    flags = F.when(F.size(raised) == 0, F.array(F.lit(fixed.NO_FLAG_TEXT))).otherwise(raised)
    return risk.withColumn("flags", flags).withColumn("explanation", F.array_join("flags", "; "))


def ranked(df: DataFrame, n: int, by: str, rank: str, user: str = "user") -> DataFrame:
    """The top `n` rows by `by` with a 1-based rank; ties go to the smaller user.

    A distributed top-n runs first, the rank is numbered on those n rows only.
    """
    order = [F.col(by).desc(), F.col(user).asc()]
    return df.orderBy(*order).limit(n).withColumn(rank, F.row_number().over(Window.orderBy(*order)))


def investigation_queue(risk: DataFrame, n: int = 50) -> DataFrame:
    """Top-n users by risk with the columns an investigator reads."""
    columns = ["user", "employee_name", "risk_score", *NORMS]
    columns += [c for c in ("is_insider", "explanation") if c in risk.columns]
    return ranked(risk.select(*columns), n, "risk_score", "priority_rank").select("priority_rank", *columns)


def suspicious_users(risk: DataFrame, pool: DataFrame, score: str, k: int) -> DataFrame:
    """Risk rows of the top-k users of a model ranking, with both ranks.

    `pool` is the filtered user table of the model. Both sides are cut to k rows
    before they meet.
    """
    top = ranked(pool.select("user", score), k, score, "model_rank").select("user", "model_rank")
    rows = risk.join(top, "user")
    order = Window.orderBy(F.col("risk_score").desc(), F.col("user").asc())
    return rows.withColumn("risk_rank", F.row_number().over(order))


def signal_breakdown(risk: DataFrame, thresholds: dict[str, float] | None = None) -> DataFrame:
    """Long form (user, signal, value, threshold, over, median_threshold)."""
    limits = thresholds or fixed.THRESHOLDS
    named = risk.select("user", *[F.col(n).alias(s) for s, n in zip(fixed.SIGNALS, NORMS)])
    rows = named.unpivot("user", list(fixed.SIGNALS), "signal", "value")
    limit = F.lit(None).cast("double")
    for s in fixed.SIGNALS:
        limit = F.when(F.col("signal") == s, float(limits[s])).otherwise(limit)
    ordered = sorted(float(limits[s]) for s in fixed.SIGNALS)
    return rows.withColumn("threshold", limit).withColumns({
        "over": (F.col("value") >= F.col("threshold")).cast("int"),
        "median_threshold": F.lit(ordered[len(ordered) // 2])})


def compare_weights(active: DataFrame) -> DataFrame:
    """Default against active weight of each signal."""
    defaults = active.sparkSession.createDataFrame(
        [(i, s, fixed.WEIGHTS[s]) for i, s in enumerate(fixed.SIGNALS)],
        "position int, signal string, default_weight double")
    joined = defaults.join(active.select("signal", F.col("weight").alias("active_weight")), "signal", "left")
    joined = joined.withColumn("active_weight", F.coalesce("active_weight", "default_weight"))
    return joined.withColumn("delta", F.col("active_weight") - F.col("default_weight")).drop("position")
