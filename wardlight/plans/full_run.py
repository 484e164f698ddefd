"""From raw logs to a ranked, explained and evaluated queue.

Each step reads stored tables and writes stored tables under `out`, so a run can be
resumed at any step and every log is scanned once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from wardlight import fixed, schemas
from wardlight.operators import (clean, features, forest, metrics, reports, risk, search, sensitivity,
                                 signals, splits, topk, truth, windows)
from wardlight.sources import readers, sinks
from wardlight.sources.summary import RunSummary, distinct_users, rows_and_days, split_rows


def clean_logs(spark: SparkSession, raw: dict[str, str], out: str, attachments: str = "paths",
               multiline: tuple[str, ...] = ("email",), summary: RunSummary | None = None) -> None:
    """Clean every given source into `out/cleaned/<source>`; counters are gathered in `summary` on the way.

    `raw` maps source names to CSV paths; email and psychometric must exist, the rest
    may be absent. Sources in `multiline` hold quoted newlines and are read file by
    file; the others are split.
    """
    readers.require_inputs(spark, {s: raw.get(s, f"<{s} not given>") for s in schemas.REQUIRED_SOURCES})
    cleaned = f"{out}/cleaned"
    email = clean.clean_email(readers.read_csv(spark, raw["email"], tolerant=True, multiline="email" in multiline), attachments)
    summary = summary or RunSummary()
    rows = {"rows": F.count(F.lit(1))}
    sinks.write_by_day(email, f"{cleaned}/email", "email_day", lambda df: summary.watched("email", df, **rows_and_days("email_day")))
    people = readers.read_csv(spark, raw["psychometric"], multiline="psychometric" in multiline)
    sinks.write_table(summary.watched("psychometric", clean.clean_psychometric(people), **rows), f"{cleaned}/psychometric")
    cutoffs = splits.date_cutoffs(spark.read.parquet(f"{cleaned}/email").select("email_day"))
    logs = {"logon": (schemas.LOGON, clean.clean_logon), "device": (schemas.DEVICE, clean.clean_device),
            "file": (schemas.FILE, clean.clean_file)}
    for source, (columns, cleaner) in logs.items():
        table = cleaner(readers.read_optional_csv(spark, raw.get(source), columns, multiline=source in multiline))
        sinks.write_by_day(splits.split_by_date(table, cutoffs), f"{cleaned}/{source}",
                           watch=lambda df, s=source: summary.watched(s, df, **rows_and_days("day"), **split_rows()))
    dimensions = {"users": (schemas.USERS, clean.clean_users), "decoy_file": (schemas.DECOY, clean.clean_decoy)}
    for source, (columns, cleaner) in dimensions.items():
        table = readers.read_optional_csv(spark, raw.get(source), columns, multiline=source in multiline)
        sinks.write_table(summary.watched(source, cleaner(table), **rows), f"{cleaned}/{source}")


def build_user_days(spark: SparkSession, out: str, summary: RunSummary | None = None) -> DataFrame:
    """Totals of all logs per user-day, then the feature table; counters are gathered in `summary`."""
    read = lambda source: spark.read.parquet(f"{out}/cleaned/{source}")
    logs = {k: read(k) for k in ("email", "logon", "device", "file")}
    return merge_user_days(spark, out, logs, read("psychometric"), summary)


def merge_user_days(spark: SparkSession, out: str, logs: dict[str, DataFrame], people: DataFrame,
                    summary: RunSummary | None = None) -> DataFrame:
    summary = summary or RunSummary()
    totals = summary.watched("user_day_totals", features.all_user_days(**logs),
                             **{f"{k}_user_days": F.count_if(f"has_{k}") for k in logs})
    sinks.write_table(totals, f"{out}/user_day_totals")
    days = features.email_days(spark.read.parquet(f"{out}/user_day_totals"))
    merged = features.add_traits(splits.split_by_user(days, place="__place"), people)
    seen = summary.watched("user_days", merged, rows=F.count(F.lit(1)), users=distinct_users("__place"),
                           trait_matches=F.count("o"), **split_rows())
    sinks.write_table(seen.drop("__place"), f"{out}/user_days")
    return spark.read.parquet(f"{out}/user_days")


def score_sensitivity(spark: SparkSession, out: str) -> DataFrame:
    """Daily sensitivity of email and file events."""
    read = lambda source: spark.read.parquet(f"{out}/cleaned/{source}")
    email, file = read("email"), read("file")
    daily = sensitivity.sensitivity_daily(sensitivity.score_email(email), sensitivity.score_file(file))
    sinks.write_table(daily, f"{out}/sensitivity_day")
    return spark.read.parquet(f"{out}/sensitivity_day")


def score_models(spark: SparkSession, out: str) -> tuple[DataFrame, DataFrame]:
    """Forest and window scores of every user-day, with summaries."""
    days = features_table(spark, out)
    sinks.write_table(forest.score_user_days(days), f"{out}/forest_scored")
    sinks.write_table(windows.score_windows(days), f"{out}/window_scored")
    forest_scored = spark.read.parquet(f"{out}/forest_scored")
    window_scored = spark.read.parquet(f"{out}/window_scored")
    sinks.write_report({
        "forest": reports.severity_summary(forest_scored, "risk_severity", "iforest_score"),
        "window": reports.severity_summary(window_scored, "lstm_risk_severity", "lstm_score"),
    }, f"{out}/model_summary")
    return forest_scored, window_scored


def features_table(spark: SparkSession, out: str) -> DataFrame:
    days = spark.read.parquet(f"{out}/user_days")
    return readers.require_columns(days, [*fixed.FOREST_FEATURES, "dataset_split"], "user-day table")


def rank_users(spark: SparkSession, out: str, insiders: DataFrame | None = None,
               weights: DataFrame | None = None) -> DataFrame:
    """Explained risk of every user from the stored scores; `weights` from a search."""
    determined = spark.read.parquet(f"{out}/window_scored").where("lstm_risk_severity <> 'undetermined'")
    scores = signals.user_scores(determined, "lstm_score")
    behavior = signals.behavior_signals(spark.read.parquet(f"{out}/forest_scored"))
    user_sensitivity = sensitivity.sensitivity_user(spark.read.parquet(f"{out}/sensitivity_day"))
    chosen, limits = fixed.WEIGHTS, fixed.THRESHOLDS
    if weights is not None:
        rows = readers.load_weights(weights).collect()  # seven rows
        chosen = {r["signal"]: r["weight"] for r in rows}
        limits = {r["signal"]: r["threshold"] for r in rows}
    assembled = risk.assemble_signals(scores, behavior, user_sensitivity)
    return risk.explain(risk.risk_scores(assembled, insiders, chosen), limits)


def evaluate(spark: SparkSession, out: str, key: DataFrame) -> dict[str, DataFrame]:
    """Day-level, user-level and top-K evaluation of both models against an answer key."""
    tables = {"forest": ("iforest_score", "risk_severity"), "window": ("lstm_score", "lstm_risk_severity")}
    scored = {m: spark.read.parquet(f"{out}/{m}_scored") for m in tables}
    users = readers.scored_users(*scored.values())
    labels, insiders = truth.day_labels(key, users), truth.labelled_users(key, users)
    report, per_user = {}, []
    for model, (score, severity) in tables.items():
        report[f"{model}_day_test"] = metrics.day_metrics(scored[model], labels, score, severity)
        report[f"{model}_user_all"] = metrics.user_max_metrics(scored[model], insiders, score, severity)
        determined = scored[model].where(F.col(severity) != "undetermined")
        per_user.append(signals.user_scores(determined, score, insiders).withColumn("model", F.lit(model)))
    report["ground_truth"] = truth.describe_release(truth.release_matches(key, users), users)
    sinks.write_report(report, f"{out}/evaluation_report")
    sinks.write_table(per_user[0].unionByName(per_user[1]), f"{out}/user_scores")
    grid = topk.evaluation_grid(spark.read.parquet(f"{out}/user_scores"), insiders)
    sinks.write_table(grid, f"{out}/eval_grid")
    return {**report, "grid": spark.read.parquet(f"{out}/eval_grid")}


def search_weights(spark: SparkSession, out: str, insiders: DataFrame, population: int | None = None,
                   generations: int | None = None, seed: int = 42) -> DataFrame:
    """Search weights and thresholds; writes the weight table, the history and a comparison."""
    sinks.write_table(rank_users(spark, out, insiders).select("user", "is_insider", *risk.NORMS),
                      f"{out}/search_users")
    users = spark.read.parquet(f"{out}/search_users")
    found = search.run_search(users, population or fixed.SEARCH["population"],
                              generations or fixed.SEARCH["generations"], seed)
    sinks.write_table(search.weights_table(spark, found.best), f"{out}/weights")
    sinks.write_report({"search": search.compare_with_baseline(users, found.best)}, f"{out}/search_report")
    history = spark.createDataFrame(found.history, "generation int, best_fitness double, mean_fitness double")
    sinks.write_table(history, f"{out}/search_history")
    return spark.read.parquet(f"{out}/weights")


def run_all(spark: SparkSession, raw: dict[str, str], out: str, key_path: str | None = None,
            attachments: str = "paths", multiline: tuple[str, ...] = ("email",)) -> DataFrame:
    """The whole run; returns the stored investigation queue."""
    summary = RunSummary()
    clean_logs(spark, raw, out, attachments, multiline, summary)
    build_user_days(spark, out, summary)
    sinks.write_table(summary.table(spark), f"{out}/run_summary")
    score_models(spark, out)
    score_sensitivity(spark, out)
    insiders, weights = None, None
    if key_path is not None:
        key = readers.read_csv(spark, key_path)
        users = readers.scored_users(spark.read.parquet(f"{out}/forest_scored"))
        sinks.write_table(truth.labelled_users(key, users), f"{out}/insiders")
        insiders = spark.read.parquet(f"{out}/insiders")
        evaluate(spark, out, key)
        weights = search_weights(spark, out, insiders)
    table = rank_users(spark, out, insiders, weights)
    sinks.write_table(table, f"{out}/risk")
    sinks.write_table(risk.investigation_queue(spark.read.parquet(f"{out}/risk")), f"{out}/queue")
    return spark.read.parquet(f"{out}/queue")
