"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default: all cores).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "clean_email", "clean_logon", "dedupe_first", "email_user_day", "logon_user_day", "user_day_features", "user_split",
    "keyword_tier", "email_sensitivity", "file_sensitivity", "sensitivity_daily", "window_7row", "exact_quantiles",
    "minmax_severity", "error_to_score", "user_scores", "behavior_signals", "risk_queue", "explain",
    "truth_days", "day_eval", "user_eval", "eval_grid", "candidate_fitness", "weight_search",
    "iforest_scores", "recon_scores", "stream_user_day", "stream_sensitivity",
)


def short_messages(spark, folder: str) -> tuple[int, float]:
    """Score every paragraph as an email and aggregate per day, with the default rules."""
    from pyspark.sql import functions as F

    from wardlight.operators import sensitivity
    from wardlight.sources.stage import stage

    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "source", "text")
    table = stage(docs.select(
        F.col("source").alias("user"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 30).cast("int")).alias("email_day"),
        F.explode(F.split("text", "\n")).alias("content")), "messages")
    rows = table.count()
    begin = time.perf_counter()
    sensitivity.sensitivity_daily(sensitivity.score_email(table)).write.format("noop").mode("overwrite").save()
    return rows, time.perf_counter() - begin


def main() -> None:
    from pyspark.sql import SparkSession

    from wardlight.plans.registry import QUERIES

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    spark.read.parquet(f"{folder}/events.parquet").groupBy("event_type").count().collect()  # start the engine
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        begin = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - begin, 3)
    documents = spark.read.parquet(f"{folder}/documents.parquet").count()
    rows, took = short_messages(spark, folder)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": folder.rsplit("sf", 1)[-1],
        # every document is scored once as an email and once as a file event
        "sensitivity_rows_per_sec": round(2 * documents / seconds["sensitivity_daily"], 1),
        # default rules on message-sized rows (every paragraph of every document)
        "short_message_rows": rows, "short_message_rows_per_sec": round(rows / took, 1),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
