"""Shapes of physical plans that keep the operators fit for large data."""

import re

import pytest
from conftest import SF_DIR
from pyspark.sql import functions as F

from wardlight.operators import clean, features, search, signals, splits
from wardlight.plans import roles
from wardlight.plans.registry import QUERIES


def plan(df, capsys):
    capsys.readouterr()
    df.explain("formatted")
    return capsys.readouterr().out


def shuffles(text):
    return len(re.findall(r"^\(\d+\) Exchange$", text, flags=re.M))


def test_dedupe_cuts_copies_before_the_shuffle(spark, capsys):
    text = plan(clean.keep_first(roles.table(spark, SF_DIR, "events"), "props", "ts").select("event_id"), capsys)
    assert text.count("WindowGroupLimit") >= 2 and shuffles(text) == 1


def test_unused_text_is_not_shuffled_by_dedupe(spark, capsys):
    raw = roles.raw_emails(spark, SF_DIR)
    text = plan(clean.clean_email(raw).select("id", "user"), capsys)
    exchange = re.search(r"\(\d+\) Exchange\nInput \[\d+\]: \[(.*?)\]", text).group(1)
    assert "content" not in exchange


def test_user_days_need_two_shuffles_and_splits_one_more(spark, capsys):
    logs = [roles.logons(spark, SF_DIR), roles.devices(spark, SF_DIR), roles.files(spark, SF_DIR)]
    mails = roles.activity(spark, SF_DIR).select(
        "id", "user", F.col("day").alias("email_day"), "pc", "is_after_hours", F.col("cents").alias("size"),
        *[F.lit(1).alias(c) for c in ("attachments", "has_attachment", "total_recipient_count", "has_cc", "has_bcc",
                                      "content_length_words")])
    days = features.behavior_user_day(mails, *logs)
    assert shuffles(plan(days, capsys)) == 2
    assert shuffles(plan(splits.split_by_user(days), capsys)) == 3


def test_scans_are_pruned_and_filtered(spark, capsys):
    text = plan(features.device_user_day(roles.devices(spark, SF_DIR)), capsys)
    assert "In(event_type, [click,view])" in text
    assert "value" not in re.search(r"ReadSchema: (.*)", text).group(1)


def test_no_python_outside_the_models(spark, capsys):
    for name in ("clean_email", "user_day_features", "sensitivity_daily", "risk_queue", "eval_grid", "day_eval"):
        text = plan(QUERIES[name](spark, SF_DIR), capsys)
        assert "Python" not in text and "Pandas" not in text, name
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name


def test_search_ranks_few_rows_per_task(spark, capsys):
    users = spark.createDataFrame([("a", 0, *[0.1] * 7)], "user string, is_insider int, " + ", ".join(
        f"{n} double" for n in search.NORMS))
    text = plan(search.fitness(users, [(0, search.BASELINE)], 5), capsys)
    assert "WindowGroupLimit" in text and "MapInPandas" in text and "CartesianProduct" not in text


def test_small_sides_are_broadcast_by_size_only(spark, capsys):
    days = roles.activity(spark, SF_DIR).select("user", "day").distinct()
    marked = signals.mark_members(days, roles.insiders(spark, SF_DIR))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "BroadcastHashJoin" not in plan(marked, capsys)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
