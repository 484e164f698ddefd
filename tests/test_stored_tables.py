"""Late days, carried ids, bucketed joins, run summary, binned intervals, sketches and the native tree walk."""

import random
from datetime import date, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardlight.operators import carried, clean, features, forest, sketches, truth
from wardlight.sources import layout, sinks
from wardlight.sources.summary import RunSummary, rows_and_days

ROWS = "id string, date timestamp, day date, n int"


def day_rows(spark, rows):
    return spark.createDataFrame([(i, datetime(2024, 1, d, h), date(2024, 1, d), n) for i, d, h, n in rows], ROWS)


def test_late_rows_touch_only_their_days(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.write_by_day(day_rows(spark, [("a", 1, 5, 1), ("b", 2, 5, 2), ("c", 3, 5, 3)]), path)
    before = {f for f in (tmp_path / "t" / "day=2024-01-03").iterdir()}
    late = day_rows(spark, [("d", 1, 4, 4), ("b", 2, 3, 9), ("e", 4, 1, 5)])
    for _ in range(2):
        sinks.merge_late(late, path, "id", order="date")
        got = sorted((r["id"], r["day"].day, r["n"]) for r in spark.read.parquet(path).collect())
        assert got == [("a", 1, 1), ("b", 2, 9), ("c", 3, 3), ("d", 1, 4), ("e", 4, 5)]
    assert {f for f in (tmp_path / "t" / "day=2024-01-03").iterdir()} == before


def test_two_runs_take_each_id_once(spark):
    rng = random.Random(3)
    rows = [(str(rng.randrange(400)), datetime(2024, 1, 1 + i % 20)) for i in range(1200)] + [(None, datetime(2024, 1, 1))] * 2
    df = spark.createDataFrame(rows, "id string, date timestamp")
    taken = carried.Carried(words=2)
    parts = [taken.take(df.where("day(date) <= 9"), "id", "date"), taken.take(df, "id", "date"), taken.take(df, "id", "date")]
    ids = [r["id"] for p in parts for r in p.collect()]
    assert len(ids) == len(set(ids)) and set(ids) == {i for i, _ in rows} and parts[2].count() == 0 and parts[1].count() > 0
    assert taken.seen.count() == len(ids)


def test_filter_never_loses_an_id(spark):
    ids = spark.range(5000).select(F.col("id").cast("string"))
    held = carried.merged(carried.membership(ids.where("id < 2500"), "id", 3), carried.membership(ids.where("id >= 2500"), "id", 3))
    spot = carried._spot("id", 3)
    hit = ids.union(spark.range(10**6, 10**6 + 5000).select(F.col("id").cast("string"))).withColumn("word", F.bitmap_bucket_number(spot)).join(held, "word").select(
        "id", carried._bit(F.col("bits"), F.bitmap_bit_position(spot)).alias("bit"))
    found = {r["id"]: r["bit"] for r in hit.collect()}
    assert all(found[str(i)] == 1 for i in range(5000)) and sum(found[str(10**6 + i)] for i in range(5000)) < 500


def test_stored_user_days_join_without_exchange(spark):
    keys = ("user", "email_day")
    days = spark.range(300).select((F.col("id") % 30).alias("user"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") / 30).cast("int")).alias("email_day"), "id")
    size = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        tables = [layout.store_bucketed(days.withColumnRenamed("id", n), f"days-{n}", keys, keys, 4) for n in ("a", "b", "c")]
        joined = features.join_user_days(*tables)
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        assert sorted(r["a"] for r in joined.collect()) == list(range(300)) and joined.where("a <> b OR b <> c").count() == 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", size)


def test_summary_counts_as_it_writes(spark, tmp_path):
    summary = RunSummary()
    df = day_rows(spark, [("a", 1, 5, 1), ("b", 2, 5, 2), ("c", 2, 5, 3)])
    sinks.write_by_day(df, str(tmp_path / "t"), watch=lambda x: summary.watched("log", x, **rows_and_days("day")))
    sinks.write_table(summary.watched("empty", df.where("n > 9"), rows=F.count(F.lit(1))), str(tmp_path / "e"))
    assert summary.rows() == [("log", "rows", "3"), ("log", "first", "2024-01-01"), ("log", "last", "2024-01-02"), ("empty", "rows", "0")]


@pytest.mark.parametrize("bins", [1, 5, 64])
def test_binned_intervals(spark, bins):
    rng = random.Random(bins)
    start = datetime(2023, 12, 20)
    intervals = [(rng.choice("abc"), start + timedelta(days=rng.randrange(120), hours=3), None) for _ in range(25)]
    intervals = [(u, s, s + timedelta(days=rng.randrange(-3, 30), hours=rng.randrange(24))) for u, s, _ in intervals]
    intervals += [("a", None, start), ("b", start, None), (None, start, start), ("c", datetime(1969, 12, 1), datetime(1970, 1, 5))]
    rows = [(u, (start + timedelta(days=d)).date()) for u in "abcd" for d in range(0, 160, 3)] * 2 + [("a", None), (None, start.date()), ("c", date(1969, 12, 31))]
    got = truth.label_days(spark.createDataFrame(rows, "user string, email_day date"), spark.createDataFrame(intervals, "user string, start timestamp, end timestamp"), bin_days=bins)
    hit = lambda u, d: int(any(u is not None and u == v and d and s and e and s.date() <= d <= e.date() for v, s, e in intervals))
    assert sorted(((r["user"], r["email_day"], r["is_insider"]) for r in got.collect()), key=str) == sorted(((u, d, hit(u, d)) for u, d in rows), key=str)


def test_sketches_of_days_merge(spark):
    rng = np.random.default_rng(2)
    values = np.concatenate([rng.normal(size=6000), rng.exponential(9, 4000)])
    df = spark.createDataFrame([(int(i % 9), float(v)) for i, v in enumerate(values)] + [(3, None), (3, float("nan"))], "day int, v double")
    daily = sketches.day_sketches(df, "v", "day")
    row = sketches.thresholds(daily, (0.05, 0.5, 0.95, 0.99)).first()
    assert row["rows"] == len(values)
    for i, q in enumerate((0.05, 0.5, 0.95, 0.99)):
        assert abs((values <= row[f"q{i}"]).mean() - q) <= sketches.RANK_ERROR
    assert sketches.thresholds(daily.where("day > 99"), (0.5,)).count() == 0


def test_native_walk_equals_the_arrow_one(spark):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(i, float(a), float(b) if i % 9 else None) for i, (a, b) in enumerate(rng.normal(size=(400, 2)))], "id int, a double, b double")
    nodes = forest.fit_forest(df, ["id"], ["a", "b"], trees=7, subsample=32).persist()
    one = {r["id"]: r["s"] for r in forest.score_forest(df, nodes, ["a", "b"], 32, "s").collect()}
    two = {r["id"]: r["s"] for r in forest.walk_forest(df, nodes, ["a", "b"], 32, "s").collect()}
    assert one.keys() == two.keys() and all(abs(one[i] - two[i]) < 1e-12 for i in one)
    assert len(set(two.values())) > 100
    assert clean.keep_first(df, "id").count() == 400
