import datetime as dt
import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from wardlight import fixed
from wardlight.operators import (forest, metrics, order_stats, reports, risk, scaling, search, sensitivity,
                                 signals, topk, truth, windows)
from wardlight.sources.stage import stage

DAY0 = dt.date(2010, 1, 1)


def day(i):
    return DAY0 + dt.timedelta(days=i)


def test_event_scores(make):
    mail = make([("u", day(0), "draft", 501, 1), ("u", day(0), "draft", 501, 0), ("u", day(0), "draft", 500, 1),
                 ("u", day(0), "password", 501, 1), ("v", day(0), "hello", 501, 1), ("w", day(0), "hello", 1, 1)],
                "user string, email_day date, content string, content_length_words int, has_attachment int")
    got = sorted((r.user, r.event_score) for r in sensitivity.score_email(mail).collect())
    assert got == [("u", 1), ("u", 1), ("u", 2), ("u", 3), ("v", 1), ("w", 0)]
    rows = [("a.exe", "", 1, 1, 0, 3), ("a.jpg", "", 1, 1, 0, 2), ("a.jpg", "", 0, 1, 0, 1), ("a.jpg", "", 0, 0, 1, 1),
            ("a.jpg", "", 0, 0, 0, 0), ("a.txt", "4D-5A", 0, 0, 0, 3), ("a.jpg", "25-50-44-46-2D", 0, 0, 0, 2),
            ("a.exe", "", 0, 1, 0, 3), ("x", None, 0, 0, 0, 1), ("a.txt", "salary", 0, 0, 0, 2)]
    files = make(rows, "filename string, content string, is_write int, to_removable_media int, from_removable_media int, want int")
    assert files.where(sensitivity.file_event_score(files) != F.col("want")).collect() == []


def test_sensitivity_day_and_user(make):
    events = make([("u", day(0), 1), ("u", day(0), 3), ("u", day(0), 2), ("u", day(0), 0), ("u", day(1), 1), ("u", day(2), 0)],
                  "user string, email_day date, event_score int")
    daily = sensitivity.sensitivity_daily(events)
    got = {r.email_day: r for r in daily.collect()}
    assert tuple(got[day(0)])[2:] == (2.0, 3, 2, 1, "RESTRICTED")
    assert got[day(1)].top_sensitivity_label == "INTERNAL" and day(2) not in got
    assert tuple(sensitivity.sensitivity_user(daily).first()) == ("u", 2.0, 2, 1)
    shares = {r.label: (r.user_days, r.percent) for r in sensitivity.label_distribution(daily).collect()}
    assert shares == {"PUBLIC": (0, 0.0), "INTERNAL": (1, 50.0), "SENSITIVE": (0, 0.0), "RESTRICTED": (1, 50.0)}


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(values=st.lists(st.sampled_from([0.0, 0.0, 0.25, 1.5, -3.0, 7.125, 9.5]), min_size=1, max_size=40))
def test_quantiles_match_numpy(spark, values):
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    shares = [0.0, 0.5, 0.93, 0.95, 1.0]
    want = pytest.approx(list(np.percentile(values, [100 * p for p in shares])))
    assert order_stats.fit_quantiles(df, "v", shares) == want


def test_quantiles_large_and_grouped(spark):
    df = spark.range(5000).select(
        F.when(F.col("id") % 3 == 0, F.lit(1.0)).otherwise(F.pow(F.hash("id").cast("double") / 1e9, 3)).alias("v"),
        (F.col("id") % 2).alias("g"))
    data = df.toPandas()
    if True:
        want = pytest.approx(list(np.percentile(data.v, [5, 50, 99])))
        assert order_stats.fit_quantiles(df, "v", [.05, .5, .99]) == want
        got = {r.g: [r.q0, r.q1] for r in order_stats.quantiles(df, "v", [.1, .9], by=("g",)).collect()}
        for g, part in data.groupby("g"):
            assert got[g] == pytest.approx(list(np.percentile(part.v, [10, 90])))
    assert order_stats.fit_quantiles(df.where("v > 1e9"), "v", [.5]) == [None]
    assert order_stats.fit_quantiles(df, "v", [.5], approximate=True)[0] == pytest.approx(np.median(data.v), rel=0.1, abs=0.1)


def test_quantiles_with_infinite_values(spark):
    df = spark.createDataFrame([(v,) for v in (1.0, 2.0, 3.0, float("inf"), float("inf"), None)], "v double")
    assert order_stats.fit_quantiles(df, "v", [0.0, 0.25, 0.5, 0.9, 1.0]) == [1.0, 2.0, 3.0, float("inf"), float("inf")]
    df = spark.createDataFrame([(v,) for v in (-0.0, 0.0, float("-inf"), float("-inf"))], "v double")
    assert order_stats.fit_quantiles(df, "v", [0.0, 0.1, 1.0]) == [float("-inf"), float("-inf"), 0.0]


def test_running_sums(spark):
    df = spark.range(3000).select((F.hash("id") % 700).cast("double").alias("v")).groupBy("v").agg(F.count("*").alias("n"))
    table = stage(df, "t")
    if True:
        got = order_stats.running_sums(table, "v", ["n"], descending=True).toPandas()
        got = got.sort_values("v", ascending=False)
        assert (got.n_before.to_numpy() == (got.n.cumsum() - got.n).to_numpy()).all()


def brute_metrics(y, s, p):
    pos, neg = [x for x, t in zip(s, y) if t], [x for x, t in zip(s, y) if not t]
    auc = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg)) if neg else None
    ap, found, seen = 0.0, 0, 0
    for v in sorted(set(s), reverse=True):
        step = sum(t for t, x in zip(y, s) if x == v)
        seen, found = seen + s.count(v), found + step
        ap += step / len(pos) * found / seen
    return auc, ap


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_detection_metrics(spark, seed):
    rng = np.random.default_rng(seed)
    y, s = rng.integers(0, 2, 60).tolist(), np.round(rng.random(60), seed - 1 or 1).tolist()
    p = [int(x > 0.6) for x in s]
    df = spark.createDataFrame(list(zip(y, s, p)), "is_insider int, score double, predicted int")
    r = metrics.detection_metrics(df).first()
    auc, ap = brute_metrics(y, s, p)
    assert (r.roc_auc, r.avg_precision) == (pytest.approx(auc, abs=6e-5), pytest.approx(ap, abs=6e-5))
    assert r.tp == sum(a and b for a, b in zip(y, p)) and r.n_total == 60
    assert r.tp + r.fn == r.n_insiders == sum(y) and r.tn + r.fp == 60 - sum(y)
    flipped = metrics.detection_metrics(df.withColumn("score", -F.col("score"))).first()
    assert flipped.roc_auc == pytest.approx(1 - r.roc_auc, abs=2e-4)
    assert metrics.detection_metrics(df.withColumn("score", F.exp("score") * 3)).first().roc_auc == r.roc_auc


def test_metrics_with_one_class(make):
    df = make([(0, 0.1, 0), (0, 0.2, 1)], "is_insider int, score double, predicted int")
    assert metrics.detection_metrics(df).collect() == []
    r = metrics.detection_metrics(df.withColumn("is_insider", F.lit(1))).first()
    assert r.roc_auc is None and r.avg_precision == 1.0 and r.recall == 0.5


def test_windows_need_seven_rows_and_ignore_gaps(make):
    rows = [(u, day(i * (3 if u == "gap" else 1)), float(i)) for u, n in (("six", 6), ("seven", 7), ("gap", 8)) for i in range(n)]
    df = windows.trailing_windows(make(rows, "user string, email_day date, x double"), [F.col("x")])
    got = df.where("window IS NOT NULL").orderBy("user", "email_day").collect()
    assert [(r.user, [v[0] for v in r.window]) for r in got] == [
        ("gap", [0, 1, 2, 3, 4, 5, 6]), ("gap", [1, 2, 3, 4, 5, 6, 7]), ("seven", [0, 1, 2, 3, 4, 5, 6])]


def user_day_table(spark, users=30, days=40, columns=("a", "b", "c")):
    rng = np.random.default_rng(0)
    rows = [(f"u{u:02d}", day(i), "train" if i < 28 else "val" if i < 34 else "test",
             *[float(x) for x in rng.integers(0, 20, len(columns)) + (200 if (u, i) == (3, 39) else 0)])
            for u in range(users) for i in range(days)]
    schema = "user string, email_day date, dataset_split string, " + ", ".join(f"{c} double" for c in columns)
    return stage(spark.createDataFrame(rows, schema), "table")


def test_reconstruction_matches_numpy(spark):
    df = user_day_table(spark)
    scored = windows.score_windows(df, ["a", "b", "c"], latent=4)
    got = scored.toPandas().sort_values(["user", "email_day"], ignore_index=True)
    data = df.toPandas().sort_values(["user", "email_day"], ignore_index=True)
    train = data[data.dataset_split == "train"]
    x = ((data[["a", "b", "c"]] - train[["a", "b", "c"]].min()) / (train[["a", "b", "c"]].max() - train[["a", "b", "c"]].min())).to_numpy()
    flat = {i: x[i - 6:i + 1].ravel() for i in range(len(data)) if i >= 6 and data.user[i - 6] == data.user[i]}
    fit = np.stack([flat[i] for i in flat if data.dataset_split[i] == "train"])
    mean = fit.mean(axis=0)
    basis = np.linalg.svd(fit - mean, full_matrices=False)[2][:4]
    for i in range(len(data)):
        if i not in flat:
            assert got.lstm_risk_severity[i] == "undetermined" and math.isnan(got.lstm_score[i]) and got.lstm_flag[i] == 0
            continue
        centered = flat[i] - mean
        want = ((centered - basis.T @ (basis @ centered)) ** 2).mean()
        assert got.lstm_raw_error[i] == pytest.approx(want, abs=1e-9)
    assert (got.lstm_risk_severity == "undetermined").sum() == 6 * 30
    errors = got.lstm_raw_error[(got.dataset_split == "train") & got.lstm_raw_error.notna()]
    high = got[got.lstm_raw_error >= np.percentile(errors, 99) + 1e-12]
    assert (high.lstm_risk_severity == "high").all()
    assert got.loc[got.lstm_raw_error.idxmax(), "user"] == "u03"


def test_forest_sampling_is_even_and_bounded(spark):
    df = stage(spark.range(3000).select("id", (F.col("id") % 7).cast("double").alias("x")), "rows")
    drawn = forest.sample_for_trees(df, ["id"], F.array("x"), trees=20, subsample=64, seed=1)
    counts = {r.tree: r["count"] for r in drawn.groupBy("tree").count().collect()}
    assert counts == {t: 64 for t in range(20)}
    few = forest.sample_for_trees(df.where("id < 40"), ["id"], F.array("x"), trees=5, subsample=64)
    assert {r.tree: r["count"] for r in few.groupBy("tree").count().collect()} == {t: 40 for t in range(5)}


def test_forest_scores_match_a_plain_walk(spark):
    df = user_day_table(spark, users=10, days=20)
    nodes = stage(forest.fit_forest(df, ["user", "email_day"], ["a", "b", "c"], trees=15, subsample=32), "nodes")
    tree = {}
    for n in nodes.collect():
        tree.setdefault(n.tree, {})[n.node] = n
    assert max(len(t) for t in tree.values()) <= 2 * 32 - 1

    def depth(row, t):
        node = tree[t][0]
        while node.feature >= 0:
            node = tree[t][node.left if (row.a, row.b, row.c)[node.feature] <= node.threshold else node.right]
        return node.path

    norm = 2 * (math.log(31) + np.euler_gamma) - 2 * 31 / 32
    rows = forest.score_forest(df, nodes, ["a", "b", "c"], 32).collect()
    for r in rows[::7]:
        want = 2 ** (-np.mean([depth(r, t) for t in tree]) / norm)
        assert r.iforest_raw_score == pytest.approx(want)
    again = forest.fit_forest(df.repartition(3), ["user", "email_day"], ["a", "b", "c"], trees=15, subsample=32)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, nodes.collect()))


def test_forest_finds_the_planted_outlier(spark):
    df = user_day_table(spark)
    got = forest.score_user_days(df, ["a", "b", "c"], trees=50)
    # a value far outside the train range ends beside the train extremes: among the top 1%
    planted = got.where(F.col("user") == "u03").where(F.col("email_day") == day(39)).first()
    assert got.where(F.col("iforest_raw_score") > planted.iforest_raw_score).count() < 12
    bounds = got.agg(F.min("iforest_score"), F.max("iforest_score")).first()
    assert 0 <= bounds[0] <= bounds[1] <= 1 and planted.risk_severity == "high" and planted.iforest_flag == 1


def risk_input(spark, users=40):
    rng = np.random.default_rng(5)
    rows = [(f"u{i:02d}", "train", *[float(x) for x in np.round(rng.random(5), 2)], int(rng.integers(1, 9)), float(rng.random() * 3))
            for i in range(users)]
    return spark.createDataFrame(
        rows, "user string, dataset_split string, score_p95 double, after_hours_rate double, bcc_rate double, "
              "file_exfil_rate double, total_usb double, max_unique_pcs int, content_sensitivity_rate double").withColumns({
                  "employee_name": F.col("user"), "sensitivity_share": F.col("content_sensitivity_rate") / 3})


def test_risk_queue_and_explanations(spark):
    inside = spark.createDataFrame([("u01",), ("u07",)], "user string")
    scored = risk.explain(risk.risk_scores(risk_input(spark), inside))
    data = scored.toPandas()
    assert data[list(risk.NORMS)].min().tolist() == [0] * 7 and data[list(risk.NORMS)].max().tolist() == pytest.approx([1] * 7)
    want = sum(fixed.WEIGHTS[s] * data[f"{s}_norm"] for s in fixed.SIGNALS)
    assert data.risk_score.tolist() == pytest.approx(want.tolist())
    assert data.is_insider.sum() == 2
    for _, r in data.iterrows():
        raised = [fixed.FLAG_TEXTS[s] for s in fixed.SIGNALS if r[f"{s}_norm"] >= fixed.THRESHOLDS[s]]
        assert r.explanation == "; ".join(raised or [fixed.NO_FLAG_TEXT])
    queue = risk.investigation_queue(scored, 5).orderBy("priority_rank").collect()
    order = data.sort_values(["risk_score", "user"], ascending=[False, True]).user.tolist()
    assert [r.user for r in queue] == order[:5] and [r.priority_rank for r in queue] == [1, 2, 3, 4, 5]
    rows = {(r.user, r.signal): r for r in risk.signal_breakdown(scored).collect()}
    assert len(rows) == 40 * 7 and rows[("u00", "lstm_p95")].threshold == 0.7


def test_constant_signal_scales_to_zero(spark):
    df = risk_input(spark, 3).withColumn("bcc_rate", F.lit(0.4))
    assert {r.bcc_usage_norm for r in risk.risk_scores(df).collect()} == {0.0}


def test_missing_inputs_become_zero(spark, make):
    scores = make([("a", 0.5, "train"), ("b", 0.1, "test")], "user string, score_p95 double, dataset_split string")
    behavior = make([("a", "Ann", 0.1, 0.2, 0.3, 4, 2)],
                    "user string, employee_name string, after_hours_rate double, bcc_rate double, file_exfil_rate double, "
                    "total_usb int, max_unique_pcs int")
    got = {r.user: r for r in risk.assemble_signals(scores, behavior).collect()}
    assert (got["b"].employee_name, got["b"].total_usb, got["b"].sensitivity_share) == ("b", 0, 0.0)
    assert got["a"].employee_name == "Ann"


def test_user_scores_and_mode_ties(make):
    df = make([("a", 1.0, "val"), ("a", 2.0, "train"), ("a", 5.0, "test"), ("b", None, "test")],
              "user string, score double, dataset_split string")
    got = {r.user: r for r in signals.user_scores(df, "score").collect()}
    assert got["a"].score_p95 == pytest.approx(4.7) and got["a"].dataset_split == "test"
    assert got["b"].score_p95 == 0.0 and got["b"].score_max is None


def test_answer_key(make):
    key = make([("4.2", "a", "1/1/2010 8:00:00", "1/3/2010 1:00:00"), ("4.2", "a", "1/3/2010 8:00:00", "1/4/2010 1:00:00"),
                ("4.20", "b", "/1/2010 8:00:00", "1/3/2010 1:00:00"), ("4.2", "c", "1/5/2010 8:00:00", "1/5/2010 9:00:00"),
                ("4.2", "d", "1/5/2010 8:00:00", "1/4/2010 9:00:00"), ("2", "a", "1/1/2011 8:00:00", "1/1/2011 9:00:00"),
                ("2", "c", "1/1/2011 8:00:00", "1/1/2011 9:00:00")], "dataset string, user string, `start` string, `end` string")
    users = make([("a",), ("c",), ("d",), ("x",)], "user string")
    matches = {r.release: (r.release_users, r.matches) for r in truth.release_matches(key, users).collect()}
    assert matches == {"4.2": (4, 3), "2": (2, 2)}
    assert truth.describe_release(truth.release_matches(key, users), users).first().description == (
        "release 4.2 selected (3/4 labelled users match 4 scored users; matches by release: 2=2, 4.2=3)")
    labels = truth.day_labels(key, users)
    assert sorted((r.user, str(r.email_day)) for r in labels.collect()) == [
        ("a", "2010-01-01"), ("a", "2010-01-02"), ("a", "2010-01-03"), ("a", "2010-01-04"), ("c", "2010-01-05")]
    # equal matches: the larger release wins
    two = make([("a",), ("c",)], "user string")
    assert truth.best_release(truth.release_matches(key, two)).first().release == "4.2"
    assert sorted(r.user for r in truth.labelled_users(key, users).collect()) == ["a", "c", "d"]


def user_table(spark, users=60):
    rng = np.random.default_rng(9)
    rows = [("m", f"u{i:02d}", *[float(x) for x in np.round(rng.random(3), 2)], "train" if i % 4 else "test", int(i % 9 == 0))
            for i in range(users)]
    return stage(spark.createDataFrame(rows, "model string, user string, score_max double, score_mean double, score_p95 double, "
                                             "dataset_split string, is_insider int"), "users")


def test_grid_matches_brute_force(spark):
    users = user_table(spark)
    insiders = users.where("is_insider = 1").select("user")
    data = users.toPandas()
    known = set(data[data.is_insider == 1].user)
    rows = topk.evaluation_grid(users, insiders, percentiles=(50, 90), ks=(3, 20, 100)).collect()
    assert len(rows) == 3 * 2 * 3
    for r in rows:
        cut = np.percentile(data[data.dataset_split == "train"][r.agg], r.thresh_pct)
        pool = data[data[r.agg] >= cut].sort_values([r.agg, "user"], ascending=[False, True])
        actual = min(r.k, len(pool))
        tp = len(set(pool.user[:actual]) & known)
        prec, rec = tp / actual, tp / len(known)
        assert (r.pool, r.actual_k, r.tp, r.fp, r.fn) == (len(pool), actual, tp, actual - tp, len(known) - tp)
        assert (r.cutoff, r.precision, r.recall) == (pytest.approx(cut), pytest.approx(prec), pytest.approx(rec))
        assert r.f1 == pytest.approx(2 * prec * rec / (prec + rec) if tp else 0)
    best = topk.best_overall(spark.createDataFrame(rows)).first()
    assert best.f1 == max(r.f1 for r in rows)
    kept = topk.survivors(users, "score_p95", 90).collect()
    assert [r.score_p95 for r in kept] == sorted((r.score_p95 for r in kept), reverse=True)


def search_table(spark, users=120):
    rng = np.random.default_rng(2)
    rows = [(f"u{i:03d}", int(i % 10 == 0), *[float(x) for x in np.round(rng.random(7), 1)]) for i in range(users)]
    return stage(spark.createDataFrame(rows, "user string, is_insider int, " + ", ".join(f"{n} double" for n in risk.NORMS)), "search")


def brute_fitness(data, genes, k):
    w = np.clip(genes[:7], .01, 1)
    w = w / w.sum()
    score = sum(data[n] * w[i] for i, n in enumerate(risk.NORMS))
    top = data.assign(score=score).sort_values(["score", "user"], ascending=[False, True]).head(k)
    tp = top.is_insider.sum()
    prec, rec = tp / k, tp / data.is_insider.sum()
    cover = (top[list(risk.NORMS)].to_numpy() >= np.clip(genes[7:], .1, .95)).any(axis=1).mean()
    return 0.8 * (2 * prec * rec / (prec + rec) if tp else 0) + 0.2 * cover


@pytest.mark.parametrize("k", [10, 50, 500])
def test_fitness_matches_brute_force(spark, k):
    users = search_table(spark).repartition(3)
    chosen = [(r.cand, r.genes) for r in search.random_candidates(spark, 8).collect()]
    got = {r.cand: r.fitness for r in search.fitness(users, chosen, k).collect()}
    data = users.toPandas()
    for cand, genes in chosen:
        assert got[cand] == pytest.approx(brute_fitness(data, np.array(genes), k))


def test_top_users_survive_heavy_ties(spark):
    rows = [(f"u{i:04d}", 0, *[0.5] * 7) for i in range(400)]
    users = spark.createDataFrame(rows, "user string, is_insider int, " + ", ".join(f"{n} double" for n in risk.NORMS)).repartition(5)
    got = search.best_users(users, [(0, search.BASELINE)], 7).orderBy("rank").collect()
    assert [r.user for r in got] == [f"u{i:04d}" for i in range(7)]


def test_generations(spark):
    start = search.random_candidates(spark, 12, seed=3).collect()
    assert start[0].genes == search.BASELINE and len(start) == 12
    for r in start:
        assert all(.01 <= g <= 1 for g in r.genes[:7]) and all(.10 <= g <= .95 for g in r.genes[7:])
    scored = spark.createDataFrame([(r.cand, r.genes, float(r.cand % 5)) for r in start], "cand int, genes array<double>, fitness double")
    child = {r.cand: r.genes for r in search.next_generation(scored, 1, 12, seed=3).collect()}
    assert sorted(child) == list(range(12))
    order = sorted(start, key=lambda r: (-(r.cand % 5), r.cand))
    assert [child[i] for i in range(4)] == [r.genes for r in order[:4]]
    for genes in child.values():
        assert all(.01 <= g <= 1 for g in genes[:7]) and all(.10 <= g <= .95 for g in genes[7:])
    users = search_table(spark)
    result = search.run_search(users, population=8, generations=3, seed=3, k=20)
    best = [b for _, b, _ in result.history]
    assert best == sorted(best)  # elites keep the best
    report = search.compare_with_baseline(users, result.best, 20).first()
    assert report.k == 20 and report.delta_f1 == pytest.approx(report.f1 - report.baseline_f1, abs=2e-4)
    table = search.weights_table(spark, result.best).toPandas()
    assert table.weight.sum() == pytest.approx(1, abs=1e-5)


def test_reports(make, spark):
    df = make([("a", day(0), 0.0, 0), ("a", day(1), 1.0, 0), ("b", day(0), 0.5, 0), ("b", day(1), 0.6, 1), ("c", day(1), None, 1)],
              "user string, email_day date, score double, cls int")
    bins = {(r.cls, r.bin): (r["count"], r.density) for r in reports.histogram(df, "score", 4, "cls").collect()}
    assert bins[(0, 0)] == (1, pytest.approx(1 / (3 * .25))) and bins[(0, 3)][0] == 1 and bins[(0, 2)][0] == 1
    assert bins[(1, 2)][0] == 1  # a single value sits in the middle of a unit span
    assert len(bins) == 8 and bins[(0, 1)][0] == 0
    assert [r.user for r in reports.top_users_by_mean(df, "score", 2).collect()] == ["b", "a"]
    assert [r.score for r in reports.top_rows(df, "score", 2).collect()] == [1.0, 0.6]
    assert {str(r.email_day): r.max_score for r in reports.daily_max(df, "score").collect()} == {"2010-01-01": .5, "2010-01-02": 1.0}
    big = spark.range(20000).select(F.col("id"))
    one = {r.id for r in reports.repeatable_sample(big, ["id"], 100).collect()}
    two = {r.id for r in reports.repeatable_sample(big.repartition(5), ["id"], 100).collect()}
    assert one == two and len(one) == 100
    assert reports.repeatable_sample(big.select((F.col("id") * 0).alias("id")), ["id"], 100).count() == 100


def test_feature_scaler_keeps_distance_on_zero_range(make):
    df = make([(1.0, 5.0), (3.0, 5.0), (None, 7.0)], "a double, b double")
    ranges = scaling.fit_ranges(df.limit(2), ["a", "b"], null_as_zero=True)
    got = df.select(*[c.alias(n) for n, c in zip("ab", scaling.scaled_features(["a", "b"], ranges))]).collect()
    assert [tuple(r) for r in got] == [(0.0, 0.0), (1.0, 0.0), (-0.5, 2.0)]
