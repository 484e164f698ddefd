"""Every registered query: name -> function of (spark, folder) giving a DataFrame."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from wardlight import fixed, schemas
from wardlight.functions import rules, text
from wardlight.operators import (carried, clean, features, forest, metrics, order_stats, reports, risk, scaling,
                                 search, sensitivity, signals, sketches, splits, topk, truth, window_network, windows)
from wardlight.plans import full_run, roles
from wardlight.sources import layout, readers, sinks
from wardlight.sources.stage import shared_root, stage
from wardlight.sources.summary import RunSummary, rows_and_days, split_rows
from wardlight.streaming import logs, pcs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double, so engines that add in another order agree."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# --- cleaning ------------------------------------------------------------------------

@query
def clean_email(spark, folder):
    return clean.clean_email(roles.raw_emails(spark, folder))


@query
def clean_logon(spark, folder):
    return clean.clean_logon(roles.raw_activity(roles.table(spark, folder, "events")))


@query
def clean_device(spark, folder):
    return clean.clean_device(roles.raw_activity(roles.table(spark, folder, "events")))


@query
def clean_file(spark, folder):
    raw = readers.normalize_header(roles.raw_activity(roles.table(spark, folder, "events"))).drop("activity")
    return clean.clean_file(raw)


@query
def clean_traits(spark, folder):
    raw = roles.table(spark, folder, "customer").select(
        F.concat(F.lit("  "), F.replace("c_name", F.lit("#"), F.lit("  # "))).alias("Employee_Name "),
        F.concat(F.lit(" cus"), F.col("c_custkey").cast("string")).alias("user_id"),
        F.when(F.col("c_acctbal") < 0, "x").otherwise(F.col("c_acctbal").cast("string")).alias("O"),
        *[(F.col("c_nationkey") * m).cast("string").alias(t) for t, m in zip("CEAN", (1, 2, 3, 4))])
    return rounded(clean.clean_psychometric(raw))


@query
def clean_users(spark, folder):
    key = F.col("c_custkey")
    raw = roles.table(spark, folder, "customer").select(
        F.concat(F.lit("u"), key.cast("string"), F.lit(" ")).alias("user_id"),
        F.col("c_name").alias("employee_name"),
        F.concat("c_name", F.lit("@Example.COM ")).alias("email"), F.col("c_mktsegment").alias("role"),
        F.when(key % 3 == 0, "p1 ").alias("projects"), F.col("c_nationkey").cast("string").alias("business_unit"),
        F.concat(F.lit("f \t "), F.col("c_mktsegment")).alias("functional_unit"),
        F.lit("d  1").alias("department"), F.lit("t").alias("team"), F.lit(None).cast("string").alias("supervisor"),
        F.when(key % 2 == 0, "2010-03-04").otherwise("3/4/2010").alias("start_date"),
        F.when(key % 7 == 0, "soon").otherwise("12/31/2011 8:00:00").alias("end_date"))
    return clean.clean_users(raw)


@query
def decoy_files(spark, folder):
    raw = roles.table(spark, folder, "pages").select(
        F.concat(F.lit(" "), F.regexp_extract("url", r"^https?://([^/]+)", 1)).alias("Decoy_Filename"),
        F.regexp_extract("url", r"^https?://[^/]+/([a-z]+)", 1).alias("PC"))
    return clean.clean_decoy(raw)


@query
def dedupe_first(spark, folder):
    return clean.keep_first(roles.table(spark, folder, "events"), "props", "ts")


@query
def recipient_counts(spark, folder):
    rows = roles.raw_emails(spark, folder).select("id", *[text.list_size(c).alias(f"{c}_count") for c in ("to", "cc", "bcc")])
    total = F.col("to_count") + F.col("cc_count") + F.col("bcc_count")
    return rows.withColumns({"total_count": total, "has_bcc": (F.col("bcc_count") > 0).cast("int")})


@query
def scored_users(spark, folder):
    return readers.scored_users(roles.activity(spark, folder), roles.emails(spark, folder))


@query
def run_counters(spark, folder):
    a = sinks.table_counters("activity", roles.activity(spark, folder), user="user", date="day")
    return a.unionByName(sinks.table_counters("email", roles.emails(spark, folder), user="user", date="email_day"))


# --- features and splits ---------------------------------------------------------------

@query
def email_user_day(spark, folder):
    return rounded(features.email_user_day(roles.emails(spark, folder)))


@query
def logon_user_day(spark, folder):
    return features.logon_user_day(roles.logons(spark, folder))


@query
def device_user_day(spark, folder):
    return features.device_user_day(roles.devices(spark, folder))


@query
def file_user_day(spark, folder):
    return features.file_user_day(roles.files(spark, folder))


@query
def user_day_features(spark, folder):
    return rounded(roles.user_days(spark, folder))


@query
def user_day_join(spark, folder):
    days = features.join_user_days(
        features.email_user_day(roles.emails(spark, folder)).select("user", "email_day", "email_count"),
        features.logon_user_day(roles.logons(spark, folder)),
        features.device_user_day(roles.devices(spark, folder)),
        features.file_user_day(roles.files(spark, folder)))
    return days


@query
def user_split(spark, folder):
    return roles.day_values(spark, folder)


@query
def date_split(spark, folder):
    events = roles.activity(spark, folder).select("id", "date", "day")
    return splits.split_by_date(events, splits.date_cutoffs(events, "day")).select("id", "dataset_split")


@query
def split_counts(spark, folder):
    return reports.split_ranges(roles.day_values(spark, folder))


# --- sensitivity -------------------------------------------------------------------------

@query
def keyword_tier(spark, folder):
    return roles.planted_text(spark, folder).select("doc_id", rules.keyword_tier("content").alias("tier"))


@query
def keyword_tier_lexicon(spark, folder):
    docs = roles.table(spark, folder, "documents").select("doc_id", "text")
    return docs.select("doc_id", rules.keyword_tier("text", roles.LEXICON).alias("tier"))


@query
def extension_tier(spark, folder):
    tier = rules.extension_tier("filename")
    named = roles.file_events(spark, folder).select("doc_id", "filename", tier.alias("tier"))
    pages = roles.table(spark, folder, "pages").select(
        (-1 - F.col("page_id")).alias("doc_id"), F.col("url").alias("filename"))
    return named.unionByName(pages.withColumn("tier", tier))


@query
def signature_tier(spark, folder):
    return roles.file_events(spark, folder).select(
        "doc_id", rules.signature_tier("content").alias("tier"))


@query
def email_sensitivity(spark, folder):
    scored = sensitivity.score_email(roles.message_events(spark, folder))
    return scored.groupBy("user", "email_day", "event_score").agg(F.count(F.lit(1)).alias("events"))


@query
def file_sensitivity(spark, folder):
    score = sensitivity.file_event_score(roles.file_events(spark, folder))
    return roles.file_events(spark, folder).select("doc_id", score.alias("event_score"))


@query
def sensitivity_daily(spark, folder):
    return roles.daily_sensitivity(spark, folder)


@query
def sensitivity_user(spark, folder):
    return rounded(sensitivity.sensitivity_user(roles.daily_sensitivity(spark, folder)))


@query
def label_distribution(spark, folder):
    return rounded(sensitivity.label_distribution(roles.daily_sensitivity(spark, folder)))


# --- windows, scaling, scores -----------------------------------------------------------

@query
def window_7row(spark, folder):
    framed = windows.trailing_windows(roles.day_values(spark, folder), [F.col("cents")])
    values = F.transform(F.flatten("window"), lambda v: v.cast("long").cast("string"))
    return framed.select("user", "email_day", F.array_join(values, ",").alias("window_values"))


@query
def error_to_score(spark, folder):
    scored = roles.window_scores(spark, folder)
    return rounded(scored.withColumn("error", F.round("error", 2)))


@query
def minmax_severity(spark, folder):
    return rounded(roles.day_scores(spark, folder))


@query
def scaled_features(spark, folder):
    days = stage(roles.user_days(spark, folder), "user-days")
    names = ["email_count", "total_size", "logon_count"]
    ranges = scaling.fit_ranges(days.where("dataset_split = 'train'"), names, null_as_zero=True)
    scaled = scaling.scaled_features(names, ranges)
    return rounded(days.select("user", "email_day", *[c.alias(n) for n, c in zip(names, scaled)]))


@query
def exact_quantiles(spark, folder):
    events = roles.table(spark, folder, "events")
    whole = order_stats.quantiles(events, "value", [0.93, 0.95, 0.99]).withColumn("event_type", F.lit("all"))
    return rounded(whole.unionByName(order_stats.quantiles(events, "value", [0.93, 0.95, 0.99], by=("event_type",))))


@query
def user_scores(spark, folder):
    return rounded(roles.window_user_scores(spark, folder))


@query
def behavior_signals(spark, folder):
    return rounded(signals.behavior_signals(roles.user_days(spark, folder)))


# --- risk ----------------------------------------------------------------------------------

@query
def risk_scores(spark, folder):
    return rounded(roles.risk_table(spark, folder).drop("flags", "explanation"))


@query
def risk_queue(spark, folder):
    queue = risk.investigation_queue(roles.risk_table(spark, folder), 50)
    return rounded(queue)


@query
def explain(spark, folder):
    return roles.risk_table(spark, folder).select("user", "explanation")


@query
def signal_breakdown(spark, folder):
    return rounded(risk.signal_breakdown(roles.risk_table(spark, folder)))


@query
def suspicious_users(spark, folder):
    table = stage(roles.risk_table(spark, folder), "risk")
    pool = topk.survivors(table, "score_p95", 90)
    shown = risk.suspicious_users(table, pool, "score_p95", 20)
    return rounded(shown.select("user", "model_rank", "risk_rank", "risk_score", "score_p95"))


@query
def weight_comparison(spark, folder):
    # six-signal weights measured on the data: mean normalised value of each signal
    means = roles.risk_table(spark, folder).agg(*[F.avg(f"{s}_norm").alias(s) for s in fixed.SIGNALS[:-1]])
    config = means.unpivot([], list(fixed.SIGNALS[:-1]), "signal", "weight").withColumn("threshold", F.lit(0.6))
    return rounded(risk.compare_weights(readers.load_weights(stage(config, "weights"))))


# --- answer key and evaluation ---------------------------------------------------------------

@query
def truth_release(spark, folder):
    key, users = roles.answer_key(spark, folder), roles.key_users(spark, folder)
    return truth.describe_release(truth.release_matches(key, users), users)


@query
def truth_users(spark, folder):
    return truth.labelled_users(roles.answer_key(spark, folder), roles.key_users(spark, folder))


@query
def truth_days(spark, folder):
    return truth.day_labels(roles.answer_key(spark, folder), roles.key_users(spark, folder))


@query
def users_per_release(spark, folder):
    return truth.users_per_release(roles.answer_key(spark, folder))


@query
def day_eval(spark, folder):
    return metrics.interval_metrics(roles.day_scores(spark, folder), roles.labelled_intervals(spark, folder),
                                    "score", "severity")


@query
def user_eval(spark, folder):
    scored = stage(roles.window_scores(spark, folder), "scored")
    return metrics.user_max_metrics(scored, roles.insiders(spark, folder), "score", "severity")


@query
def label_eval(spark, folder):
    docs = roles.table(spark, folder, "documents").select("doc_id", F.col("n_chars").cast("double").alias("score"))
    joined = roles.table(spark, folder, "labels").join(docs, "doc_id").select(
        F.col("quality").alias("is_insider"), "score", (F.col("score") > 1000).cast("int").alias("predicted"))
    return metrics.detection_metrics(joined)


@query
def threshold_survivors(spark, folder):
    users = stage(roles.window_user_scores(spark, folder), "user-scores")
    return rounded(topk.survivors(users, "score_p95", 90))


@query
def eval_grid(spark, folder):
    return rounded(topk.evaluation_grid(roles.model_users(spark, folder), roles.insiders(spark, folder)))


@query
def k_sweep(spark, folder):
    return rounded(topk.evaluation_grid(
        roles.model_users(spark, folder), roles.insiders(spark, folder), aggregations=("score_p95",),
        percentiles=(90,), ks=fixed.SWEEP_KS))


@query
def outcome_counts(spark, folder):
    users = stage(roles.risk_table(spark, folder).select("user", "is_insider", "risk_score"), "outcome-users")
    return topk.outcome_counts(users, "risk_score", fixed.OUTCOME_KS)


@query
def model_comparison(spark, folder):
    grid = topk.evaluation_grid(roles.model_users(spark, folder), roles.insiders(spark, folder),
                                percentiles=(90,), ks=(20, 50))
    shown = ((F.col("model") == "day") & (F.col("agg") == "score_max")) | (
        (F.col("model") == "window") & (F.col("agg") == "score_p95"))
    return rounded(grid.where(shown).select("model", "agg", "k", "precision", "recall", "f1"))


@query
def best_config(spark, folder):
    grid = topk.evaluation_grid(roles.model_users(spark, folder), roles.insiders(spark, folder))
    return rounded(topk.best_overall(grid))


@query
def best_per_aggregation(spark, folder):
    grid = topk.evaluation_grid(roles.model_users(spark, folder), roles.insiders(spark, folder))
    return rounded(topk.best_per_aggregation(grid))


@query
def missed_insiders(spark, folder):
    top = risk.ranked(roles.window_user_scores(spark, folder), 20, "score_p95", "rank")
    return topk.missed_insiders(top, roles.insiders(spark, folder))


# --- reports -----------------------------------------------------------------------------------

@query
def score_histogram(spark, folder):
    return rounded(reports.histogram(roles.window_user_scores(spark, folder), "score_p95", 40, "is_insider"))


@query
def row_histogram(spark, folder):
    return rounded(reports.histogram(roles.day_scores(spark, folder), "score", 50))


@query
def severity_summary(spark, folder):
    return rounded(reports.severity_summary(roles.window_scores(spark, folder), "severity", "score"))


@query
def severity_floors(spark, folder):
    return rounded(reports.severity_floors(roles.day_scores(spark, folder), "severity", "score"))


@query
def daily_max(spark, folder):
    return rounded(reports.daily_max(roles.window_scores(spark, folder), "score"))


@query
def max_per_user(spark, folder):
    return rounded(metrics.max_score_per_user(roles.window_scores(spark, folder), "score"))


@query
def top_users(spark, folder):
    return rounded(reports.top_users_by_mean(roles.day_scores(spark, folder), "score"))


@query
def top_rows(spark, folder):
    return rounded(reports.top_rows(roles.day_scores(spark, folder), "score").drop("cents"))


@query
def timeline(spark, folder):
    return rounded(reports.timelines(stage(roles.day_scores(spark, folder), "scored"), "score"))


@query
def sample(spark, folder):
    return rounded(reports.repeatable_sample(roles.day_values(spark, folder), ["user", "email_day"]))


# --- search --------------------------------------------------------------------------------------

def search_users(spark, folder) -> DataFrame:
    users = roles.risk_table(spark, folder).select("user", "is_insider", *risk.NORMS)
    # Every generation reads this table: one small file would be one task each time.
    return stage(users.repartition(spark.sparkContext.defaultParallelism, "user"), "search-users")


@query
def random_candidates(spark, folder):
    # what the first population makes of the users: the leaders of every candidate
    leaders = search.best_users(search_users(spark, folder), first_candidates(spark), 50)
    return rounded(leaders.select("cand", "rank", "user", "score", "flagged"))


def first_candidates(spark) -> list:
    return [(r["cand"], r["genes"]) for r in search.random_candidates(spark).collect()]  # the population


@query
def candidate_fitness(spark, folder):
    return rounded(search.fitness(search_users(spark, folder), first_candidates(spark), 50))


@query
def bred_generation(spark, folder):
    value = search.fitness(search_users(spark, folder), first_candidates(spark), 50).select(
        "cand", F.round("fitness", 6).alias("fitness"))
    scored = stage(search.random_candidates(spark).join(value, "cand"), "scored-candidates")
    bred = search.next_generation(scored, 1, fixed.SEARCH["population"])
    return rounded(bred.select("cand", F.posexplode("genes").alias("gene", "value")))


@query
def weight_search(spark, folder):
    users = search_users(spark, folder)
    return search.compare_with_baseline(users, search.run_search(users).best)


# --- stored tables ----------------------------------------------------------------------------------

@query
def run_summary(spark, folder):
    """Counters of cleaned logs, user-days and trait matches, gathered while the tables are written."""
    out = f"{shared_root(spark)}/summary-{uuid.uuid4().hex}"
    summary = RunSummary()
    email = roles.emails(spark, folder)
    sinks.write_by_day(email, f"{out}/email", "email_day", lambda df: summary.watched("email", df, **rows_and_days("email_day")))
    cutoffs = splits.date_cutoffs(spark.read.parquet(f"{out}/email").select("email_day"))
    logs = {"logon": roles.logons, "device": roles.devices, "file": roles.files}
    for name, role in logs.items():
        sinks.write_by_day(splits.split_by_date(role(spark, folder), cutoffs), f"{out}/{name}",
                           watch=lambda df, n=name: summary.watched(n, df, **rows_and_days("day"), **split_rows()))
    tables = {name: spark.read.parquet(f"{out}/{name}") for name in ("email", *logs)}
    people = summary.watched("psychometric", roles.traits(spark, folder), rows=F.count(F.lit(1)))
    sinks.write_table(people, f"{out}/psychometric")
    full_run.merge_user_days(spark, out, tables, spark.read.parquet(f"{out}/psychometric"), summary)
    return summary.table(spark)


@query
def late_days(spark, folder):
    """Activity written by day; then rows that came late on two days, sent twice, are merged into those days."""
    path = f"{shared_root(spark)}/days-{uuid.uuid4().hex}"
    rows = roles.activity(spark, folder).select("id", "date", "day", "user", "activity", "cents")
    late = (F.dayofmonth("day") <= 2) & (F.col("id") % 3 == 0)
    sinks.write_by_day(rows.where(~late), path)
    for _ in range(2):
        sinks.merge_late(rows.where(late), path, "id", order="date")
    return spark.read.parquet(path).select(rows.columns)


@query
def carried_ids(spark, folder):
    """The logon log cleaned in two runs of which the second holds the first one's rows again."""
    raw = roles.raw_activity(roles.table(spark, folder, "events"))
    taken = carried.Carried()
    first = taken.take(clean.clean_logon(raw.where(F.col("to_removable_media").isNotNull())), "id", "date")
    second = taken.take(clean.clean_logon(raw), "id", "date")
    return first.unionByName(second)


@query
def bucketed_user_days(spark, folder):
    """User-day tables of the four logs stored by (user, day) and joined without a shuffle of the stored rows."""
    keys = ("user", "email_day")
    store = lambda df, name: layout.store_bucketed(df, name, keys, keys)
    return features.join_user_days(
        store(features.email_user_day(roles.emails(spark, folder)).select(*keys, "email_count"), "email-days"),
        store(features.logon_user_day(roles.logons(spark, folder)), "logon-days"),
        store(features.device_user_day(roles.devices(spark, folder)), "device-days"),
        store(features.file_user_day(roles.files(spark, folder)), "file-days"))


@query
def interval_days(spark, folder):
    """Every user-day with its label, found by intervals cut to bins."""
    marked = truth.label_days(roles.day_values(spark, folder), roles.labelled_intervals(spark, folder), bin_days=8)
    return marked.select("user", "email_day", "is_insider")


@query
def csv_round_trip(spark, folder):
    """Customers written as CSV with quotes, commas and line breaks, and read back as text."""
    rows = roles.table(spark, folder, "customer").select(
        F.col("c_custkey").alias(" C_Custkey"), F.col("c_name").alias("c_name "), F.concat(F.lit('a "quoted", \n'), "c_mktsegment").alias("C_note"))
    path = f"{shared_root(spark)}/csv-{uuid.uuid4().hex}"
    rows.write.options(header=True, quote='"', escape='"').csv(path)
    return readers.read_csv(spark, path, multiline=True)


@query
def csv_tolerant(spark, folder):
    """Lines with too many fields are dropped, short ones padded."""
    key = F.col("c_custkey")
    fields = F.when(key % 7 == 0, F.concat_ws(",", key, "c_name", "c_mktsegment", F.lit("more"))).when(
        key % 5 == 0, F.concat_ws(",", key, "c_name")).otherwise(F.concat_ws(",", key, "c_name", "c_mktsegment"))
    path = f"{shared_root(spark)}/csv-{uuid.uuid4().hex}"
    lines = roles.table(spark, folder, "customer").select(fields.alias("key,name,segment"))
    lines.write.option("header", True).option("sep", "\u0001").csv(path)
    return readers.read_csv(spark, path, tolerant=True).select("key", "name", "segment")


@query
def optional_source(spark, folder):
    """A source that is not there counts as empty."""
    root = f"{shared_root(spark)}/csv-{uuid.uuid4().hex}"
    roles.table(spark, folder, "region").select(F.col("r_name").alias("decoy_filename"), F.col("r_regionkey").alias("pc")).write.option("header", True).csv(root)
    readers.require_inputs(spark, {"decoy": root})
    absent = readers.read_optional_csv(spark, f"{root}-none", schemas.DECOY)
    return absent.unionByName(readers.require_columns(readers.read_optional_csv(spark, root, schemas.DECOY), schemas.DECOY, "decoys"))


@query
def day_partitions(spark, folder):
    """Activity written by day; the days read back are chosen by their folders."""
    path = f"{shared_root(spark)}/days-{uuid.uuid4().hex}"
    sinks.write_by_day(roles.activity(spark, folder), path)
    return spark.read.parquet(path).where(F.col("day") >= F.lit("2024-01-05").cast("date")).select("id", "day", "user", "activity")


@query
def scored_table(spark, folder):
    path = f"{shared_root(spark)}/scored-{uuid.uuid4().hex}"
    sinks.write_table(roles.day_scores(spark, folder), path)
    return rounded(spark.read.parquet(path))


@query
def report_lines(spark, folder):
    """A one-row report written as JSON lines and read back."""
    path = f"{shared_root(spark)}/report-{uuid.uuid4().hex}"
    events = roles.table(spark, folder, "events")
    sinks.write_report({"events": events.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("user_id").alias("users"),
                                             F.countDistinct("event_type").alias("kinds"))}, path)
    return spark.read.schema("section string, metric string, value string").json(path)


@query
def sketch_quantiles(spark, folder):
    """Whether the thresholds from stored daily sketches lie within the stated rank error of the exact ranks."""
    events = roles.table(spark, folder, "events")
    shares = (0.01, 0.25, 0.5, 0.93, 0.95, 0.99)
    daily = stage(sketches.day_sketches(events.withColumn("day", F.to_date("ts")), "value", "day"), "day-sketches")
    found = sketches.thresholds(daily, shares).select("rows", F.posexplode(F.array(*[f"q{i}" for i in range(len(shares))])).alias("i", "cut"))
    ranks = events.where("value IS NOT NULL").join(F.broadcast(found)).groupBy("i", "rows").agg(
        F.count_if(F.col("value") < F.col("cut")).alias("below"), F.count_if(F.col("value") <= F.col("cut")).alias("upto"))
    share, slack = F.element_at(F.array(*map(F.lit, shares)), F.col("i") + 1), sketches.RANK_ERROR
    within = (F.col("below") <= (share + slack) * F.col("rows")) & (F.col("upto") >= (share - slack) * F.col("rows"))
    return ranks.select(share.alias("share"), "rows", within.alias("within"))


@query
def fixed_tree_scores(spark, folder):
    """Scores of a fixed node table of two trees, walked inside the JVM."""
    nodes = spark.createDataFrame([
        (0, 0, 0, 40.0, 1, 2, 0.0), (0, 1, 1, 25.0, 3, 4, 0.0), (0, 2, -1, 0.0, 2, 2, 1.0), (0, 3, -1, 0.0, 3, 3, 3.0), (0, 4, -1, 0.0, 4, 4, 2.5),
        (1, 0, 1, 100.0, 1, 2, 0.0), (1, 1, -1, 0.0, 1, 1, 2.0), (1, 2, 0, 10.0, 3, 4, 0.0), (1, 3, -1, 0.0, 3, 3, 1.5),
        (1, 4, 1, 200.0, 5, 6, 0.0), (1, 5, -1, 0.0, 5, 5, 4.25), (1, 6, -1, 0.0, 6, 6, 3.0)], forest.NODE_SCHEMA)
    scored = forest.walk_forest(roles.table(spark, folder, "events"), nodes, ["user_id", "value"], 256, "score")
    return rounded(scored.select("event_id", "score"))


# --- models -----------------------------------------------------------------------------------------

@query
def iforest_scores(spark, folder):
    days = stage(roles.user_days(spark, folder), "user-days")
    return forest.score_user_days(days).select(
        "user", "email_day", "dataset_split", "iforest_raw_score", "iforest_score", "iforest_flag", "risk_severity")


@query
def iforest_embeddings(spark, folder):
    vectors = roles.table(spark, folder, "embeddings")
    names = [f"v{i}" for i in range(64)]
    wide = stage(vectors.select("vec_id", *[F.get("embedding", i).cast("double").alias(n) for i, n in enumerate(names)]),
                 "vectors")
    nodes = stage(forest.fit_forest(wide, ["vec_id"], names), "nodes")
    return forest.score_forest(wide, nodes, names, 256, "score").select("vec_id", "score")


@query
def recon_scores(spark, folder):
    days = stage(roles.user_days(spark, folder), "user-days")
    return windows.score_windows(days).select(
        "user", "email_day", "dataset_split", "lstm_raw_error", "lstm_score", "lstm_flag", "lstm_risk_severity")


@query
def window_network_scores(spark, folder):
    days = stage(roles.user_days(spark, folder), "user-days")
    return window_network.score_windows(days).select(
        "user", "email_day", "dataset_split", "lstm_raw_error", "lstm_score", "lstm_flag", "lstm_risk_severity")


# --- streams ----------------------------------------------------------------------------------------

def activity_stream(spark, folder) -> DataFrame:
    events = logs.read_parquet_stream(spark, folder, "events.parquet")
    kind = F.create_map(*[F.lit(x) for pair in roles.ACTIVITY.items() for x in pair])
    return events.select(
        F.col("event_id").alias("id"), F.col("ts").alias("date"), F.col("user_id").alias("user"),
        F.get_json_object("props", "$.k").alias("pc"), F.try_element_at(kind, "event_type").alias("activity"),
        ((F.hour("ts") < 7) | (F.hour("ts") > 20)).cast("int").alias("is_after_hours"))


@query
def stream_clean(spark, folder):
    raw = roles.raw_activity(logs.read_parquet_stream(spark, folder, "events.parquet"))
    table = logs.run_to_table(logs.clean_stream(raw, clean.clean_logon), "clean")
    return table.withColumn("date", F.col("date").cast("timestamp_ntz"))


@query
def stream_dedupe(spark, folder):
    table = logs.run_to_table(logs.dedupe_stream(activity_stream(spark, folder)), "dedupe")
    return table.select("id", "user", "activity", "is_after_hours")


@query
def stream_user_day(spark, folder):
    parts = logs.user_day_parts(activity_stream(spark, folder))
    return logs.fold_user_days(logs.run_to_table(parts, "user-days", ("user", "email_day", "pc")))


@query
def stream_user_day_state(spark, folder):
    """The same counts from a stream with a map of pcs per open user-day."""
    with pcs.rocks(spark):
        return logs.run_to_table(pcs.user_day_exact(activity_stream(spark, folder)), "user-day-state", ("user", "email_day"))


@query
def stream_sensitivity(spark, folder):
    docs = logs.read_parquet_stream(spark, folder, "documents.parquet")
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 30).cast("int"))
    events = docs.select(
        F.col("source").alias("user"), day.alias("email_day"), roles.planted("text").alias("content"),
        (F.col("doc_id") % 2).cast("int").alias("has_attachment"),
        roles.spaced_words("text").alias("content_length_words"))
    # The days repeat every 30 rows, so all of them stay open.
    totals = logs.sensitivity_totals(sensitivity.score_email(events), "30 days")
    return logs.run_to_table(totals, "sensitivity", ("user", "email_day"))
