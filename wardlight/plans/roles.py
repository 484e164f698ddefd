"""Adapters: the driver's tables in the roles the operators expect.

Nothing here filters rows to make work smaller; each role covers its whole table.
Amounts become whole numbers (cents) so that sums are exact in any order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from wardlight import fixed
from wardlight.functions.time import after_hours
from wardlight.operators import features, forest, risk, sensitivity, signals, splits, windows
from wardlight.sources.stage import stage

ACTIVITY = {"signup": "Logon", "error": "Logoff", "click": "Connect", "view": "Disconnect",
            "purchase": "File Write"}

#: words appended to documents so that every default keyword rule meets hits and near misses
PLANTED = ("password", "passwords", "api key", "social-security", "routing number", "medical record",
           "payroll", "quarterly result", "strategic", "restructuring", "confidential",
           "attorney-client", "nda", "agenda", "draft", "draftee", "action item", "harmless")
SUFFIXES = (*fixed.EXTENSION_TIERS, ".abc", "", ".EXE", ".toolongx")
PREFIXES = ("4D-5A-90-00", "D0-CF-11-E0-A1", "25-50-44-46-2D", "50-4B-03-04", "52-61-72-21",
            "37-7A-BC-AF", "4d-5a-90", "00-11-22")
#: a lexicon that does occur in the documents
LEXICON = ((3, r"\btoken\b"), (2, r"@mail"), (2, r"\b\d{16}\b"), (1, r"\blicen[sc]ed?\b"))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def pick(values, index) -> F.Column:
    return F.get(F.array(*[F.lit(v) for v in values]), (index % len(values)).cast("int"))


# --- activity logs ---------------------------------------------------------------

def activity(spark, folder, kinds=tuple(ACTIVITY)) -> DataFrame:
    """`events` as one cleaned activity log (logon, device and file events)."""
    kind = F.create_map(*[F.lit(x) for pair in ACTIVITY.items() for x in pair])
    return table(spark, folder, "events").where(F.col("event_type").isin(*kinds)).select(
        F.col("event_id").alias("id"), F.col("ts").alias("date"), F.col("user_id").alias("user"),
        F.get_json_object("props", "$.k").alias("pc"), F.try_element_at(kind, "event_type").alias("activity"),
        F.to_date("ts").alias("day"), F.hour("ts").alias("hour"), after_hours("ts").alias("is_after_hours"),
        F.round(F.col("value") * 100).cast("long").alias("cents"),
        (F.col("value") > 50).cast("int").alias("to_removable_media"),
        (F.col("value") <= 10).cast("int").alias("from_removable_media"))


def logons(spark, folder) -> DataFrame:
    return activity(spark, folder, ("signup", "error"))


def devices(spark, folder) -> DataFrame:
    return activity(spark, folder, ("click", "view"))


def files(spark, folder) -> DataFrame:
    return activity(spark, folder, ("purchase",))


def raw_activity(events: DataFrame) -> DataFrame:
    """`events` as an uncleaned text log: padded values, bad dates, exact copies."""
    kind = F.create_map(*[F.lit(x) for pair in ACTIVITY.items() for x in pair])
    stamp = F.date_format("ts", "M/d/yyyy H:mm:ss")
    rows = events.select(
        F.concat(F.lit("E"), F.col("event_id").cast("string")).alias(" ID"),
        F.when(F.col("value") > 250, F.concat(F.lit("/"), stamp)).otherwise(stamp).alias("Date"),
        F.concat(F.lit(" u"), F.col("user_id").cast("string"), F.lit("\t")).alias("user"),
        F.concat(F.lit("pc-"), F.get_json_object("props", "$.k")).alias("pc "),
        F.concat(F.lit(" "), F.try_element_at(kind, "event_type")).alias("activity"),
        F.when(F.col("value") > 50, "TRUE").when(F.col("value") > 20, "1").when(F.col("value") > 5, "false")
        .alias("to_removable_media"),
        F.concat(F.lit("c:\\f\\"), F.col("event_type"), F.lit(".ZIP ")).alias("path"),
        F.concat(F.lit("50-4B  "), F.col("props")).alias("content"))
    return rows.unionByName(rows.where(F.col("to_removable_media") == "TRUE"))


def raw_emails(spark, folder) -> DataFrame:
    """`documents` as an uncleaned text email log; lists come from the whole text."""
    doc, text = F.col("doc_id"), F.col("text")
    return table(spark, folder, "documents").select("doc_id", "source", "lang", "n_chars", "text").select(
        doc.cast("string").alias("id"),
        F.concat(F.lit("1/"), (doc % 30 + 1).cast("string"), F.lit("/2024 "), (doc % 24).cast("string"),
                 F.lit(":05:09")).alias("date"),
        F.col("source").alias("user"), F.col("lang").alias("pc"),
        F.replace(text, F.lit("."), F.lit(";")).alias("to"),
        F.replace(text, F.lit(","), F.lit(";")).alias("cc"),
        F.when(doc % 2 == 0, F.replace(text, F.lit("?"), F.lit(";"))).alias("bcc"),
        F.concat(F.lit(" A@"), F.col("source")).alias("from"),
        F.when(F.col("n_chars") > 12000, "n/a").otherwise(F.col("n_chars").cast("string")).alias("size"),
        F.when(F.col("n_chars") < 100, None).when(doc % 2 == 0, "a;b; ;c").otherwise(" ").alias("attachments"),
        text.alias("content"))


def emails(spark, folder) -> DataFrame:
    """`orders` as cleaned email events; line items give recipients, words, attachments."""
    lines = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("recipients"),
        F.count_if(F.col("l_returnflag") == "A").alias("cc"),
        F.count_if((F.col("l_returnflag") == "N") & (F.col("l_linestatus") == "F")).alias("bcc"),
        F.count_if(F.col("l_quantity") > 40).alias("attachments"),
        F.sum(F.col("l_quantity").cast("long")).alias("words"))
    orders = table(spark, folder, "orders")
    hour = (F.col("o_orderkey") % 24).cast("int")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(
        F.col("o_orderkey").alias("id"), F.floor(F.col("o_custkey") / 10).cast("long").alias("user"),
        F.date_add(F.lit("2024-01-01").cast("date"),
                   F.datediff("o_orderdate", F.lit("1992-01-01").cast("date")) % 30).alias("email_day"),
        hour.alias("email_hour"), ((hour < 7) | (hour > 20)).cast("int").alias("is_after_hours"),
        F.col("o_orderpriority").alias("pc"),
        F.round(F.col("o_totalprice") * 100).alias("size"),
        zero("attachments").alias("attachments"), (zero("attachments") > 0).cast("int").alias("has_attachment"),
        zero("recipients").alias("total_recipient_count"),
        (zero("cc") > 0).cast("int").alias("has_cc"), (zero("bcc") > 0).cast("int").alias("has_bcc"),
        zero("words").alias("content_length_words"))


def traits(spark, folder) -> DataFrame:
    """`customer` as a cleaned trait table; customers in debt are filed under no user."""
    return table(spark, folder, "customer").select(
        F.col("c_name").alias("employee_name"),
        F.when(F.col("c_acctbal") < 0, -1 - F.col("c_custkey")).otherwise(F.col("c_custkey")).alias("user_id"),
        *[((F.col("c_custkey") * m + F.col("c_nationkey")) % 50).cast("double").alias(t)
          for t, m in zip(fixed.TRAITS, (1, 3, 7, 11, 13))])


# --- documents as events with content ----------------------------------------------

def spaced_words(c) -> F.Column:
    """Words as spaces + 1."""
    return F.length(c) - F.length(F.replace(c, F.lit(" "))) + 1


def planted(text) -> F.Column:
    """The whole text and a planted phrase, chosen by doc_id."""
    return F.concat(text, F.lit(" "), pick(PLANTED, F.col("doc_id")))


def message_events(spark, folder) -> DataFrame:
    """`documents` as cleaned email events with whole-text content and a planted phrase."""
    doc = F.col("doc_id")
    return table(spark, folder, "documents").select("doc_id", "source", "text").select(
        F.col("source").alias("user"),
        F.date_add(F.lit("2024-01-01").cast("date"), (doc % 30).cast("int")).alias("email_day"),
        doc, planted("text").alias("content"), (doc % 2).cast("int").alias("has_attachment"),
        spaced_words("text").alias("content_length_words"))


def file_events(spark, folder) -> DataFrame:
    """`documents` as cleaned file events: derived names, signatures, media flags."""
    doc = F.col("doc_id")
    return table(spark, folder, "documents").select("doc_id", "source", "text").select(
        F.col("source").alias("user"),
        F.date_add(F.lit("2024-01-01").cast("date"), (doc % 30).cast("int")).alias("day"), doc,
        F.concat(F.lit("doc_"), doc.cast("string"), pick(SUFFIXES, doc)).alias("filename"),
        F.concat(pick(PREFIXES, doc), F.lit(" "), planted("text")).alias("content"),
        (doc % 3 == 0).cast("int").alias("is_write"), (doc % 4 == 0).cast("int").alias("to_removable_media"),
        (doc % 5 == 0).cast("int").alias("from_removable_media"))


def planted_text(spark, folder) -> DataFrame:
    """`documents` with one planted phrase each (whole text kept)."""
    return table(spark, folder, "documents").select("doc_id", "text").select("doc_id", planted("text").alias("content"))


def daily_sensitivity(spark, folder) -> DataFrame:
    return sensitivity.sensitivity_daily(
        sensitivity.score_email(message_events(spark, folder)),
        sensitivity.score_file(file_events(spark, folder)))


def activity_sensitivity(spark, folder) -> DataFrame:
    """Per-user sensitivity on the users of `events`: file events graded by metadata."""
    rows = activity(spark, folder).select(
        "user", "day", F.concat(F.lit("f"), pick(SUFFIXES, F.col("id"))).alias("filename"),
        F.lit("").alias("content"), (F.col("activity") == "File Write").cast("int").alias("is_write"),
        "to_removable_media", "from_removable_media")
    return sensitivity.sensitivity_user(sensitivity.sensitivity_daily(sensitivity.score_file(rows)))


# --- user-days, scores, labels -------------------------------------------------------

def user_days(spark, folder) -> DataFrame:
    """27 features, traits and split per (user, day), from four logs."""
    days = features.behavior_user_day(emails(spark, folder), logons(spark, folder),
                                      devices(spark, folder), files(spark, folder))
    return features.add_traits(splits.split_by_user(days), traits(spark, folder))


def day_values(spark, folder) -> DataFrame:
    """(user, email_day, cents, dataset_split): a user's total value per day."""
    daily = activity(spark, folder).groupBy("user", F.col("day").alias("email_day")).agg(
        F.sum("cents").cast("double").alias("cents"))
    return splits.split_by_user(daily)


def day_scores(spark, folder) -> DataFrame:
    """Day values scored like the forest's raw scores."""
    return forest.normalize_scores(stage(day_values(spark, folder), "day-values"), raw="cents",
                                   score="score", flag="flag", label="severity")


def window_scores(spark, folder) -> DataFrame:
    """Mean square of the last seven day values, scored like a reconstruction error."""
    framed = windows.trailing_windows(day_values(spark, folder), [F.col("cents")])
    squares = F.aggregate(F.flatten("window"), F.lit(0.0), lambda acc, v: acc + v * v)
    errors = framed.withColumn("error", squares / 7.0).drop("window")
    return windows.score_errors(stage(errors, "window-values"), raw="error", score="score",
                                flag="flag", label="severity")


def insiders(spark, folder) -> DataFrame:
    """Users with an expensive error event."""
    return table(spark, folder, "events").where("event_type = 'error' AND value > 200").select(
        F.col("user_id").alias("user")).distinct()


def answer_key(spark, folder) -> DataFrame:
    """Expensive error events as a text answer key: three releases, some bad intervals."""
    ts, value = F.col("ts"), F.col("value")
    shown = lambda t: F.date_format(t, "M/d/yyyy H:mm:ss")
    return table(spark, folder, "events").where("event_type = 'error' AND value > 120").select(
        F.when(F.hour("ts") < 10, "4.2").when(F.hour("ts") < 18, "5.20").otherwise("6.0").alias("dataset"),
        F.col("user_id").alias("user"),
        F.when(value > 260, F.concat(F.lit("/"), shown(ts))).otherwise(shown(ts)).alias("start"),
        F.when((value > 220) & (value <= 260), shown(ts - F.expr("INTERVAL 2 DAYS")))
        .otherwise(shown(ts + F.expr("INTERVAL 2 DAYS"))).alias("end"))


def key_users(spark, folder) -> DataFrame:
    """Users taken as scored, for matching against the answer key."""
    return table(spark, folder, "events").where("event_type = 'purchase' AND value > 60").select(
        F.col("user_id").alias("user")).distinct()


def labelled_intervals(spark, folder) -> DataFrame:
    """Two days from every expensive error event on."""
    rows = table(spark, folder, "events").where("event_type = 'error' AND value > 200")
    return rows.select(F.col("user_id").alias("user"), F.col("ts").alias("start"), (F.col("ts") + F.expr("INTERVAL 2 DAYS")).alias("end"))


def window_user_scores(spark, folder) -> DataFrame:
    scored = window_scores(spark, folder).where("severity <> 'undetermined'")
    return signals.user_scores(scored, "score", insiders(spark, folder))


def risk_table(spark, folder) -> DataFrame:
    """Risk of every scored user, with explanations."""
    scores = signals.user_scores(window_scores(spark, folder).where("severity <> 'undetermined'"), "score")
    behavior = signals.behavior_signals(user_days(spark, folder))
    merged = risk.assemble_signals(scores, behavior, activity_sensitivity(spark, folder))
    return risk.explain(risk.risk_scores(merged, insiders(spark, folder)))


def model_users(spark, folder) -> DataFrame:
    """User scores of two models: day values and windows."""
    scored = [("window", window_scores(spark, folder).where("severity <> 'undetermined'")),
              ("day", day_scores(spark, folder))]
    known = insiders(spark, folder)
    parts = [signals.user_scores(df, "score", known).withColumn("model", F.lit(m)) for m, df in scored]
    return stage(parts[0].unionByName(parts[1]), "model-users")
