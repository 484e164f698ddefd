"""Row cleaning of the raw logs and dimension tables.

Every cleaner takes a table of text columns and returns typed, filtered,
de-duplicated rows with a fixed column order. The cleaners of the four logs also take a
stream; repeats are then left to the streaming dedupe.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from wardlight.functions import text, time
from wardlight.sources.readers import normalize_file_columns, normalize_header


def keep_first(df: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """One row per key: the earliest by `order`, ties broken by row content.

    `row_number() = 1` lets Spark put a per-task limit below the shuffle, so each task
    ships at most one row per key however many copies a key has. The tie-break is a
    fingerprint, so wide text columns nobody selects are pruned before the shuffle.
    """
    rest = [c for c in df.columns if c not in (key, order)]
    ordering = [F.col(order)] if order else []
    if rest:
        ordering.append(F.xxhash64(*rest))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*ordering))
    return df.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def _unique(df: DataFrame, key: str, order: str | None = None) -> DataFrame:
    # A stream drops repeats by state instead, see `streaming.logs.clean_stream`.
    return df if df.isStreaming else keep_first(df, key, order)


def _clock(df: DataFrame, day: str = "day", hour: str = "hour") -> dict:
    return {day: F.to_date("date"), hour: F.hour("date"), "is_after_hours": time.after_hours("date")}


def clean_email(raw: DataFrame, attachments: str = "paths") -> DataFrame:
    """Clean the email log.

    ``attachments`` says what that column holds: 'paths' (a `;` list, its items are
    counted) or 'count' (a number). A null in it drops the row in both cases.
    """
    df = normalize_header(raw).withColumn("date", time.parse_timestamp("date"))
    df = df.na.drop(subset=["date", "id", "user", "pc", "to", "from", "size",
                            "attachments", "content"])
    attached = (text.list_size("attachments") if attachments == "paths"
                else F.coalesce(text.lenient_double("attachments"), F.lit(0.0)).cast("int"))
    df = df.select(
        "id", "date", *[c.alias(n) for n, c in _clock(df, "email_day", "email_hour").items()],
        F.month("date").alias("email_month"), F.weekday("date").alias("email_weekday"),
        text.strip_upper("user").alias("user"), text.strip_upper("pc").alias("pc"),
        text.strip_lower("from").alias("sender"), text.strip_lower("to").alias("to"),
        *[F.coalesce(text.strip_lower(c), F.lit("")).alias(c) for c in ("cc", "bcc")],
        text.lenient_double("size").alias("size"), attached.alias("attachments"),
        F.lower(text.collapse_blanks("content")).alias("content"),
    ).na.drop(subset=["size"])
    df = _unique(df, "id", "date")
    counts = {f"{c}_recipient_count": text.list_size(c) for c in ("to", "cc", "bcc")}
    df = df.withColumns(counts).withColumns({
        "has_attachment": (F.col("attachments") > 0).cast("int"),
        "total_recipient_count": F.expr("to_recipient_count + cc_recipient_count + bcc_recipient_count"),
        "has_cc": (F.col("cc_recipient_count") > 0).cast("int"),
        "has_bcc": (F.col("bcc_recipient_count") > 0).cast("int"),
        "content_length_chars": F.length("content"),
        "content_length_words": text.word_count("content"),
    })
    return df.select(
        "id", "date", "email_day", "email_hour", "email_month", "email_weekday", "is_after_hours",
        "user", "pc", "sender", "to", "cc", "bcc", "size", "attachments", "has_attachment",
        "to_recipient_count", "cc_recipient_count", "bcc_recipient_count", "total_recipient_count",
        "has_cc", "has_bcc", "content_length_chars", "content_length_words", "content",
    )


def _clean_activity(df: DataFrame, required, extra: dict) -> DataFrame:
    df = df.withColumn("date", time.parse_timestamp("date")).na.drop(subset=list(required))
    df = df.select(
        "id", "date", *[c.alias(n) for n, c in _clock(df).items()],
        text.strip_upper("user").alias("user"), text.strip_upper("pc").alias("pc"),
        text.strip("activity").alias("activity"),
        *[c.alias(n) for n, c in extra.items()],
    )
    return _unique(df, "id", "date")


_ACTIVITY_REQUIRED = ("date", "id", "user", "pc", "activity")
_ACTIVITY_COLUMNS = ("id", "date", "day", "hour", "is_after_hours", "user", "pc")


def clean_logon(raw: DataFrame) -> DataFrame:
    """Clean the logon log."""
    df = _clean_activity(normalize_header(raw), _ACTIVITY_REQUIRED, {})
    return df.select(*_ACTIVITY_COLUMNS, "activity",
                     (F.col("activity") == "Logon").cast("int").alias("is_logon"))


def clean_device(raw: DataFrame) -> DataFrame:
    """Clean the device log; `file_tree` is optional."""
    df = normalize_header(raw)
    tree = text.strip("file_tree") if "file_tree" in df.columns else F.lit("")
    df = _clean_activity(df, _ACTIVITY_REQUIRED, {"file_tree": F.coalesce(tree, F.lit(""))})
    return df.select(*_ACTIVITY_COLUMNS, "activity",
                     (F.col("activity") == "Connect").cast("int").alias("is_connect"), "file_tree")


def clean_file(raw: DataFrame) -> DataFrame:
    """Clean the file log; content keeps its case."""
    df = normalize_file_columns(raw)
    df = _clean_activity(df, (*_ACTIVITY_REQUIRED, "filename"), {
        "filename": text.strip("filename"),
        "to_removable_media": text.flag("to_removable_media"),
        "from_removable_media": text.flag("from_removable_media"),
        "content": F.coalesce(text.collapse_blanks("content"), F.lit("")),
    })
    return df.select(*_ACTIVITY_COLUMNS, "filename", "activity",
                     (F.col("activity") == "File Write").cast("int").alias("is_write"),
                     "to_removable_media", "from_removable_media", "content")


def clean_psychometric(raw: DataFrame) -> DataFrame:
    """Clean the trait table; a row with any unusable trait is dropped."""
    traits = ("o", "c", "e", "a", "n")
    df = normalize_header(raw).select(
        text.collapse_blanks("employee_name").alias("employee_name"),
        text.strip_upper("user_id").alias("user_id"),
        *[text.lenient_double(t).alias(t) for t in traits],
    ).na.drop(subset=["user_id", *traits])
    return keep_first(df, "user_id")


def clean_users(raw: DataFrame) -> DataFrame:
    """Clean the users dimension."""
    df = normalize_header(raw)
    spaced = {c: text.collapse_blanks(c).alias(c)
              for c in ("functional_unit", "department", "team", "supervisor")}
    df = df.select(
        text.strip_upper("user_id").alias("user_id"),
        text.collapse_blanks("employee_name").alias("employee_name"),
        text.strip_lower("email").alias("email"), text.strip("role").alias("role"),
        F.coalesce(text.strip("projects"), F.lit("")).alias("projects"),
        text.lenient_double("business_unit").alias("business_unit"),
        *spaced.values(),
        time.parse_day_or_time("start_date").alias("start_date"),
        time.parse_day_or_time("end_date").alias("end_date"),
    ).na.drop(subset=["user_id", "employee_name", "email"])
    return keep_first(df, "user_id")


def clean_decoy(raw: DataFrame) -> DataFrame:
    """Distinct (decoy file, pc) pairs."""
    return normalize_header(raw).select(
        text.strip("decoy_filename").alias("decoy_filename"), text.strip_upper("pc").alias("pc"),
    ).na.drop().distinct()
