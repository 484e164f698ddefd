"""User-day features from the cleaned logs.

A log may have a user (a service account, say) holding a large share of all rows, so
nothing here gathers raw rows per user: measures are summed map-side, first by
(user, day, kind, pc), then by (user, day). Distinct pcs become a count of the first
level's rows, which needs neither a set per group nor an Expand.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from wardlight import fixed

KEYS = ("user", "email_day")


@dataclass(frozen=True)
class Log:
    """How one cleaned log turns into user-day measures."""

    day: str
    sums: dict[str, str]
    maxima: dict[str, str] = field(default_factory=dict)
    pcs: str | None = None
    features: tuple[str, ...] = ()


LOGS: dict[str, Log] = {
    "email": Log(
        day="email_day",
        sums={
            "email_count": "1",
            "total_size": "size",
            "total_attachments": "attachments",
            "emails_with_attachments": "has_attachment",
            "after_hours_emails": "is_after_hours",
            "total_recipients": "total_recipient_count",
            "total_content_words": "content_length_words",
            "bcc_email_count": "has_bcc",
            "cc_email_count": "has_cc",
        },
        maxima={"max_recipients": "total_recipient_count",
                "max_content_words": "content_length_words"},
        pcs="unique_pcs",
        features=fixed.EMAIL_FEATURES,
    ),
    "logon": Log(
        day="day",
        sums={
            "logon_count": "int(activity = 'Logon')",
            "logoff_count": "int(activity = 'Logoff')",
            "after_hours_logons": "int(activity = 'Logon' AND is_after_hours = 1)",
        },
        pcs="unique_logon_pcs",
        features=fixed.LOGON_FEATURES,
    ),
    "device": Log(
        day="day",
        sums={
            "usb_connect_count": "int(activity = 'Connect')",
            "usb_disconnect_count": "int(activity = 'Disconnect')",
        },
        features=fixed.DEVICE_FEATURES,
    ),
    "file": Log(
        day="day",
        sums={
            "file_total": "1",
            "file_to_removable": "to_removable_media",
            "file_from_removable": "from_removable_media",
            "file_write_count": "int(activity = 'File Write')",
            "file_after_hours": "is_after_hours",
        },
        features=fixed.FILE_FEATURES,
    ),
}


def _measures(kind: str, df: DataFrame) -> DataFrame:
    log = LOGS[kind]
    pc = F.col("pc") if log.pcs else F.lit(None).cast("string")
    return df.select(
        "user", F.col(log.day).alias("email_day"), F.lit(kind).alias("kind"),
        pc.cast("string").alias("pc"),
        *[F.expr(e).alias(n) for n, e in {**log.sums, **log.maxima}.items()],
    )


def _totals(rows: DataFrame, kinds) -> DataFrame:
    logs = [LOGS[k] for k in kinds]
    sums = [n for log in logs for n in log.sums]
    maxima = [n for log in logs for n in log.maxima]
    counted = {k: LOGS[k].pcs for k in kinds if LOGS[k].pcs}
    folded = [F.sum(c).alias(c) for c in sums] + [F.max(c).alias(c) for c in maxima]
    if counted:
        rows = rows.groupBy(*KEYS, "kind", "pc").agg(*folded)
    return rows.groupBy(*KEYS).agg(
        *folded,
        *[F.count_if((F.col("kind") == k) & F.col("pc").isNotNull()).alias(n)
          for k, n in counted.items()],
        *[(F.count_if(F.col("kind") == k) > 0).alias(f"has_{k}") for k in kinds],
    )


def email_ratios(df: DataFrame) -> DataFrame:
    """Averages and ratios of a user-day row; `email_count` is at least 1."""
    n = F.col("email_count")
    return df.withColumns({
        "avg_size": F.col("total_size") / n,
        "avg_recipients": F.col("total_recipients") / n,
        "avg_content_words": F.col("total_content_words") / n,
        "attachment_email_ratio": F.col("emails_with_attachments") / n,
        "after_hours_ratio": F.col("after_hours_emails") / n,
        "bcc_ratio": F.col("bcc_email_count") / n,
    })


def _user_day(kind: str, cleaned: DataFrame) -> DataFrame:
    totals = _totals(_measures(kind, cleaned), [kind])
    if kind == "email":
        totals = email_ratios(totals)
    return totals.select(*KEYS, *LOGS[kind].features)


def email_user_day(cleaned: DataFrame) -> DataFrame:
    """16 email features per (user, day)."""
    return _user_day("email", cleaned)


def logon_user_day(cleaned: DataFrame) -> DataFrame:
    """Logons, logoffs, after-hours logons and distinct pcs per (user, day)."""
    return _user_day("logon", cleaned)


def device_user_day(cleaned: DataFrame) -> DataFrame:
    """Removable-device connects and disconnects per (user, day)."""
    return _user_day("device", cleaned)


def file_user_day(cleaned: DataFrame) -> DataFrame:
    """File event counts per (user, day)."""
    return _user_day("file", cleaned)


def all_user_days(email: DataFrame, logon: DataFrame | None = None,
                  device: DataFrame | None = None, file: DataFrame | None = None) -> DataFrame:
    """Totals per (user, day) of any log, with has_<log>: whether that log has such rows.

    The logs are folded as one long table, so four sources cost two shuffles instead
    of one aggregation and one join each.
    """
    given = {"email": email, "logon": logon, "device": device, "file": file}
    present = {k: df for k, df in given.items() if df is not None}
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True),
                  [_measures(k, df) for k, df in present.items()])
    return _totals(rows, list(present))


def behavior_user_day(email: DataFrame, logon: DataFrame | None = None,
                      device: DataFrame | None = None, file: DataFrame | None = None) -> DataFrame:
    """All 27 behavioural features per (user, day) that has email. An absent log gives zero columns."""
    return email_days(all_user_days(email, logon, device, file))


def email_days(totals: DataFrame) -> DataFrame:
    """The features of the days that have email, from the totals of all logs."""
    totals = email_ratios(totals.where("email_count > 0"))
    others = [c for k in ("logon", "device", "file") for c in LOGS[k].features]
    filled = [F.coalesce(F.col(c), F.lit(0)).cast("long") if c in totals.columns
              else F.lit(0).cast("long") for c in others]
    return totals.select(*KEYS, *fixed.EMAIL_FEATURES,
                         *[x.alias(c) for x, c in zip(filled, others)])


def join_user_days(email_days: DataFrame, *others: DataFrame) -> DataFrame:
    """Left-join ready-made user-day tables onto the email days; gaps become 0.

    For callers who hold aggregated tables. All are unique on (user, day), so the
    joins share one partitioning.
    """
    result = email_days
    for other in others:
        columns = [c for c in other.columns if c not in KEYS]
        result = result.join(other, list(KEYS), "left").na.fill(0, subset=columns)
    return result


def add_traits(user_days: DataFrame, psychometric: DataFrame | None = None) -> DataFrame:
    """Left-join the traits on user; names fall back to the user, traits stay null.

    `psychometric` is unique per user. No broadcast is forced: Spark broadcasts it
    while it is under the size threshold, otherwise AQE splits skewed users.
    """
    if psychometric is None:
        return user_days.withColumns({
            "employee_name": F.col("user").cast("string"), "user_id": F.col("user"),
            **{t: F.lit(0.0) for t in fixed.TRAITS}})
    traits = psychometric.select(F.col("user_id").alias("__user"), "employee_name", *fixed.TRAITS)
    joined = user_days.join(traits, F.col("user") == F.col("__user"), "left").drop("__user")
    return joined.withColumns({
        "employee_name": F.coalesce("employee_name", F.col("user").cast("string")),
        "user_id": F.col("user"),
    })
