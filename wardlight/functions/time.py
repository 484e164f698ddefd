"""Timestamp expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from wardlight import fixed
from wardlight.functions.text import as_column


def parse_timestamp(c) -> Column:
    """`M/d/yyyy H:mm:ss` text to a zone-free timestamp; anything else is null.

    The text is re-ordered to ISO and cast, so the result does not depend on the
    session time zone (no daylight-saving gaps).
    """
    text = as_column(c)
    iso = F.regexp_replace(text, fixed.TIMESTAMP_TEXT, "$3-$1-$2 $4:$5:$6")
    return F.when(text.rlike(fixed.TIMESTAMP_TEXT), iso.try_cast("timestamp_ntz"))


def parse_day_or_time(c) -> Column:
    """Lenient form for dimension tables: ISO text, or `M/d/yyyy` with optional time."""
    text = as_column(c)
    us_day = F.regexp_replace(text, r"^(\d{1,2})/(\d{1,2})/(\d{4})$", "$3-$1-$2")
    return F.coalesce(parse_timestamp(text), us_day.try_cast("timestamp_ntz"))


def after_hours(ts) -> Column:
    """1 outside 07:00-20:59."""
    hour = F.hour(as_column(ts))
    return ((hour < fixed.FIRST_HOUR) | (hour > fixed.LAST_HOUR)).cast("int")
