"""Declared column sets of the raw sources (all read as strings, then typed)."""

from __future__ import annotations

from pyspark.sql.types import StringType, StructField, StructType

EMAIL = ("id", "date", "user", "pc", "to", "cc", "bcc", "from", "size", "attachments", "content")
LOGON = ("id", "date", "user", "pc", "activity")
DEVICE = ("id", "date", "user", "pc", "activity")
FILE = ("id", "date", "user", "pc", "filename", "activity",
        "to_removable_media", "from_removable_media", "content")
PSYCHOMETRIC = ("employee_name", "user_id", "o", "c", "e", "a", "n")
USERS = ("user_id", "employee_name", "email", "role", "projects", "business_unit",
         "functional_unit", "department", "team", "supervisor", "start_date", "end_date")
DECOY = ("decoy_filename", "pc")
ANSWER_KEY = ("dataset", "scenario", "details", "user", "start", "end")

#: Sources a run cannot do without, and those that only add columns.
REQUIRED_SOURCES = ("email", "psychometric")
OPTIONAL_SOURCES = ("logon", "device", "file", "users", "decoy_file")


def strings(columns) -> StructType:
    """A schema with every column nullable text."""
    return StructType([StructField(c, StringType(), True) for c in columns])
