"""Readers: tolerant CSV, optional sources, header and schema checks."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from wardlight.schemas import strings

_BAD = "__bad_record"


def normalize_header(df: DataFrame) -> DataFrame:
    """Trim and lower-case every column name."""
    return df.toDF(*[c.strip().lower() for c in df.columns])


def require_columns(df: DataFrame, columns, what: str = "table") -> DataFrame:
    """Return `df` unchanged, or fail naming every missing column."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{what} is missing required columns: {missing}")
    return df


def path_exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.format("binaryFile").load(path).schema
        return True
    except AnalysisException as err:
        if err.getCondition() == "PATH_NOT_FOUND":
            return False
        raise


def require_inputs(spark: SparkSession, paths: dict[str, str]) -> None:
    """Fail before planning, naming every missing input."""
    missing = [f"{name} ({path})" for name, path in paths.items() if not path_exists(spark, path)]
    if missing:
        raise FileNotFoundError("missing required inputs: " + ", ".join(missing))


def _field_count(record: Column) -> Column:
    unquoted = F.regexp_replace(record, r'"(?:[^"]|"")*"', "")
    return F.length(unquoted) - F.length(F.replace(unquoted, F.lit(","))) + 1


def read_csv(spark: SparkSession, path: str, tolerant: bool = False,
             multiline: bool = False) -> DataFrame:
    """Scan a CSV with a header; every column is text, names are normalised.

    ``tolerant`` drops rows with too many fields; short rows stay, padded with nulls.
    ``multiline=True`` reads quoted newlines, but then each file is one task: such a source
    should come as many files.
    """
    options = {"header": True, "escape": '"', "quote": '"', "multiLine": multiline}
    names = [c.strip().lower() for c in spark.read.options(**options).csv(path).columns]
    if not tolerant:
        return spark.read.options(**options).schema(strings(names)).csv(path)
    raw = (
        spark.read.options(**options, mode="PERMISSIVE", columnNameOfCorruptRecord=_BAD,
                           columnPruning=False)
        .schema(strings([*names, _BAD])).csv(path)
    )
    bad = F.col(_BAD)
    # Always true: it makes a data column part of the scan, which count() needs.
    touched = F.coalesce(F.length(names[0]), F.lit(0)) > -1
    return raw.where((bad.isNull() | (_field_count(bad) <= len(names))) & touched).drop(_BAD)


def read_optional_csv(spark: SparkSession, path: str | None, columns, **options) -> DataFrame:
    """`read_csv`, or an empty table of the declared columns when the path is absent."""
    if path is None or not path_exists(spark, path):
        return spark.createDataFrame([], strings(columns))
    return read_csv(spark, path, **options)


def normalize_file_columns(df: DataFrame) -> DataFrame:
    """Bring the file log of any release to one set of columns.

    Some releases hold only copies to removable media and leave out the columns that
    say so, hence the defaults.
    """
    df = normalize_header(df)
    if "filename" not in df.columns:
        alias = next((c for c in ("file", "filepath", "path") if c in df.columns), None)
        df = df.withColumnRenamed(alias, "filename") if alias else df.withColumn("filename", F.lit(""))
    defaults = {"activity": "File Write", "content": "",
                "to_removable_media": "True", "from_removable_media": "False"}
    absent = {c: F.lit(v) for c, v in defaults.items() if c not in df.columns}
    return df.withColumns(absent) if absent else df


def scored_users(*tables: DataFrame, user: str = "user") -> DataFrame:
    """Distinct users over several scored tables."""
    parts = [t.select(F.col(user).alias("user")) for t in tables]
    return reduce(DataFrame.unionByName, parts).na.drop().distinct()


def load_weights(table: DataFrame) -> DataFrame:
    """Weight table (signal, weight, threshold) brought to the full signal set.

    A table without `content_sensitivity` is the older six-signal form: its weights
    shrink to leave the default share for the missing signal. Weights then sum to 1.
    An incomplete table gives the defaults. At most one row per signal.
    """
    from wardlight import fixed

    last = fixed.SIGNALS[-1]
    share = fixed.WEIGHTS[last]
    defaults = table.sparkSession.createDataFrame(
        [(s, fixed.WEIGHTS[s], fixed.THRESHOLDS[s]) for s in fixed.SIGNALS],
        "signal string, default_weight double, default_threshold double",
    )
    known = table.where(F.col("signal").isin(*fixed.SIGNALS)).agg(
        F.count_if(F.col("signal") != last).alias("core"),
        F.count_if(F.col("signal") == last).alias("seventh"),
        F.sum("weight").alias("given"),
    )
    state = known.select(F.struct("core", "seventh", "given")).scalar()
    joined = defaults.join(table.select("signal", "weight", "threshold"), "signal", "left")
    complete = state["core"] == len(fixed.SIGNALS) - 1
    upgraded = (
        F.when(state["seventh"] == 1, F.col("weight"))
        .when(F.col("signal") == last, F.lit(share))
        .otherwise(F.col("weight") * (1 - share))
    )
    total = F.when(state["seventh"] == 1, state["given"]).otherwise(state["given"] * (1 - share) + share)
    return joined.select(
        "signal",
        F.when(complete, upgraded / total).otherwise(F.col("default_weight")).alias("weight"),
        F.when(complete, F.coalesce("threshold", "default_threshold"))
        .otherwise(F.col("default_threshold")).alias("threshold"),
    )
