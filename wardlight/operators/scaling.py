"""Min-max scaling fitted on one table and applied to another."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from wardlight.functions.scale import min_max
from wardlight.sources.stage import fitted


Ranges = dict[str, tuple[float | None, float | None]]


def _double(c: str) -> Column:
    return F.col(c).cast("double")


def fit_ranges(df: DataFrame, columns, null_as_zero: bool = False) -> Ranges:
    """Smallest and largest value of every column, in one aggregation."""
    value = (lambda c: F.coalesce(_double(c), F.lit(0.0))) if null_as_zero else _double
    row = fitted(df.agg(*[f(value(c)).alias(f"{c}_{n}") for c in columns
                          for f, n in ((F.min, "min"), (F.max, "max"))]))
    return {c: (row[f"{c}_min"], row[f"{c}_max"]) for c in columns}


def scaled_features(columns, ranges: Ranges) -> list[Column]:
    """Scaler expressions for window features: a zero range divides by 1, so a value
    unseen in the fit keeps its distance from the minimum. Nulls count as 0."""
    out = []
    for c in columns:
        low, high = ranges[c]
        out.append((F.coalesce(_double(c), F.lit(0.0)) - low) / ((high - low) or 1.0))
    return out


def min_max_columns(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Add min-max scaled copies {source: target}; an all-equal column gives 0.

    `df` is read twice (range, apply): pass a stored table.
    """
    ranges = fit_ranges(df, list(columns))
    return df.withColumns({t: min_max(_double(c), *ranges[c]) for c, t in columns.items()})
