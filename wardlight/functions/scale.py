"""Numeric expressions: clipping, scaling, severities."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from wardlight.functions.text import as_column


def clip(c, low, high) -> Column:
    """Limit to [low, high]; null stays null."""
    x = as_column(c)
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def _value(v) -> Column:
    return v if isinstance(v, Column) else F.lit(v).cast("double")


def min_max(c, low, high) -> Column:
    """(x - low) / (high - low); 0 where all values are equal. Ends may be columns or numbers."""
    low, span = _value(low), _value(high) - _value(low)
    return F.when(span == 0, F.lit(0.0)).otherwise((as_column(c) - low) / F.nullif(span, F.lit(0.0)))


def severity(score, suspicious, high) -> Column:
    """normal / suspicious / high; null score gives 'undetermined'."""
    x, suspicious, high = as_column(score), _value(suspicious), _value(high)
    return (
        F.when(x.isNull(), "undetermined")
        .when(x >= high, "high")
        .when(x >= suspicious, "suspicious")
        .otherwise("normal")
    )


def error_score(error, suspicious, high) -> Column:
    """Reconstruction error to [0, 1], relative to the p95 and p99 training errors."""
    base, high = _value(suspicious) * 0.5, _value(high)
    return clip((as_column(error) - base) / (high - base + 1e-9), 0.0, 1.0)


def at_least(c, threshold) -> Column:
    """0/1 flag; null gives 0."""
    return F.coalesce((as_column(c) >= _value(threshold)).cast("int"), F.lit(0))
