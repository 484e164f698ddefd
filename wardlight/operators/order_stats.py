"""Exact order statistics without a single-task sort.

Values are first collapsed to distinct values with counts (map-side), cut into
buckets of about equal size at approximate quantiles, and numbered per bucket; the
bucket totals, a table of fixed size, carry the running sum across buckets.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from wardlight.sources.stage import fitted, stage


def _side(spark) -> int:
    """Buckets are side ** 2, at least one per shuffle partition; with groups, a row finds
    its bucket in 2 * side comparisons."""
    return max(16, math.isqrt(int(spark.conf.get("spark.sql.shuffle.partitions")) - 1) + 1)


def _bucketed(counts: DataFrame, value: str, by: list[str]) -> DataFrame:
    side = _side(counts.sparkSession)
    shares = ", ".join(f"{i / side ** 2}D" for i in range(1, side ** 2))
    cuts = counts.groupBy(*by).agg(
        F.expr(f"percentile_approx(`{value}`, array({shares}), {max(10000, 40 * side ** 2)})").alias("__fine"))
    if not by:
        # One table: the cuts are a fit of fixed size, looked up by binary search.
        found = {c for c in fitted(cuts)["__fine"] or [] if not math.isnan(c)}
        ends = [-math.inf, *(sorted(found - {math.inf, -math.inf}) or [0.0]), math.inf]
        buckets = Bucketizer(splits=ends, inputCol=value, outputCol="__bucket", handleInvalid="keep")
        return buckets.transform(counts).withColumn("__bucket", F.col("__bucket").cast("int"))
    cuts = cuts.withColumn("__coarse", F.filter("__fine", lambda _, i: i % side == side - 1))
    tagged = counts.join(F.broadcast(cuts), by)  # one row per group of the caller's grid

    def below(bounds: Column) -> Column:
        return F.size(F.filter(bounds, lambda c: c < F.col(value)))

    tagged = tagged.withColumn("__block", below(F.col("__coarse")) * side)
    within = below(F.slice("__fine", F.col("__block") + 1, F.lit(side)))
    return tagged.withColumn("__bucket", F.col("__block") + within).drop("__fine", "__coarse", "__block")


def _bucket_offsets(tagged: DataFrame, sums: list[str], by: list[str], descending: bool) -> DataFrame:
    order = F.col("__bucket").desc() if descending else F.col("__bucket").asc()
    earlier = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    totals = tagged.groupBy(*by, "__bucket").agg(*[F.sum(s).alias(f"__size_{s}") for s in sums])
    return totals.withColumns({
        f"__start_{s}": F.coalesce(F.sum(f"__size_{s}").over(earlier), F.lit(0)) for s in sums})


def running_sums(counts: DataFrame, value: str, sums: list[str], by: tuple[str, ...] = (),
                 descending: bool = False) -> DataFrame:
    """Add `{s}_before`: the sum of `s` over all rows that come earlier in value order.

    `counts` is a stored table with one row per (by, value). `by` has few groups (a fixed set of models
    or aggregations), as each gets its own bucket table.
    """
    by = list(by)
    order = F.col(value).desc() if descending else F.col(value).asc()
    tagged = _bucketed(counts, value, by)
    offsets = _bucket_offsets(tagged, sums, by, descending).select(
        *by, "__bucket", *[f"__start_{s}" for s in sums])
    local = (Window.partitionBy(*by, "__bucket").orderBy(order)
             .rowsBetween(Window.unboundedPreceding, -1))
    joined = tagged.join(F.broadcast(offsets), [*by, "__bucket"])
    return joined.withColumns({
        f"{s}_before": F.col(f"__start_{s}") + F.coalesce(F.sum(s).over(local), F.lit(0)) for s in sums
    }).drop("__bucket", *[f"__start_{s}" for s in sums])


def quantiles(df: DataFrame, value: str, probabilities, by: tuple[str, ...] = (),
              approximate: bool = False) -> DataFrame:
    """Linearly interpolated quantiles as columns `q0, q1, ...` (one row per group).

    Exact by default: the distinct values are stored once (they are read for the cuts,
    the totals and the pick), and only buckets that hold a wanted rank are sorted. Infinite
    values are ordered like others; NaN counts as the largest.
    ``approximate=True`` is one sketch pass without interpolation.
    """
    by = list(by)
    probabilities = [float(p) for p in probabilities]
    names = [f"q{i}" for i in range(len(probabilities))]
    present = df.where(F.col(value).isNotNull())
    if approximate:
        sketch = present.groupBy(*by).agg(F.percentile_approx(value, probabilities, 10000).alias("q"))
        return sketch.select(*by, *[F.get("q", i).alias(n) for i, n in enumerate(names)])
    counts = present.groupBy(*by, F.col(value).cast("double").alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    counts = stage(counts, "value-counts")
    tagged = _bucketed(counts, "__v", by)
    offsets = _bucket_offsets(tagged, ["__n"], by, False)
    total = F.sum("__size___n").over(Window.partitionBy(*by))
    offsets = offsets.withColumn("__total", total)

    def position(p: float) -> Column:
        return (F.col("__total") - 1) * F.lit(p)

    def holds(rank: Column, start: Column, size: Column) -> Column:
        return (start <= rank) & (rank < start + size)

    ends = [fn(position(p)) for p in probabilities for fn in (F.floor, F.ceil)]
    wanted = F.lit(False)
    for rank in ends:
        wanted = wanted | holds(rank, F.col("__start___n"), F.col("__size___n"))
    offsets = offsets.where(wanted).select(*by, "__bucket", "__start___n", "__total")
    local = (Window.partitionBy(*by, "__bucket").orderBy("__v")
             .rowsBetween(Window.unboundedPreceding, -1))
    rows = tagged.join(F.broadcast(offsets), [*by, "__bucket"]).withColumn(
        "__first", F.col("__start___n") + F.coalesce(F.sum("__n").over(local), F.lit(0)))

    def at(rank: Column) -> Column:
        return F.max(F.when(holds(rank, F.col("__first"), F.col("__n")), F.col("__v")))

    picked = rows.groupBy(*by).agg(
        F.max("__total").alias("__total"),
        *[at(F.floor(position(p))).alias(f"__lo{i}") for i, p in enumerate(probabilities)],
        *[at(F.ceil(position(p))).alias(f"__hi{i}") for i, p in enumerate(probabilities)],
    )
    return picked.select(*by, *[
        F.when(F.col(f"__lo{i}") == F.col(f"__hi{i}"), F.col(f"__lo{i}")).otherwise(
            F.col(f"__lo{i}") + (F.col(f"__hi{i}") - F.col(f"__lo{i}"))
            * (position(p) - F.floor(position(p)))).alias(n)
        for i, (p, n) in enumerate(zip(probabilities, names))])


def fit_quantiles(df: DataFrame, value: str, probabilities, approximate: bool = False) -> list[float | None]:
    """Quantiles of the whole table as numbers (null for an empty table)."""
    row = fitted(quantiles(df, value, probabilities, approximate=approximate))
    return [row[f"q{i}"] for i in range(len(probabilities))]
