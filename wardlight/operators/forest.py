"""Isolation forest: hash-sampled, grown one tree per group, scored in place.

The only Python here grows a tree from at most `subsample` rows and walks node arrays
over Arrow batches; sampling, grouping and thresholds are Spark's.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from wardlight.fixed import FOREST_FEATURES
from wardlight.functions.scale import at_least, clip, min_max, severity
from wardlight.operators.order_stats import fit_quantiles
from wardlight.operators.scaling import fit_ranges
from wardlight.sources.stage import stage

NODE_SCHEMA = ("tree int, node int, feature int, threshold double, "
               "left int, right int, path double")
_OVERSAMPLE = 1.3


def mean_path(n):
    """Average depth of an unsuccessful search among n points."""
    n = np.asarray(n, dtype=float)
    out = np.where(n == 2, 1.0, 0.0)
    big = n > 2
    out[big] = 2.0 * (np.log(n[big] - 1.0) + np.euler_gamma) - 2.0 * (n[big] - 1.0) / n[big]
    return out


def feature_vector(features) -> Column:
    """Array of features; null counts as 0."""
    return F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features])


def _uniform(seed: int, *parts) -> Column:
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *parts), 11)
    return bits.cast("double") / F.lit(float(2 ** 53))


def _prime_from(n: int) -> int:
    n = max(n, 2)
    while any(n % d == 0 for d in range(2, math.isqrt(n) + 1)):
        n += 1
    return n


def sample_for_trees(train: DataFrame, keys, vector: Column, trees: int = 300,
                     subsample: int = 256, seed: int = 42) -> DataFrame:
    """(tree, x): up to `subsample` distinct rows per tree, drawn evenly from `train`.

    Each row decides by hash, in a narrow stage, how many and which trees it joins, at a
    rate a little above the need; each tree then keeps the lowest hashes. A row's trees
    are steps around a circle of prime size, so they are distinct and every tree is
    equally likely. What is shuffled is about trees * subsample rows whatever the table
    size, and most rows of a large table end after one hash.
    """
    circle = _prime_from(trees)
    size = train.agg(F.count(F.lit(1)).alias("n")).scalar().cast("double")
    rate = F.least(F.lit(1.0), F.lit(_OVERSAMPLE * subsample + 32.0) / size) * circle
    rows = train.select(*keys, vector.alias("x"), rate.alias("__rate"))
    times = F.floor("__rate") + (_uniform(seed, *keys) < F.col("__rate") - F.floor("__rate")).cast("int")
    rows = rows.withColumn("__times", times.cast("int")).where("__times > 0")
    first = F.floor(_uniform(seed + 1, *keys) * circle)
    step = F.floor(_uniform(seed + 3, *keys) * (circle - 1)) + 1
    drawn = rows.select(*keys, "x", first.alias("__first"), step.alias("__step"),
                        F.explode(F.sequence(F.lit(0), F.col("__times") - 1)).alias("__i"))
    drawn = drawn.withColumn("tree", ((F.col("__first") + F.col("__i") * F.col("__step")) % circle).cast("int"))
    drawn = drawn.where(F.col("tree") < trees)
    order = Window.partitionBy("tree").orderBy(F.xxhash64(F.lit(seed + 2), *keys, "tree"), *keys)
    return (drawn.withColumn("__rank", F.row_number().over(order))
            .where(F.col("__rank") <= subsample).select("tree", "__rank", "x"))


def grow_tree(x: np.ndarray, rng: np.random.Generator) -> list[tuple]:
    """Nodes of one isolation tree: (node, feature, threshold, left, right, path)."""
    limit = max(1, math.ceil(math.log2(max(len(x), 2))))
    nodes: list[tuple] = []
    pending = [(0, np.arange(len(x)), 0)]
    free = 1
    while pending:
        node, rows, depth = pending.pop()
        spread = np.ptp(x[rows], axis=0) if len(rows) > 1 else np.zeros(x.shape[1])
        usable = np.flatnonzero(spread > 0)
        if depth >= limit or not len(usable):
            nodes.append((node, -1, 0.0, node, node, depth + float(mean_path([len(rows)])[0])))
            continue
        feature = int(rng.choice(usable))
        values = x[rows, feature]
        cut = float(rng.uniform(values.min(), values.max()))
        below = values <= cut
        nodes.append((node, feature, cut, free, free + 1, 0.0))
        pending += [(free, rows[below], depth + 1), (free + 1, rows[~below], depth + 1)]
        free += 2
    return nodes


def fit_forest(train: DataFrame, keys, features, trees: int = 300, subsample: int = 256,
               seed: int = 42) -> DataFrame:
    """Node table of the forest. `keys` identify a row of `train`."""

    def grow(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(key[0])
        pdf = pdf.sort_values("__rank")
        nodes = grow_tree(np.stack(pdf["x"].to_numpy()), np.random.default_rng((seed, tree)))
        out = pd.DataFrame(nodes, columns=["node", "feature", "threshold", "left", "right", "path"])
        out.insert(0, "tree", tree)
        return out

    sampled = sample_for_trees(train, keys, feature_vector(features), trees, subsample, seed)
    return sampled.groupBy("tree").applyInPandas(grow, NODE_SCHEMA)


def score_forest(df: DataFrame, nodes: DataFrame, features, subsample_size: int,
                 output: str = "iforest_raw_score") -> DataFrame:
    """Add 2^(-mean path / c(n)), higher is more anomalous; no shuffle.

    `nodes` has at most trees * (2 * subsample - 1) rows, so it is gathered and
    broadcast as arrays.
    """
    table = nodes.orderBy("tree", "node").toPandas()
    table["tree"] = table["tree"].astype("category").cat.codes
    trees = int(table["tree"].max()) + 1
    start = np.searchsorted(table["tree"].to_numpy(), np.arange(trees))
    base = start[table["tree"].to_numpy()]
    arrays = df.sparkSession.sparkContext.broadcast({
        "start": start.astype(np.int32),
        "feature": table["feature"].to_numpy(np.int32),
        "threshold": table["threshold"].to_numpy(float),
        "left": (table["left"].to_numpy() + base).astype(np.int32),
        "right": (table["right"].to_numpy() + base).astype(np.int32),
        "path": table["path"].to_numpy(float),
    })
    norm = float(mean_path([subsample_size])[0]) or 1.0

    @F.pandas_udf("double")
    def isolation(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        a = arrays.value
        for columns in batches:
            x = np.column_stack([c.to_numpy(float) for c in columns])
            rows = np.arange(len(x))[:, None]
            at = np.broadcast_to(a["start"], (len(x), trees)).copy()
            while True:
                feature = a["feature"][at]
                inner = feature >= 0
                if not inner.any():
                    break
                below = x[rows, np.where(inner, feature, 0)] <= a["threshold"][at]
                at = np.where(below, a["left"][at], a["right"][at])
            yield pd.Series(np.exp2(-a["path"][at].mean(axis=1) / norm))

    values = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features]
    return df.withColumn(output, isolation(*values))


def walk_forest(df: DataFrame, nodes: DataFrame, features, subsample_size: int, output: str = "iforest_raw_score") -> DataFrame:
    """`score_forest` without Python: each tree is walked by an expression over arrays of nodes.

    The node arrays ride in the plan as one broadcast row (at most trees * (2 * subsample - 1)
    nodes, as in `score_forest`). Slower for hundreds of trees, as lambdas are interpreted, but
    nothing leaves the JVM, so it serves small forests and streams.
    """
    order = F.array_sort(F.collect_list(F.struct("node", "feature", "threshold", "left", "right", "path")))
    tree = nodes.groupBy("tree").agg(order.alias("nodes"), F.max("node").alias("last"))
    forest = tree.agg(F.collect_list("nodes").alias("__forest"))
    depth = math.ceil(math.log2(max(subsample_size, 2)))
    x = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features])

    def path(held):
        step = lambda at, _: F.when(at["feature"] < 0, at).otherwise(
            F.get(held, F.when(F.get(F.col("__x"), at["feature"]) <= at["threshold"], at["left"]).otherwise(at["right"])))
        return F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.get(held, F.lit(0)), step)["path"]

    norm = float(mean_path([subsample_size])[0]) or 1.0
    joined = df.withColumn("__x", x).join(F.broadcast(forest))
    total = F.aggregate(F.transform("__forest", path), F.lit(0.0), lambda a, b: a + b)
    return joined.withColumn(output, F.pow(F.lit(2.0), -total / F.size("__forest") / norm)).drop("__x", "__forest")


def normalize_scores(scored: DataFrame, raw: str = "iforest_raw_score", score: str = "iforest_score",
                     flag: str = "iforest_flag", label: str = "risk_severity",
                     split: str = "dataset_split") -> DataFrame:
    """Min-max by the train rows, clip to [0, 1], p95 / p99 train thresholds, severity.

    `scored` is read three times: pass a stored table.
    """
    train = scored.where(F.col(split) == "train")
    ends = fit_ranges(train, [raw])[raw]

    def normalized(df: DataFrame) -> DataFrame:
        return df.withColumn(score, clip(min_max(raw, *ends), 0.0, 1.0))

    cuts = fit_quantiles(normalized(train), score, [0.95, 0.99])
    return normalized(scored).withColumns({
        flag: at_least(score, cuts[0]), label: severity(score, *cuts)})


def score_user_days(user_days: DataFrame, features=FOREST_FEATURES, keys=("user", "email_day"),
                    trees: int = 300, subsample: int = 256, seed: int = 42) -> DataFrame:
    """Fit on train rows and score every user-day. `user_days` is a stored table."""
    train = user_days.where(F.col("dataset_split") == "train")
    nodes = stage(fit_forest(train, list(keys), features, trees, subsample, seed), "forest-nodes")
    size = min(subsample, train.count())
    scored = stage(score_forest(user_days, nodes, features, size), "forest-scores")
    return normalize_scores(scored)
