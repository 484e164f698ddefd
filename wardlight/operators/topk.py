"""Filter-then-rank evaluation of user scores: cutoffs, top-K, grids."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from wardlight import fixed
from wardlight.operators.metrics import f1
from wardlight.operators.order_stats import fit_quantiles, quantiles
from wardlight.operators.risk import ranked

AGGREGATIONS = ("score_max", "score_mean", "score_p95")


def survivors(users: DataFrame, score: str, percentile: int) -> DataFrame:
    """Users at or above a percentile of train users' scores, with the `cutoff`, sorted."""
    train = users.where(F.col("dataset_split") == "train")
    cut = fit_quantiles(train, score, [percentile / 100])[0]
    return (users.withColumn("cutoff", F.lit(cut).cast("double")).where(F.col(score) >= F.col("cutoff"))
            .orderBy(F.col(score).desc(), F.col("user").asc()))


def evaluation_grid(users: DataFrame, insiders: DataFrame, aggregations=AGGREGATIONS,
                    percentiles=fixed.GRID_PERCENTILES, ks=fixed.GRID_KS,
                    model: str = "model") -> DataFrame:
    """Top-K metrics for every (model, aggregation, percentile, K) in one job.

    `users` has a model column next to the columns of `user_scores`. Groups are the
    few combinations of the grid; only the top max(K) rows per group and task are
    shuffled for ranking. Ties go to the smaller user.
    """
    long = users.unpivot([model, "user", "dataset_split", "is_insider"], list(aggregations), "agg", "value")
    groups = (model, "agg")
    cuts = quantiles(long.where(F.col("dataset_split") == "train"), "value",
                     [p / 100 for p in percentiles], by=groups)
    cuts = cuts.unpivot(list(groups), [f"q{i}" for i in range(len(percentiles))], "__q", "cutoff")
    cuts = cuts.select(*groups, F.get(F.array(*[F.lit(p) for p in percentiles]),
                                      F.substring("__q", 2, 3).cast("int")).alias("thresh_pct"), "cutoff")
    cell = [*groups, "thresh_pct"]
    alive = long.join(F.broadcast(cuts), list(groups)).where(F.col("value") >= F.col("cutoff"))
    pools = alive.groupBy(*cell).agg(F.count(F.lit(1)).alias("pool"))
    order = Window.partitionBy(*cell).orderBy(F.col("value").desc(), F.col("user").asc())
    top = alive.withColumn("__rank", F.row_number().over(order)).where(F.col("__rank") <= max(ks))
    at_k = F.filter(F.array(*[F.lit(k) for k in ks]), lambda k: k >= F.col("__rank"))
    hits = (top.where("is_insider = 1").withColumn("k", F.explode(at_k))
            .groupBy(*cell, "k").agg(F.count(F.lit(1)).alias("tp")))
    grid = cuts.join(pools, cell, "left").withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks])))
    labelled = insiders.select("user").distinct().agg(F.count(F.lit(1))).scalar()
    df = grid.join(hits, [*cell, "k"], "left").na.fill(0, subset=["pool", "tp"])
    df = df.withColumns({"actual_k": F.least(F.col("k").cast("long"), "pool"), "__labelled": labelled})
    df = df.withColumns({
        "precision": F.when(F.col("actual_k") > 0, F.col("tp") / F.col("actual_k")).otherwise(0.0),
        "recall": F.when(F.col("__labelled") > 0, F.col("tp") / F.col("__labelled")).otherwise(0.0)})
    return df.select(
        *cell, "k", "cutoff", "pool", "actual_k", "precision", "recall",
        f1(F.col("precision"), F.col("recall")).alias("f1"), "tp",
        (F.col("actual_k") - F.col("tp")).alias("fp"), (F.col("__labelled") - F.col("tp")).alias("fn"))


def best_per_aggregation(grid: DataFrame, model: str = "model") -> DataFrame:
    """Best-F1 row of each (model, aggregation); ties go to the lower percentile, then K."""
    order = Window.partitionBy(model, "agg").orderBy(F.desc("f1"), F.asc("thresh_pct"), F.asc("k"))
    return grid.withColumn("__rank", F.row_number().over(order)).where("__rank = 1").drop("__rank")


def best_overall(grid: DataFrame, model: str = "model") -> DataFrame:
    return grid.orderBy(F.desc("f1"), F.asc(model), F.asc("agg"), F.asc("thresh_pct"), F.asc("k")).limit(1)


def outcome_counts(users: DataFrame, score: str, ks=fixed.OUTCOME_KS) -> DataFrame:
    """(k, outcome, users): true and false positives and missed insiders of the top k users.

    The rank is numbered on the top max(ks) rows only; K above the number of users takes all.
    """
    top = ranked(users.select("user", "is_insider", score), max(ks), score, "__rank")
    labelled = users.agg(F.coalesce(F.sum("is_insider"), F.lit(0))).scalar()
    per_k = top.sparkSession.range(1).select(F.explode(F.array(*[F.lit(k) for k in ks])).alias("k"))
    found = top.withColumn("k", F.explode(F.filter(F.array(*[F.lit(k) for k in ks]), lambda k: k >= F.col("__rank"))))
    tally = found.groupBy("k").agg(F.sum("is_insider").alias("tp"), F.count(F.lit(1)).alias("n"))
    full = per_k.join(tally, "k", "left").na.fill(0, subset=["tp", "n"])
    full = full.select("k", F.col("tp"), (F.col("n") - F.col("tp")).alias("fp"), (labelled - F.col("tp")).alias("fn"))
    return full.unpivot(["k"], ["tp", "fp", "fn"], "outcome", "users")


def missed_insiders(top: DataFrame, insiders: DataFrame) -> DataFrame:
    """Labelled users that are not in a ranked list."""
    return insiders.select("user").distinct().join(top.select("user"), "user", "left_anti")
