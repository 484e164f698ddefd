"""Search of risk weights and flag thresholds over many candidates.

A candidate is 14 genes: seven raw weights, then seven thresholds. Scoring every
candidate against every user is the work: each task keeps its own best k users per
candidate over Arrow batches, so the shuffle carries tasks * candidates * k rows and no
(user, candidate) table exists. Populations are a parameter (tens of rows).

All draws come from md5 of (seed, generation, candidate, gene, purpose), so a run is
repeatable on any cluster.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from wardlight import fixed
from wardlight.functions.scale import clip
from wardlight.operators.metrics import f1
from wardlight.operators.risk import NORMS

N = len(fixed.SIGNALS)
BASELINE: list[float] = [fixed.WEIGHTS[s] for s in fixed.SIGNALS] + [fixed.THRESHOLDS[s] for s in fixed.SIGNALS]
_P = fixed.SEARCH
_LOW = [_P["weight_low"]] * N + [_P["threshold_low"]] * N
_HIGH = [_P["weight_high"]] * N + [_P["threshold_high"]] * N
POPULATION_SCHEMA = "cand int, genes array<double>"


def uniform(seed: int, purpose: str, *parts) -> Column:
    """Uniform in [0, 1) from the first 48 bits of md5(seed|purpose|parts...)."""
    texts = [F.lit(f"{seed}|{purpose}"), *[p.cast("string") for p in parts]]
    digits = F.substring(F.md5(F.concat_ws("|", *texts)), 1, 12)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(2 ** 48))


def _bound(table: list[float], gene: Column) -> Column:
    return F.when(gene < N, table[0]).otherwise(table[N])


def random_candidates(spark: SparkSession, population: int = _P["population"], seed: int = 42) -> DataFrame:
    """(cand, genes): candidate 0 is the baseline, the rest are uniform in the bounds."""
    cand = F.col("cand")
    low = lambda g: _bound(_LOW, g)
    genes = F.transform(F.sequence(F.lit(0), F.lit(2 * N - 1)), lambda g: low(g) + (
        _bound(_HIGH, g) - low(g)) * uniform(seed, "start", cand, g))
    return spark.range(population).select(F.col("id").cast("int").alias("cand")).select(
        "cand", F.when(cand == 0, F.array(*[F.lit(x) for x in BASELINE])).otherwise(genes).alias("genes"))


def best_users(users: DataFrame, candidates: list[tuple[int, list[float]]], k: int) -> DataFrame:
    """(cand, user, score, is_insider, flagged, rank): the top k users of every candidate.

    `users` has `user`, `is_insider` and the seven normalised signals. Ties go to the
    smaller user.
    """
    ids = np.array([c for c, _ in candidates], dtype=np.int32)
    genes = np.array([g for _, g in candidates], dtype=float)
    raw = np.clip(genes[:, :N], _P["weight_low"], _P["weight_high"])
    weights = raw / np.add.reduce(raw, axis=1)[:, None]
    limits = np.clip(genes[:, N:], _P["threshold_low"], _P["threshold_high"])

    def leading(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best, floor = None, np.full(len(ids), -np.inf)  # floor: a full candidate's k-th score, below which nothing counts
        for batch in batches:
            batch = batch.sort_values("user", ignore_index=True)
            signals = np.asfortranarray(batch[list(NORMS)].to_numpy(float))
            taken, scores, flags = [], [], []
            for i in range(len(ids)):
                score = signals[:, 0] * weights[i, 0]
                for j in range(1, N):  # fixed order of additions: equal rows score equal
                    score = score + signals[:, j] * weights[i, j]
                rows = np.flatnonzero(score >= floor[i]) if floor[i] > -np.inf else np.arange(len(score))
                if len(rows) > k:
                    there = score[rows]
                    edge = np.partition(there, len(there) - k)[len(there) - k]
                    above = np.flatnonzero(there > edge)
                    tied = np.flatnonzero(there == edge)[:k - len(above)]
                    rows = rows[np.concatenate([above, tied])]
                taken.append(rows)
                scores.append(score[rows])
                flags.append((signals[rows] >= limits[i]).any(axis=1).astype(np.int32))
            if not any(map(len, taken)):
                continue
            # One frame a batch: a frame for each candidate would cost more than the scores.
            top = batch.loc[np.concatenate(taken), ["user", "is_insider"]].assign(
                cand=np.repeat(ids, [len(rows) for rows in taken]), score=np.concatenate(scores), flagged=np.concatenate(flags))
            merged = (top if best is None else pd.concat([best, top])).sort_values(
                ["cand", "score", "user"], ascending=[True, False, True])
            best = merged.groupby("cand", sort=False).head(k)
            full = best.groupby("cand")["score"].agg(["size", "min"]).reindex(ids)
            floor = np.where(full["size"] >= k, full["min"], -np.inf)
        if best is not None:
            yield best[["cand", "user", "score", "is_insider", "flagged"]]

    user_type = users.schema["user"].dataType.simpleString()
    partial = users.select("user", "is_insider", *NORMS).mapInPandas(
        leading, f"cand int, user {user_type}, score double, is_insider int, flagged int")
    order = Window.partitionBy("cand").orderBy(F.desc("score"), F.asc("user"))
    return partial.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def fitness(users: DataFrame, candidates: list[tuple[int, list[float]]], k: int = _P["k"]) -> DataFrame:
    """Fitness of every candidate: 0.8 * F1@k + 0.2 * share of the top k with a flag.

    Precision divides by k even when fewer users exist.
    """
    labelled = users.agg(F.sum("is_insider")).scalar()
    tally = best_users(users, candidates, k).groupBy("cand").agg(
        F.sum("is_insider").alias("tp"), F.avg("flagged").alias("coverage"))
    scored = tally.withColumns({
        "precision": F.col("tp") / F.lit(k),
        "recall": F.when(labelled > 0, F.col("tp") / labelled).otherwise(F.lit(0.0)),
        "fn": labelled - F.col("tp")})
    scored = scored.withColumn("f1", f1(F.col("precision"), F.col("recall")))
    return scored.select(
        "cand", "tp", (F.lit(k) - F.col("tp")).alias("fp"), "fn", "precision", "recall", "f1", "coverage",
        (_P["alpha"] * F.col("f1") + _P["beta"] * F.col("coverage")).alias("fitness"))


def next_generation(scored: DataFrame, generation: int, population: int, seed: int = 42,
                    elites: int = _P["elites"]) -> DataFrame:
    """(cand, genes) of the next generation from (cand, genes, fitness).

    The best `elites` are copied. Every other slot draws two parents by tournament
    (with replacement), mixes them gene by gene and mutates some genes. Candidates are
    numbered from 0 to `population` - 1, as this function and `random_candidates` number
    them, so draws name them directly and only the elites are ranked.
    """
    gen = F.lit(generation)
    leading = scored.orderBy(F.desc("fitness"), F.asc("cand")).limit(elites)
    place = F.row_number().over(Window.orderBy(F.desc("fitness"), F.asc("cand"))) - 1  # over `elites` rows
    kept = leading.select(place.alias("cand"), "genes")
    slots = scored.sparkSession.range(elites, population).select(F.col("id").cast("int").alias("cand"))
    draws = slots.select(
        "cand", F.explode(F.sequence(F.lit(0), F.lit(2 * _P["tournament"] - 1))).alias("draw")).select(
        "cand", "draw", (F.col("draw") % 2).alias("parent"),
        F.floor(uniform(seed, "draw", gen, F.col("cand"), F.col("draw")) * population).cast("int").alias("drawn"))
    pool = scored.select(F.col("cand").alias("drawn"), "genes", "fitness")
    won = draws.join(pool, "drawn").groupBy("cand").agg(*[
        F.max_by("genes", F.when(F.col("parent") == p, F.struct("fitness", -F.col("draw")))).alias(f"p{p}")
        for p in (0, 1)])

    def child(g: Column) -> Column:
        key = (gen, F.col("cand"), g)
        mixed = F.when(uniform(seed, "mix", *key) < _P["crossover"], F.get("p0", g)).otherwise(F.get("p1", g))
        normal = (F.sqrt(-2 * F.log(1 - uniform(seed, "radius", *key)))
                  * F.cos(2 * F.pi() * uniform(seed, "angle", *key)))
        moved = F.when(uniform(seed, "mutate", *key) < _P["mutation"], mixed + normal * _P["sigma"]).otherwise(mixed)
        return clip(moved, _bound(_LOW, g), _bound(_HIGH, g))

    genes = F.transform(F.sequence(F.lit(0), F.lit(2 * N - 1)), child)
    return kept.unionByName(won.select("cand", genes.alias("genes")))


@dataclass(frozen=True)
class SearchResult:
    best: list[float]
    history: list[tuple[int, float, float]]  # (generation, best fitness, mean fitness)


def run_search(users: DataFrame, population: int = _P["population"], generations: int = _P["generations"],
               seed: int = 42, k: int = _P["k"], patience: int = _P["patience"]) -> SearchResult:
    """Generational search; `users` is a stored table.

    One scoring job per generation; the population (tens of rows) is collected and
    rebuilt each time, so lineage does not grow.
    """
    spark = users.sparkSession

    def collect(df: DataFrame) -> list[tuple[int, list[float]]]:
        return sorted((r["cand"], list(r["genes"])) for r in df.collect())

    def evaluate(rows) -> dict[int, float]:
        return {r["cand"]: r["fitness"] for r in fitness(users, rows, k).select("cand", "fitness").collect()}

    rows = collect(random_candidates(spark, population, seed))
    value = evaluate(rows)
    leader = max(value, key=lambda c: (value[c], -c))
    best, best_fitness, stale = dict(rows)[leader], value[leader], 0
    history = [(0, best_fitness, float(np.mean(list(value.values()))))]
    for generation in range(1, generations + 1):
        scored = spark.createDataFrame([(c, g, value[c]) for c, g in rows], POPULATION_SCHEMA + ", fitness double")
        rows = collect(next_generation(scored, generation, population, seed))
        value = evaluate(rows)
        leader = max(value, key=lambda c: (value[c], -c))
        history.append((generation, value[leader], float(np.mean(list(value.values())))))
        stale += 1
        if value[leader] > best_fitness + 1e-6:
            best, best_fitness, stale = dict(rows)[leader], value[leader], 0
        if stale >= patience:
            break
    return SearchResult(best, history)


def compare_with_baseline(users: DataFrame, best: list[float], k: int = _P["k"]) -> DataFrame:
    """Metrics at k of the found candidate and the baseline, and their differences."""
    both = fitness(users, [(0, BASELINE), (1, best)], k)
    names = ["tp", "fp", "fn", "precision", "recall", "f1", "coverage"]
    wide = both.groupBy().agg(*[
        F.max(F.when(F.col("cand") == c, F.col(m))).alias(f"{p}{m}")
        for c, p in ((0, "baseline_"), (1, "")) for m in names])
    return wide.select(
        F.lit(k).alias("k"), *[F.round(m, 4).alias(m) if m in names[3:] else F.col(m) for m in names],
        *[F.round(f"baseline_{m}", 4).alias(f"baseline_{m}") if m in names[3:] else F.col(f"baseline_{m}")
          for m in names],
        *[F.round(F.col(m) - F.col(f"baseline_{m}"), 4).alias(f"delta_{m}") for m in ("precision", "recall", "f1")])


def weights_table(spark: SparkSession, best: list[float]) -> DataFrame:
    """(signal, weight, threshold) of a candidate; weights sum to 1."""
    raw = [min(max(x, _P["weight_low"]), _P["weight_high"]) for x in best[:N]]
    limits = [min(max(x, _P["threshold_low"]), _P["threshold_high"]) for x in best[N:]]
    rows = [(s, round(w / sum(raw), 6), round(t, 4)) for s, w, t in zip(fixed.SIGNALS, raw, limits)]
    return spark.createDataFrame(rows, "signal string, weight double, threshold double")
