"""SimHash groups: fingerprints within a Hamming distance, found by a generalised pigeonhole.

Bits are grouped so that correlated bits share a part; each part gets its own threshold
(part thresholds sum to distance - parts + 1, so every pair within the distance agrees in
at least one part up to that part's threshold); a dynamic program over estimated
candidate counts picks the cheapest allocation. Rows are indexed by part value, probed with
all part values within the part's threshold, and verified on the whole fingerprint.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from wardlight.llm.common import present, stage
from wardlight.llm.components import connected

BITS = 64
SHINGLE = 3
SEED = 42
DISTANCE = 2
#: A part value shared by more rows than this is resolved exactly through neighbour keys.
BUCKET = 64
PART_COUNTS = (2, 3, 4)
_LOWER = bytes(range(256)).lower()


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """In how many of the unsigned 64-bit hashes each bit is set."""
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.sum(axis=0, dtype=np.int64)


def majority(counts: np.ndarray, n: int) -> int:
    """The fingerprint of n hashes: the bits that over half of them have."""
    return sum(1 << int(b) for b in np.flatnonzero(2 * counts > n))


def _fingerprint(text: str, shingle: int, seed: int) -> int:
    tokens = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not tokens:
        return 0
    n = max(1, len(tokens) - shingle + 1)
    half = np.zeros(BITS, np.int64)
    digest = xxhash.xxh64_intdigest
    for start in range(0, n, 1 << 15):  # bounds the bit table of a very long text
        at = range(start, min(n, start + (1 << 15)))
        hashes = np.fromiter((digest(b" ".join(tokens[i:i + shingle]), seed) for i in at), np.uint64, len(at))
        half += bit_counts(hashes)
    return majority(half, n)


def fingerprint(text: Column, shingle: int = SHINGLE, seed: int = SEED) -> Column:
    """64-bit fingerprint (as a signed long) of a text; zero where it has no word."""

    @F.pandas_udf("long")
    def simhash(texts: pd.Series) -> pd.Series:
        values = np.array([_fingerprint(t, shingle, seed) for t in texts], np.uint64)
        return pd.Series(values.view(np.int64))

    return simhash(present(text))


def bit_moments(prints: DataFrame) -> tuple[np.ndarray, int]:
    """(64 x 64 co-occurrence counts, rows) over all fingerprints, summed per task first."""

    def partial(batches):
        total, rows = np.zeros((BITS, BITS)), 0
        for b in batches:
            x = np.unpackbits(b["fp"].to_numpy(np.int64).view(np.uint8).reshape(-1, 8), axis=1,
                              bitorder="little").astype(np.float32)
            total += x.T @ x
            rows += len(b)
        yield pd.DataFrame({"spot": np.arange(BITS * BITS + 1), "n": np.append(total.ravel(), rows)})

    rows = prints.select("fp").mapInPandas(partial, "spot int, n double").groupBy("spot").agg(F.sum("n").alias("n"))
    found = {r["spot"]: r["n"] for r in rows.collect()}  # 4,097 numbers whatever the size
    flat = np.array([found.get(i, 0.0) for i in range(BITS * BITS + 1)])
    return flat[:-1].reshape(BITS, BITS), int(flat[-1])


def correlated_parts(moments: np.ndarray, rows: int, parts: int) -> list[list[int]]:
    """Split the bits into `parts` groups of about equal size, strongly correlated bits together."""
    mean = np.diag(moments) / max(rows, 1)
    cov = moments / max(rows, 1) - np.outer(mean, mean)
    spread = np.sqrt(np.clip(np.diag(cov), 1e-9, None))
    corr = np.abs(cov / np.outer(spread, spread))
    left, groups = list(range(BITS)), []
    for k in range(parts):
        size = len(left) // (parts - k)
        seed = max(left, key=lambda b: corr[b, left].sum())
        group = [seed]
        left.remove(seed)
        while len(group) < size:
            best = max(left, key=lambda b: corr[b, group].mean())
            group.append(best)
            left.remove(best)
        groups.append(sorted(group))
    return groups


def pair_shares(mean: np.ndarray, most: int) -> np.ndarray:
    """Estimated share of pairs at distance <= e (e = 0..most) in a part of independent bits."""
    dist = np.zeros(most + 2)
    dist[0] = 1.0
    for q in 2 * mean * (1 - mean):
        dist[1:] = dist[1:] * (1 - q) + dist[:-1] * q
        dist[0] *= 1 - q
    return np.cumsum(dist[:most + 1])


def allocate(groups: list[list[int]], mean: np.ndarray, rows: int, distance: int) -> tuple[list[int], float]:
    """Thresholds per part (-1: not probed) of least estimated cost, by dynamic programming."""
    total = distance - len(groups) + 1
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for group in groups:
        shares = pair_shares(mean[group], distance)
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, chosen) in best.items():
            for e in range(-1, distance + 1):
                probes = sum(comb(len(group), k) for k in range(e + 1))
                price = cost + (rows * probes + shares[e] * rows * rows / 2 if e >= 0 else 0.0)
                if used + e not in step or price < step[used + e][0]:
                    step[used + e] = (price, [*chosen, e])
        best = step
    cost, chosen = best[total]
    return chosen, cost


def plan_parts(prints: DataFrame, distance: int = DISTANCE) -> tuple[list[list[int]], list[int]]:
    """The grouping and thresholds of least estimated cost over a few part counts."""
    moments, rows = bit_moments(prints)
    mean = np.diag(moments) / max(rows, 1)
    plans = []
    for parts in PART_COUNTS:
        groups = correlated_parts(moments, rows, parts)
        chosen, cost = allocate(groups, mean, rows, distance)
        plans.append((cost, groups, chosen))
    _, groups, chosen = min(plans, key=lambda p: p[0])
    return groups, chosen


def _signed(bits) -> int:
    mask = sum(1 << b for b in bits)
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def _masked(mask: int) -> Column:
    return F.lit(mask).cast("long")


def hamming(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def links(prints: DataFrame, distance: int = DISTANCE, bucket: int = BUCKET) -> DataFrame:
    """(a, b): links among distinct fingerprints that connect all pairs within `distance`.

    `prints` is a stored table of distinct longs `fp`. Buckets of up to `bucket` rows give
    verified pairs. Rows that meet a larger bucket are linked through neighbour keys
    instead: two values differ in at most two bits exactly if some value is within one bit
    of both, and at most 65 values share such a key, so work stays linear in the
    bucket. (For other distances the larger buckets are verified pair by pair.)
    """
    groups, thresholds = plan_parts(prints, distance)
    index, probes = [], []
    for part, (group, e) in enumerate(zip(groups, thresholds)):
        if e < 0:
            continue
        value = F.col("fp").bitwiseAND(_masked(_signed(group)))
        index.append(prints.select("fp", F.lit(part).alias("part"), value.alias("value")))
        flips = [0, *(_signed(c) for k in range(1, e + 1) for c in combinations(group, k))]
        tries = F.explode(F.array(*[_masked(f) for f in flips]))
        probes.append(prints.select("fp", value.alias("value"), tries.alias("flip")).select(
            F.col("fp").alias("other"), F.lit(part).alias("part"), F.col("value").bitwiseXOR(F.col("flip")).alias("value")))
    index = reduce(DataFrame.union, index)
    probes = reduce(DataFrame.union, probes)
    sizes = stage(index.groupBy("part", "value").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "buckets")
    # A value held by one row is only met by flipped probes; the equal-value index entry is the row itself.
    small = index.join(sizes.where(F.col("n") > bucket).select("part", "value"), ["part", "value"], "left_anti") \
        if distance == 2 else index
    pairs = small.join(probes, ["part", "value"]).where(
        (F.col("fp") < F.col("other")) & (hamming("fp", "other") <= distance))
    pairs = pairs.select(F.col("fp").alias("a"), F.col("other").alias("b")).distinct()
    if distance != 2:
        return pairs
    crowded = probes.join(sizes.where(F.col("n") > bucket), ["part", "value"]).select(F.col("other").alias("fp")).distinct()
    near = crowded.select("fp", F.explode(F.array(F.lit(0).cast("long"), *[
        _masked(_signed([b])) for b in range(BITS)])).alias("flip"))
    hubs = near.select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("hub"))
    least = hubs.groupBy("hub").agg(F.min("fp").alias("a"), F.max("fp").alias("most")).where("a < most")
    starred = hubs.join(least, "hub").where(F.col("fp") != F.col("a")).select("a", F.col("fp").alias("b")).distinct()
    return pairs.union(starred)


def simhash_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", distance: int = DISTANCE,
                   bucket: int = BUCKET) -> DataFrame:
    """One row per document: key, `fingerprint` (16 hex digits), `component_id`, `copies`.

    Documents link where fingerprints differ in at most `distance` bits; `component_id` is
    the smallest key reachable, `copies` the number of documents with the same
    fingerprint. Null and empty texts have fingerprint zero and link like any other; null
    keys are kept and never name a component unless all are null. Equal rows stay equal
    rows. An empty table gives an empty one. Other columns of `docs` are ignored.
    """
    prints = stage(docs.select(F.col(key), fingerprint(F.col(text)).alias("fp")), "fingerprints")
    distinct = stage(prints.groupBy("fp").agg(F.min(key).alias("least"), F.count(F.lit(1)).alias("copies")), "distinct")
    roots = connected(links(distinct.select("fp"), distance, bucket), "a", "b").withColumnRenamed("node", "fp")
    member = distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = member.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = member.join(named, "root").select("fp", "component_id", "copies")
    return prints.join(classes, "fp").select(
        key, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "copies")
