"""A log-bilinear language model, trained by noise-contrastive estimation, over counts of all tokens.

Frequent words (the head, a bounded table) and two classes, rare word and end, are predicted
from the two classes before; a rare word is then drawn by its smoothed share of the rare
tokens. Counts come from every training text; each task trains on all of its training
texts, and the tasks' parameters are averaged by their tokens.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log10

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from wardlight.llm.common import BLANKS, crc_mod, lower_ascii, present, stage, text_key, words

#: Production parameters.
FOLDS, HELD = 7, 2      # documents whose crc32 is HELD modulo FOLDS are held out
HEAD = 20_000           # most frequent words, broadcast with their counts
VOCAB = 512             # of these, words that the model predicts one by one
DIM = 16
NOISE = 24              # noise draws, shared by the tokens of a training batch
BATCH = 8192
ROWS = 400              # texts worked at a time
RATE = 0.05            # adaptive step
TABLE = "__key string, __text long, n_tokens long, n_head long, head_log double, model_log double, n_rare long, rare array<struct<w:binary,n:int>>"


def _lower(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass").lower()  # bytes: A-Z only


class Net:
    """Class vectors: context r, target q, position weights c1 and c2, bias b.

    Classes: 0..v-1 the words, v a rare word, v + 1 the end; before a text stand ends.
    """

    def __init__(self, counts: np.ndarray, flat: np.ndarray | None = None):
        self.k = len(counts)
        sizes = [self.k * DIM, self.k * DIM, DIM, DIM]
        share = (counts + 1.0) / (counts + 1.0).sum()
        self.noise = share / share.sum()
        self.lift = np.log(NOISE * self.noise).astype(np.float32)
        if flat is None:
            rng = np.random.default_rng(7)
            flat = np.concatenate([rng.normal(0, 0.1, 2 * self.k * DIM), np.ones(DIM), np.full(DIM, 0.5), np.log(share)])
        self.flat = flat.astype(np.float32)
        r, q, self.c1, self.c2, self.b = np.split(self.flat, np.cumsum(sizes))
        self.r, self.q = r.reshape(self.k, DIM), q.reshape(self.k, DIM)

    def context(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        return self.r[one] * self.c1 + self.r[two] * self.c2

    def log_norms(self) -> np.ndarray:
        """log of the partition function for every pair of classes, in blocks of matrix products."""
        out = np.empty((self.k, self.k), np.float32)
        for two in range(self.k):
            h = self.r * self.c1 + self.r[two] * self.c2
            s = h @ self.q.T + self.b
            top = s.max(axis=1)
            out[two] = top + np.log(np.exp(s - top[:, None]).sum(axis=1))
        return out

    def fit(self, one: np.ndarray, two: np.ndarray, target: np.ndarray, rng, squares: list[np.ndarray]) -> None:
        """One noise-contrastive pass in batches; noise draws are shared within a batch.

        `squares` carries the summed squared gradients (adaptive steps) from call to call.
        """
        for at in range(0, len(target), BATCH):
            a, b, t = one[at:at + BATCH], two[at:at + BATCH], target[at:at + BATCH]
            noise = rng.choice(self.k, NOISE, p=self.noise)
            h = self.context(a, b)
            good = _sigmoid((h * self.q[t]).sum(1) + self.b[t] - self.lift[t])
            bad = _sigmoid(h @ self.q[noise].T + self.b[noise] - self.lift[noise])
            up = 1 - good
            dh = up[:, None] * self.q[t] - bad @ self.q[noise]
            dq = _summed(t, up[:, None] * h, self.k)
            np.add.at(dq, noise, -(bad.T @ h))
            dr = _summed(a, dh * self.c1, self.k) + _summed(b, dh * self.c2, self.k)
            db = np.bincount(t, up, self.k) - np.bincount(noise, bad.sum(0), self.k)
            grads = (dr, dq, (dh * self.r[a]).sum(0), (dh * self.r[b]).sum(0), db)
            for x, g, sq in zip((self.r, self.q, self.c1, self.c2, self.b), grads, squares):
                sq += (g * g).astype(np.float32)
                x += np.float32(RATE) * g.astype(np.float32) / np.sqrt(sq)

    def start(self) -> list[np.ndarray]:
        return [np.ones(x.shape, np.float32) for x in (self.r, self.q, self.c1, self.c2, self.b)]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _summed(at: np.ndarray, step: np.ndarray, k: int) -> np.ndarray:
    """Rows of `step` summed by `at` into k rows."""
    order = np.argsort(at, kind="stable")
    line = at[order]
    first = np.flatnonzero(np.append(True, line[1:] != line[:-1]))
    out = np.zeros((k, step.shape[1]), step.dtype)
    out[line[first]] = np.add.reduceat(step[order], first, axis=0)
    return out


def _classes(texts, place: dict[bytes, int], v: int) -> tuple[list[list[bytes]], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of each text, and (target, one before, two before, lengths) with an end per text."""
    split = [_lower(t).split() for t in texts]
    get = place.get
    ids = np.fromiter((c for w in split for c in (*(get(x, v) for x in w), v + 1)), np.int64)
    ids = np.where(ids < v, ids, np.where(ids == v + 1, v + 1, v))
    lengths = np.array([len(w) + 1 for w in split])
    heads = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
    one, two = np.roll(ids, 1), np.roll(ids, 2)
    one[heads] = two[heads] = v + 1
    later = heads[lengths > 1] + 1
    two[later] = v + 1
    return split, ids, one, two, lengths


def counts_of(docs: DataFrame, key: str, text: str, folds: int = FOLDS, held: int = HELD) -> DataFrame:
    """(w, c): count of every word over all training texts, combined in the tasks first."""
    rows = docs.where(crc_mod(key, folds) != held).select(F.explode(words(lower_ascii(present(text)), BLANKS)).alias("w"))
    return rows.groupBy("w").agg(F.count(F.lit(1)).alias("c"))


def score(docs: DataFrame, key: str = "doc_id", text: str = "text", folds: int = FOLDS, held: int = HELD,
          head: int = HEAD, vocab: int = VOCAB) -> DataFrame:
    """One row per document: key, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Head words are scored where they stand; the rare words of a document meet the count
    table in a join on the word, summed per document in the tasks, so the vocabulary is
    never held in one place. Null and empty texts are one end token; equal rows get equal
    results; without training texts every count is 0 and the model stays at its start;
    an empty table gives an empty one. Other columns are ignored.
    """
    docs = docs.select(F.col(key).alias("__id"), F.col(text).alias("__body"))
    counts = stage(counts_of(docs, "__id", "__body", folds, held), "word-counts")
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    ends = docs.where(crc_mod("__id", folds) != held).count()
    tokens, distinct = total["n"] + ends, total["v"] + (ends > 0)
    below = log10(tokens + distinct + 1)
    top = counts.orderBy(F.desc("c"), "w").limit(head).collect()  # at most `head` rows
    table = {r["w"].encode("utf-8", "surrogatepass"): (i, r["c"]) for i, r in enumerate(top)}
    v = min(vocab, len(top))
    seen = np.array([r["c"] for r in top[:v]] + [total["n"] - sum(r["c"] for r in top[:v]), ends], float)
    place = {w: i for w, (i, _) in table.items() if i < v}
    net = _train(docs, Net(seen), place, v, folds, held)
    norms = net.log_norms()  # (vocab + 2)^2 numbers, sent with the function
    rare_below = log10(seen[v] + total["v"] - v + 1)
    logs = {w: log10(c + 1) for w, (_, c) in table.items()}
    rare_head = {w: logs[w] for w, (i, _) in table.items() if i >= v}

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for big in batches:
            for at in range(0, len(big), ROWS):
                yield part(big.iloc[at:at + ROWS])

    def part(b: pd.DataFrame) -> pd.DataFrame:
        split, ids, one, two, lengths = _classes(b["__body"], place, v)
        h = net.context(one, two)
        p = (h * net.q[ids]).sum(1) + net.b[ids] - norms[two, one]
        owner = np.repeat(np.arange(len(b)), lengths)
        model = np.bincount(owner, p, len(b)) / np.log(10)
        rows = []
        for ws, m in zip(split, model):
            known, head_log, more, rare = 0, 0.0, 0.0, {}
            for w in ws:
                x = logs.get(w)
                if x is None:
                    rare[w] = rare.get(w, 0) + 1
                else:
                    known += 1
                    head_log += x
                    more += rare_head.get(w, 0.0)
            rows.append((len(ws) + 1, known, head_log, m + more, [{"w": w, "n": n} for w, n in rare.items()]))
        out = pd.DataFrame(rows, columns=["n_tokens", "n_head", "head_log", "model_log", "rare"])
        out.insert(4, "n_rare", np.bincount(owner, ids == v, len(b)).astype(np.int64))
        out.insert(0, "__text", b["__text"].to_numpy())
        out.insert(0, "__key", b["__key"].to_numpy())
        return out

    keyed = docs.select(*text_key("__id", "__body"), present("__body").alias("__body"))
    parts = stage(keyed.mapInPandas(work, TABLE), "head-scores")
    rare = parts.select("__key", "__text", F.explode("rare").alias("x")).select(
        "__key", "__text", F.decode("x.w", "UTF-8").alias("w"), F.col("x.n").alias("n"))
    # Equal rows give equal sums several times over: the average row is the sum of one.
    found = rare.join(counts, "w").groupBy("__key", "__text").agg(
        F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("tail_log"), F.sum("n").alias("n_tail"))
    once = parts.drop("rare").groupBy("__key", "__text").agg(
        *[F.max(c).alias(c) for c in ("n_tokens", "n_head", "head_log", "model_log", "n_rare")], F.count(F.lit(1)).alias("rows"))
    facts = once.join(found, ["__key", "__text"], "left").withColumns({
        "tail_log": F.coalesce(F.col("tail_log") / F.col("rows"), F.lit(0.0)),
        "n_tail": F.coalesce((F.col("n_tail") / F.col("rows")).cast("long"), F.lit(0))})
    ids = docs.select("__id", *text_key("__id", "__body"))
    end_log = log10(ends + 1)
    return ids.join(facts, ["__key", "__text"]).select(
        F.col("__id").alias(key), (crc_mod("__id", folds) == held).alias("held_out"), "n_tokens",
        (F.col("n_head") + F.col("n_tail") + F.lit(int(ends > 0))).cast("long").alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("head_log") + F.col("tail_log") + F.lit(end_log) - F.col("n_tokens") * F.lit(below)).alias("base_score"),
        (F.col("model_log") + F.col("tail_log") - F.col("n_rare") * F.lit(rare_below)).alias("score"))


def _train(docs: DataFrame, net: Net, place: dict[bytes, int], v: int, folds: int, held: int) -> Net:
    """Average of the parameters that each task reaches over all of its training texts."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, rng, tokens = Net(np.zeros(net.k), net.flat.copy()), np.random.default_rng(11), 0
        own.noise, own.lift, squares = net.noise, net.lift, own.start()
        for b in batches:
            for at in range(0, len(b), ROWS):
                _, ids, one, two, _ = _classes(b["__body"].iloc[at:at + ROWS], place, v)
                own.fit(one, two, ids, rng, squares)
                tokens += len(ids)
        flat = np.concatenate([own.r.ravel(), own.q.ravel(), own.c1, own.c2, own.b])
        if tokens:
            yield pd.DataFrame({"spot": np.arange(len(flat) + 1, dtype=np.int32), "x": np.append(flat, 1.0) * tokens})

    rows = docs.where(crc_mod("__id", folds) != held).select(present("__body").alias("__body"))
    summed = rows.mapInPandas(work, "spot int, x double").groupBy("spot").agg(F.sum("x").alias("x"))
    got = {r["spot"]: r["x"] for r in summed.collect()}  # one number per parameter
    if not got:
        return net
    many = got[len(net.flat)]
    out = Net(np.zeros(net.k), np.array([got[i] / many for i in range(len(net.flat))]))
    out.noise, out.lift = net.noise, net.lift
    return out
