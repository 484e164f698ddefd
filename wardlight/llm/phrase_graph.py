"""Collocations from a weighted de Bruijn graph of the words of a corpus.

Nodes are pairs of consecutive words and an edge is a run of three, weighted by its count. The
count of a pair is the flow that leaves its node plus the pieces that end in it, the count of a
word the flow of the nodes that begin with it plus the pieces that end in it.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from wardlight.llm.common import present, slices, stage

#: What ends a piece, the blanks between its words, the name of no language.
PIECE_END = ".,;:!?\n\x0b\x0c\r"
GAP = " \t"
NO_LANG = "und"

#: Production parameters.
LEAST = 10        # occurrences that make a candidate
SHARE = (50, 100)  # a longer candidate with this share of the occurrences replaces a phrase
SCALE = 1_000_000
TOP = 2000        # phrases reported per language
SPREAD = 64       # parts in which a language is ranked

HELD = 1_000_000  # words that a task adds up at a time

_END = b"."  # stands for every piece end; no word holds it
_FOLD = bytes.maketrans((string.ascii_uppercase + PIECE_END + GAP).encode(),
                        (string.ascii_lowercase + "." * len(PIECE_END) + " " * len(GAP)).encode())
_ROWS = 100_000   # of an Arrow batch


def _first_words(phrase: Column, n: int) -> Column:
    return F.substring_index(phrase, " ", n)


def _last_words(phrase: Column, n: int) -> Column:
    return F.substring_index(phrase, " ", -n)


def _size(phrase: Column) -> Column:
    """Words of a phrase (1 to 3)."""
    return F.length(phrase) - F.length(F.replace(phrase, F.lit(" "))) + 1


class _Graph:
    """The part of the graph that one task has seen since it last gave out its counts."""

    def __init__(self):
        self.word_ids: dict[bytes, int] = {_END: 0}
        self.parts: dict[str, list[np.ndarray]] = {}
        self.size = 0

    def add(self, lang: str, texts: list[bytes]) -> None:
        tokens = (b".".join(texts).translate(_FOLD).replace(_END, b" . ") + b" .").split()
        ids = self.word_ids
        self.parts.setdefault(lang, []).append(np.fromiter((ids.setdefault(w, len(ids)) for w in tokens), np.int64, len(tokens)))
        self.size += len(tokens)

    def counts(self) -> Iterator[pa.RecordBatch]:
        """(lang, node, word, n): edges from a node to the next word, the pieces that end in a node (no next
        word), words (under themselves) and the number of words (under the empty node)."""
        names = pa.array(self.word_ids, pa.binary()).cast(pa.string())
        nexts = pa.concat_arrays([pa.array([""]), names.slice(1)])  # no word after a piece's end
        for lang, parts in self.parts.items():
            ids = np.concatenate([*parts, np.zeros(2, np.int64)])
            x, y, z = ids[:-2], ids[1:-1], ids[2:]
            pair = (x > 0) & (y > 0)
            (u, v), edge_n = _distinct(x[pair], y[pair], z[pair], len(names))
            last, last_n = _counted(x[(x > 0) & (y == 0)])  # pieces that end in a word's first node
            word, word_n = _summed(np.concatenate([u // len(names), last]), np.concatenate([edge_n, last_n]))
            words = lambda i: names.take(pa.array(i))
            for node, after, n in ((pc.binary_join_element_wise(words(u // len(names)), words(u % len(names)), " "), nexts.take(pa.array(v)), edge_n),
                                   (words(word), pa.array([""] * len(word), pa.string()), word_n),
                                   (pa.array([""]), pa.array([""]), np.array([word_n.sum()]))):
                for i in range(0, len(n), _ROWS):
                    part = node.slice(i, _ROWS)
                    yield pa.record_batch([pa.array([lang] * len(part), pa.string()), part, after.slice(i, _ROWS), pa.array(n[i:i + _ROWS])],
                                          ["lang", "node", "word", "n"])
        self.__init__()


def _counted(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(codes, return_counts=True)


def _summed(codes: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes and the sums of n."""
    order = np.argsort(codes, kind="stable")
    codes = codes[order]
    heads = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else np.zeros(0, np.int64)
    return codes[heads], np.add.reduceat(n[order], heads) if len(heads) else np.zeros(0, np.int64)


def _distinct(x: np.ndarray, y: np.ndarray, z: np.ndarray, size: int):
    """Distinct (pair code, word) of three ids below `size`, with counts."""
    pairs = x * size + y
    if size < 1 << 21:
        codes, n = _counted(pairs * size + z)
        return (codes // size, codes % size), n
    kept, at = np.unique(pairs, return_inverse=True)  # one text with millions of words
    codes, n = _counted(at * size + z)
    return (kept[codes // size], codes % size), n


def phrase_counts(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST) -> DataFrame:
    """(lang, phrase, n): exact counts of all phrases of one to three words that occur `least`
    times, and the number of word occurrences under the empty phrase. Stored.

    Each task adds up the graph of a million words before it gives out the counts, so a key
    has few rows per task however frequent it is; adding up again before the shuffle would only spill.
    Edges are shuffled by the node they leave; a node's count is the flow that leaves it plus the
    pieces that end in it, added up from the same shuffle.
    """
    rows = docs.select(F.coalesce(F.col(lang), F.lit(NO_LANG)).alias("lang"), present(F.col(text)).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph = _Graph()
        for batch in batches:
            groups: dict[str, list[bytes]] = {}
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                groups.setdefault(name, []).append(body)
            for name, texts in groups.items():
                for part in slices(texts):
                    graph.add(name, part)
                    if graph.size > HELD or len(graph.word_ids) > HELD // 4:
                        yield from graph.counts()
        yield from graph.counts()

    parts = rows.mapInArrow(count, "lang string, node string, word string, n long")
    flow = parts.repartition("lang", "node").groupBy("lang", "node", "word").agg(F.sum("n").alias("n"))
    # Both sides of the union read one shuffle; a filter on the word alone would be pushed below it and split it.
    edges = flow.where(F.when(F.col("word") == "", 0).otherwise(F.col("n")) >= least).select(
        "lang", F.concat_ws(" ", "node", "word").alias("phrase"), "n")
    nodes = flow.groupBy("lang", "node").agg(F.sum("n").alias("n")).where((F.col("n") >= least) | (F.col("node") == ""))
    return stage(edges.union(nodes.select("lang", F.col("node").alias("phrase"), "n")), "phrase-counts")


def unary_paths(counts: DataFrame) -> DataFrame:
    """(lang, words, n): the frequent edges, those on one unary path joined to one run of words.

    An edge is unary if it occurs as often as both its nodes: they never occur without each
    other. Pieces end, so a path never returns to its start. Heads of paths are found by
    pointer doubling; a path is as long as a part of one piece. Stored.
    """
    three = counts.where(_size(F.col("phrase")) == 3).select(
        "lang", "phrase", "n", _first_words(F.col("phrase"), 2).alias("u"), _last_words(F.col("phrase"), 2).alias("v"))
    node = counts.where(_size(F.col("phrase")) == 2)
    at = lambda c: node.select("lang", F.col("phrase").alias(c), F.col("n").alias(f"n_{c}"))
    edges = stage(three.join(at("u"), ["lang", "u"]).join(at("v"), ["lang", "v"]).withColumn(
        "unary", (F.col("n") == F.col("n_u")) & (F.col("n") == F.col("n_v"))), "graph-edges")
    # A unary edge belongs to the node it leads to; its way back leads to the path's first node.
    back = stage(edges.where("unary").select("lang", "phrase", "n", F.col("v").alias("node"), F.col("u").alias("head"), F.lit(1).alias("far")), "path-heads")
    while True:
        jump = back.select("lang", F.col("node").alias("head"), F.col("head").alias("next"), F.col("far").alias("more"))
        step = back.join(jump, ["lang", "head"], "left")
        if step.where(F.col("next").isNotNull()).isEmpty():
            break
        back = stage(step.select("lang", "phrase", "n", "node", F.coalesce("next", "head").alias("head"),
                                 (F.col("far") + F.coalesce("more", F.lit(0))).alias("far")), "path-heads")
    words = F.array_sort(F.collect_list(F.struct("far", _last_words(F.col("phrase"), 1).alias("word"))))
    paths = back.groupBy("lang", "head").agg(F.max("n").alias("n"), F.transform(words, lambda s: s["word"]).alias("tail"))
    joined = paths.select("lang", F.concat(F.split("head", " "), F.col("tail")).alias("words"), "n")
    return stage(joined.union(edges.where(~F.col("unary")).select("lang", F.split("phrase", " "), "n")), "unary-paths")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, top: int = TOP) -> DataFrame:
    """The best phrases of two and three words per language: lang, rank, phrase, a, l, r, n, score.

    Texts are lower-cased (A-Z only) and split into pieces at sentence marks and line ends;
    `a` counts a phrase's occurrences in pieces, overlaps included, and `n` all words of the
    language. A cut after the first k words has l = f(first part), r = f(rest) and score
    floor(10^6 a a / (l r)); the lowest cut counts, ties to the smallest k. Phrases inside a longer
    candidate with half of their occurrences are dropped. Order: score and a descending, then the
    phrase's bytes. Products go through 38-digit decimals.

    Null and empty texts have no words; a null language is `und`; repeated rows count as
    often as they occur; an empty table, or one without frequent phrases, gives no row; other
    columns are ignored. A long text is one row of the tokenising task.
    """
    counts = phrase_counts(docs, text, lang, least)
    runs_of = unary_paths(counts).select("lang", "n", F.explode(F.transform(
        F.sequence(F.lit(0), F.size("words") - 3), lambda i: F.concat_ws(" ", F.slice("words", i + 1, 3)))).alias("phrase"))
    three = runs_of.select("lang", "phrase", F.col("n").alias("a"))
    inside = three.select("lang", F.explode(F.array(_first_words(F.col("phrase"), 2), _last_words(F.col("phrase"), 2))).alias("phrase"),
                          "a").groupBy("lang", "phrase").agg(F.max("a").alias("longest"))
    two = counts.where(_size(F.col("phrase")) == 2).join(inside, ["lang", "phrase"], "left").where(
        F.coalesce(SHARE[1] * F.col("longest") < SHARE[0] * F.col("n"), F.lit(True))).select("lang", "phrase", F.col("n").alias("a"))
    cuts = three.union(two).select("lang", "phrase", "a", F.explode(F.sequence(F.lit(1), _size(F.col("phrase")) - 1)).alias("k"))
    parts = cuts.select("*", F.expr("substring_index(phrase, ' ', k)").alias("first"),
                        F.expr("substring_index(phrase, ' ', k - length(phrase) + length(replace(phrase, ' ')) - 1)").alias("rest"))
    part = lambda c, n: counts.select("lang", F.col("phrase").alias(c), F.col("n").alias(n))
    scored = parts.join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"]).withColumn(
        "score", F.expr(f"({SCALE} * cast(a as decimal(16,0)) * cast(a as decimal(16,0))) div (cast(l as decimal(16,0)) * cast(r as decimal(16,0)))"))
    best = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("c"))
    order = lambda *by: F.row_number().over(
        Window.partitionBy(*by).orderBy(F.desc("c.score"), F.desc("a"), F.asc("phrase")))
    # A language's rows are ranked in SPREAD parts first, so its last task reads few rows at any size.
    some = best.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(SPREAD))).withColumn("rank", order("lang", "part")).where(F.col("rank") <= top)
    kept = some.withColumn("rank", order("lang")).where(F.col("rank") <= top)
    total = counts.where(F.col("phrase") == "").select("lang", "n")
    return kept.join(F.broadcast(total), "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "c.l", "c.r", "n", "c.score")
