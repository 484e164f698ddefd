"""Ranked lexical search by the Best Position Algorithm over blocks of documents.

Documents are indexed in blocks of bounded size. In a block every query term has an impact list
(its documents by falling impact). A query reads the lists from the top, looks up every document it
meets in all its other lists (direct accesses), and marks the positions it has seen there. The
best position of a list is the last one up to which all have been seen, by either kind of access;
no document that is still unseen can score more than the sum of the impacts there. A query stops
when that sum is strictly below its k-th score, so ties are never lost. A task carries the k-th
score of a query from one block to the next.
"""

from __future__ import annotations

import math
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from wardlight.llm.common import present, slices, stage

#: The characters that separate terms, and the constants of the score.
SEPARATORS = bytes(c for c in range(128) if not chr(c).isalnum())
SCALE, SATURATION, LENGTH_SHARE, UNIT = 1_000_000_000, 12, 25, 100

#: Production parameters.
TOP = 20
BLOCK_POSTINGS = 1_000_000  # postings after which a block of the index is closed
BLOCK_DOCS = 100_000
QUERY_CHARS = 4_000_000     # characters of the queries that are answered in one pass
FIRST_DEPTH = 32            # positions read before the first test; then twice as many each time

_TERMS = bytes.maketrans(string.ascii_uppercase.encode() + SEPARATORS,
                         string.ascii_lowercase.encode() + b" " * len(SEPARATORS))
_MARK = b"."  # the end of a text among its terms; no term holds it

BLOCK = ("docs array<long>, lengths array<long>, terms array<int>, held array<long>, places array<int>, counts array<long>")


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_TERMS).split()


class _Block:
    """Postings of the query terms in the documents that a task has read since the last block."""

    def __init__(self, known: dict[bytes, int]):
        self.known = known
        self.clear()

    def clear(self) -> None:
        self.docs: list = []
        self.lengths, self.codes, self.counts, self.postings = [], [], [], 0

    def add(self, docs: list, texts: list[bytes]) -> None:
        tokens = b" . ".join([t.translate(_TERMS) for t in texts] + [b""]).split()
        get = self.known.get
        ids = np.fromiter((get(w, -1) for w in tokens), np.int64, len(tokens))
        ends = np.flatnonzero(ids == -2)
        place = np.cumsum(ids == -2) + len(self.docs)
        hit = ids >= 0
        codes, n = np.unique(ids[hit] * (1 << 32) + place[hit], return_counts=True)
        self.lengths.append(np.diff(np.concatenate([[-1], ends])) - 1)
        self.docs += docs
        self.codes.append(codes)
        self.counts.append(n)
        self.postings += len(codes)

    def full(self) -> bool:
        return self.postings >= BLOCK_POSTINGS or len(self.docs) >= BLOCK_DOCS

    def take(self) -> pa.RecordBatch:
        codes, n = np.concatenate(self.codes), np.concatenate(self.counts)
        order = np.argsort(codes, kind="stable")
        codes, n = codes[order], n[order]
        terms, held = np.unique(codes >> 32, return_counts=True)
        one = lambda values, kind: pa.array([values], pa.list_(kind))
        row = pa.record_batch(
            [one(self.docs, pa.int64()), one(np.concatenate(self.lengths), pa.int64()), one(terms, pa.int32()), one(held, pa.int64()),
             one(codes & 0xFFFFFFFF, pa.int32()), one(n, pa.int64())], [c.split()[0] for c in BLOCK.split(", ")])
        self.clear()
        return row


def index_blocks(docs: DataFrame, known: dict[bytes, int], key: str, text: str) -> DataFrame:
    """The documents in blocks: ids and lengths, and by term the places and counts of its postings."""
    marks = {**known, _MARK: -2}

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = _Block(marks)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()
            at = 0
            for part in slices(texts):
                block.add(ids[at:at + len(part)], part)
                at += len(part)
                if block.full():
                    yield block.take()
        if block.docs:
            yield block.take()

    return docs.select(F.col(key).cast("long").alias("doc"), present(F.col(text)).alias("text")).mapInArrow(build, BLOCK)


class _Lists:
    """The impact lists of a block, and where each document stands in them."""

    def __init__(self, row: dict, n_docs: int, n_terms: int):
        lengths, places, tf = (row[c] for c in ("lengths", "places", "counts"))
        self.ids, self.late = row["docs"], row["late"]
        self.term_of = np.repeat(row["terms"], row["held"])
        m = UNIT - LENGTH_SHARE + LENGTH_SHARE * lengths * n_docs // max(n_terms, 1)
        impact = SCALE * tf // (1000 * tf + SATURATION * m[places])
        order = np.lexsort((places, -impact, self.term_of))
        self.doc, self.impact = places[order], impact[order]
        self.start = np.concatenate([[0], np.cumsum(row["held"])])
        self.list_of = {int(t): i for i, t in enumerate(row["terms"])}
        self.by_doc = np.argsort(self.doc, kind="stable")  # positions of each document's postings
        self.doc_start = np.searchsorted(self.doc[self.by_doc], np.arange(len(lengths) + 1))
        self.seen, self.scored = np.zeros(len(self.doc), bool), np.zeros(len(lengths), bool)


def _ranges(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """start[0] .. end[0] - 1, start[1] .. end[1] - 1, ..."""
    size = end - start
    return np.repeat(start - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())


class _Best:
    """The k best (score, document) so far."""

    def __init__(self, k: int):
        self.k = k
        self.score, self.id, self.late = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def bar(self) -> int:
        """The k-th score; below zero while there are fewer."""
        return int(self.score[-1]) if len(self.score) == self.k else -1

    def add(self, score: np.ndarray, ids: np.ndarray, late: np.ndarray) -> None:
        good = (score > 0) & (score >= self.bar())
        score, ids, late = (np.concatenate([a, b[good]]) for a, b in ((self.score, score), (self.id, ids), (self.late, late)))
        order = np.lexsort((ids, late, -score))[:self.k]
        self.score, self.id, self.late = score[order], ids[order], late[order]


def best_positions(lists: _Lists, query: dict[int, int], weight: np.ndarray, best: _Best) -> int:
    """Bring `best` up to date with one block for a query (term: repeats); returns how many documents were scored."""
    mine = [(lists.list_of[t], q * int(weight[t])) for t, q in query.items() if t in lists.list_of]
    mine = [(i, w) for i, w in mine if w > 0]
    if not mine:
        return 0
    which, factor = np.array([i for i, _ in mine]), np.array([w for _, w in mine])
    first, last = lists.start[which], lists.start[which + 1]
    value = np.zeros(len(lists.start) - 1, np.int64)
    value[which] = factor
    slot = np.repeat(np.arange(len(lists.start) - 1), np.diff(lists.start)) if not hasattr(lists, "slot") else lists.slot
    lists.slot = slot
    reached, best_at, depth, count = first.copy(), first.copy(), FIRST_DEPTH, 0
    touched = []
    while True:
        to = np.minimum(first + depth, last)
        fresh = np.unique(lists.doc[_ranges(reached, to)])          # sorted accesses
        fresh = fresh[~lists.scored[fresh]]
        reached, depth = to, 2 * depth
        if len(fresh):
            lists.scored[fresh] = True
            count += len(fresh)
            begin, end = lists.doc_start[fresh], lists.doc_start[fresh + 1]
            at = lists.by_doc[_ranges(begin, end)]                  # direct accesses
            lists.seen[at] = True
            touched.append(fresh)
            score = np.add.reduceat(value[slot[at]] * lists.impact[at], np.concatenate([[0], np.cumsum(end - begin)[:-1]]))
            best.add(score, lists.ids[fresh], lists.late[fresh])
        for j in range(len(which)):                                 # best positions
            rest = lists.seen[best_at[j]:last[j]]
            gap = int(rest.argmin()) if len(rest) else 0
            best_at[j] = last[j] if len(rest) and rest[gap] else best_at[j] + gap
        open_ = best_at < last
        bound = int((factor[open_] * lists.impact[best_at[open_] - 1]).sum())
        if not open_.any() or bound < best.bar():
            break
    done = np.concatenate(touched) if touched else np.zeros(0, np.int64)
    lists.scored[done] = False
    lists.seen[lists.by_doc[_ranges(lists.doc_start[done], lists.doc_start[done + 1])]] = False
    return count


def _answers(blocks: DataFrame, queries: list[dict[int, int]], weight: np.ndarray, n_docs: int, n_terms: int, top: int) -> DataFrame:
    """(query, doc, score): per task the best documents of each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [_Best(top) for _ in queries]
        for batch in batches:
            for r in range(batch.num_rows):
                row = {}
                for name in batch.schema.names:
                    values = batch.column(name)[r].values
                    if name == "docs":
                        row["late"] = values.is_null().to_numpy(zero_copy_only=False)
                        values = values.fill_null(0)
                    row[name] = values.to_numpy(zero_copy_only=False).astype(np.int64)
                lists = _Lists(row, n_docs, n_terms)
                for query, found in zip(queries, best):
                    best_positions(lists, query, weight, found)
        for i, found in enumerate(best):
            docs = pa.array(found.id, mask=found.late)
            yield pa.record_batch([pa.array(np.full(len(docs), i, np.int64)), docs, pa.array(found.score)], ["query", "doc", "score"])

    return blocks.mapInArrow(run, "query long, doc long, score long")


def search(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id",
           item_text: str = "text", top: int = TOP) -> DataFrame:
    """The `top` best documents of each item: item_id, rank, doc_id, score (columns `item` and `key`).

    Terms, weights and scores are those of the query contract (integers but for the logarithm of a
    weight); equal scores go by ascending key, nulls last. Only positive scores are returned.
    Items are answered in passes of QUERY_CHARS characters: the terms of one pass are held by
    every task, the documents stay where they are, and each task returns `top` rows an item.

    Null and empty texts have no terms; repeated documents are ranked each; repeated items
    are answered once, and two items that share an id but not a text are ranked each on its own.
    A long text adds to one block as a whole. Empty tables give no row; other columns are ignored.
    """
    asked = stage(items.select(F.col(item).alias("item"), present(F.col(item_text)).alias("asked")).distinct(), "queries")
    chars = asked.agg(F.sum(F.length("asked"))).first()[0] or 0
    passes = -(-chars // QUERY_CHARS)
    found = None
    for turn in range(passes):
        held = asked.where(F.pmod(F.xxhash64("item", "asked"), F.lit(passes)) == turn).collect()  # about QUERY_CHARS characters
        known: dict[bytes, int] = {}
        queries, names = [], []
        for row in held:
            query: dict[int, int] = {}
            for term in terms_of(row["asked"].encode()):
                t = known.setdefault(term, len(known))
                query[t] = query.get(t, 0) + 1
            if query:
                names.append((len(queries), row["item"]))
                queries.append(query)
        if not queries:
            continue
        blocks = stage(index_blocks(docs, known, key, text), "impact-blocks")
        size = blocks.select(F.explode("lengths").alias("n")).where("n > 0").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("terms")).first()
        holders = blocks.select(F.inline(F.arrays_zip("terms", "held"))).groupBy("terms").agg(F.sum("held").alias("df")).collect()  # the terms of one pass
        n_docs, n_terms = size["docs"], size["terms"] or 0
        weight = np.zeros(len(known), np.int64)
        for h in holders:
            weight[h["terms"]] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * h["df"] + 1)))
        answers = _answers(blocks, queries, weight, n_docs, n_terms, top)
        order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc"))
        ranked = answers.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
        kind = items.schema[item].dataType.simpleString()
        ids = items.sparkSession.createDataFrame(names, f"query long, item {kind}")
        named = ranked.join(F.broadcast(ids), "query").select(F.col("item").alias(item), "rank", F.col("doc").alias(key), "score")
        found = named if found is None else found.union(named)
    if found is None:
        return asked.where("false").select(F.col("item").alias(item), F.lit(1).alias("rank"), F.lit(0).cast("long").alias(key), F.lit(0).cast("long").alias("score"))
    return found
