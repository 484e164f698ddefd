"""The five stages, each on what its predecessor kept, against plain Python."""

from collections import defaultdict

import pytest
from conftest import SF_DIR
from test_native_ops import contamination, edit, line_ok, lines_of, odd, quality_of, split
from test_near_copies import firsts

import corpus_pipeline
from wardlight.llm import mixing


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """The table before and after each stage."""
    folder, docs = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{SF_DIR}/documents.parquet")
    tables = [docs]
    for i, (_, step) in enumerate(corpus_pipeline.STAGES):
        step(spark, tables[-1], SF_DIR).write.parquet(f"{folder}/{i}")
        tables.append(spark.read.parquet(f"{folder}/{i}"))
    assert all(t.columns == docs.columns for t in tables[:-1])
    return tables


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_quality_stage(stored):
    before, after = texts(stored[0]), texts(stored[1])
    want = {}
    for i, t in before.items():
        left = "\n".join(x for x in t.split("\n") if not split(x) or line_ok(x))
        n, chars, *_, failed = quality_of(t)
        if not failed and 1 - sum(map(len, split(left))) / chars <= 0.5:
            want[i] = left
    assert after == want and 0 < len(want) < len(before)
    assert all(r["n_chars"] == len(r["text"]) for r in stored[1].collect())


def test_line_stage(stored):
    before, after = texts(stored[1]), texts(stored[2])
    places = defaultdict(list)
    for i in sorted(before):
        for n, x in lines_of(before[i]):
            places[x].append((i, n))
    root = {x: x for x in places}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    by_size = defaultdict(list)
    for x in places:
        by_size[len(x)].append(x)
    for n, own in by_size.items():
        if n >= 20:
            for other in (x for m in (n, n + 1, n + 2) for x in by_size.get(m, ())):
                for x in own:
                    if x < other or len(other) > n:
                        same = sum(a != b for a, b in zip(x[:12], other[:12])) < 6 or x[-12:-6] == other[-12:-6]
                        if same and edit(x, other) <= 2:
                            root[find(x)] = find(other)
    first = defaultdict(list)
    for x, spots in places.items():
        first[find(x)] += spots
    kept = {min(s) for s in first.values()}
    for i, t in before.items():
        left = [x for n, x in enumerate(t.split("\n")) if not split(x) or (i, n) in kept]
        assert after[i] == "\n".join(left)


def test_near_duplicate_stage(stored):
    before, after = texts(stored[2]), texts(stored[3])
    assert set(after) == firsts(before.items()) and all(after[i] == before[i] for i in after)


def test_decontamination_stage(spark, stored):
    before, after = texts(stored[3]), texts(stored[4])
    items = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").select("item_id", "text").collect()]
    assert set(after) == {r[0] for r in contamination(before.items(), items) if not r[-1]}


def test_mixing_stage(stored):
    want = sorted(map(tuple, mixing.mix(stored[4]).collect()))
    assert sorted(map(tuple, stored[5].collect())) == want and len(want) == stored[4].count()


def test_odd_rows(spark):
    docs = odd(spark).selectExpr("*", "'en' as lang", "length(text) as n_chars")
    for table in (docs, docs.where("false")):
        for _, step in corpus_pipeline.STAGES:
            out = step(spark, table, SF_DIR)
            out.collect()
            assert step is corpus_pipeline.mixture or out.columns == table.columns
