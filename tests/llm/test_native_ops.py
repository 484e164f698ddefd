"""Quality rules, line join, SimHash groups, winnowing and mixing against plain Python."""

import hashlib
import math
import re
import textwrap
from collections import Counter, defaultdict

import pytest
import xxhash
from conftest import SF_DIR
from pyspark.sql import functions as F

from wardlight.llm import line_join, mixing, quality_lines, queries, simhash_groups, winnow

BLANK = re.compile(r"[\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, source string, n_words string, fp string, w string, id string, line string"


def split(text, gaps=BLANK):
    return [w for w in gaps.split(text or "") if w]


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}


def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows and clashing names."""
    prose = "The cat sat on the mat and looked at the moon above the old town hall."
    rows = [(1, None, None), (2, "", "a"), (3, " \n\t ", "a"), (4, prose, "a"), (4, prose, "a"), (5, prose, None),
            (None, prose + " Then it slept.", "b"), (6, "\n".join([prose] * 3), "b"), (7, "x " * 30000 + "end.", "b"),
            (8, prose.replace("cat", "hat"), "c"), (9, "É" * 40 + ".", "c")]
    return spark.createDataFrame([(i, t, s, "0", "0", "0", "0", "0") for i, t, s in rows], DOCS)


def quality_of(text):
    words = split(text)
    lines = [x for x in (text or "").split("\n") if split(x)]
    grams = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    hit = {i + k for i in range(len(words) - 2) if grams[tuple(words[i:i + 3])] > 1 for k in range(3)}
    failed = len(words) < 50 or 100 * len(hit) > 50 * len(words)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""),
            len(lines) - len(set(lines)), len(hit), failed)


END = r"[.!?…:;][\"'”’»)\]]*[\x20\x09-\x0D]*\Z"


def line_ok(line, after=""):
    words = split(line)
    wrapped = len(line) >= 40 and split(after) and (len(after) >= 40 or re.search(END, after))
    ends = re.search(END, line) or len(words) > quality_lines.MENU_WORDS or wrapped
    loud = len(re.findall(r"(?:[#*$%&|<>]|!!|\?\?)[.,]?(?:[\x20\x09-\x0D]|\Z)", line))
    menu = sum(c in quality_lines.MENU_MARKS for c in line)
    return bool(ends) and loud <= 0.3 * len(words) and 3 * menu < len(words) and not re.search(quality_lines.FURNITURE, line)


def test_quality(spark, docs):
    for table in (docs, odd(spark)):
        for r in quality_lines.line_quality(table).collect():
            got = (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"])
            assert got == quality_of(r["text"])
            every = (r["text"] or "").split("\n")
            kept = [x for x, y in zip(every, every[1:] + [""]) if not split(x) or line_ok(x, y)]
            assert r["cleaned"] == "\n".join(kept)
            left = sum(map(len, split("\n".join(kept))))
            assert r["kept"] == (not got[-1] and 1 - left / got[1] <= quality_lines.MAX_LOST)


def test_quality_cleans(spark):
    prose = "\n".join(" ".join(f"word{i}x{j}" for j in range(14)) + "." for i in range(9))
    menu = "Home | News | Sport | Contact\n" * 3
    rows = [(1, prose), (2, menu + prose), (3, menu * 20 + prose), (4, "WORD!! " * 80 + ".")]
    got = {r["doc_id"]: r for r in quality_lines.line_quality(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i]["kept"] for i in (1, 2, 3, 4)] == [True, True, False, False]
    assert got[1]["cleaned"] == prose and got[2]["cleaned"] == prose


def test_quality_wrapped(spark, docs):
    """Clean texts stay clean when their lines are broken at 72 columns; short menus still go."""
    kept = [r["text"] for r in quality_lines.line_quality(docs).where("kept").select("text").collect()]
    broken = ["\n".join(y for x in t.split("\n") for y in textwrap.wrap(x, 72) or [""]) for t in kept]
    rows = spark.createDataFrame(list(enumerate(broken)), "doc_id long, text string")
    got = quality_lines.line_quality(rows).select("kept").collect()
    assert sum(r["kept"] for r in got) >= 0.99 * len(got)
    menu = "Latest news from the region\nAll offers of the week\nContact and opening hours\n" * 30
    assert not quality_lines.line_quality(spark.createDataFrame([(1, menu)], "doc_id long, text string")).first()["kept"]


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_banded_distance(spark):
    import random
    rnd = random.Random(5)
    pairs = [("", ""), ("a", ""), ("", "abc"), ("ab", "ba"), ("aaaa", "aaa"), ("éab", "eab")]
    for _ in range(400):
        a = "".join(rnd.choice("abcé") for _ in range(rnd.randint(0, 14)))
        b = list(a)
        for _ in range(rnd.randint(0, 4)):
            spot = rnd.randint(0, len(b))
            b[spot:spot + rnd.randint(0, 1)] = rnd.choice(["", "a", "z"])
        pairs.append((a, "".join(b)))
    df = spark.createDataFrame(pairs, "a string, b string")
    for k in (1, 2, 3):
        for r in df.select("a", "b", line_join.banded_distance(F.col("a"), F.col("b"), k).alias("d")).collect():
            assert r["d"] == min(edit(r["a"], r["b"]), k + 1), (r, k)


def lines_of(text):
    return [(i, x.strip(" \t\n\x0b\x0c\r")) for i, x in enumerate((text or "").split("\n")) if split(x)]


def test_edit_links(spark, docs):
    import random
    rnd = random.Random(2)
    base = [x for t in docs.limit(20).collect() for _, x in lines_of(t["text"])][:60]
    extra = []
    for x in base:
        for _ in range(3):
            y = list(x)
            for _ in range(rnd.randint(1, 4)):
                spot = rnd.randint(0, len(y))
                y[spot:spot + rnd.randint(0, 1)] = rnd.choice(["", "q", "é"])
            extra.append("".join(y))
    short = ["".join(rnd.choice("abé") for _ in range(rnd.randint(1, 7))) for _ in range(60)]
    close = ["Call us at the main office", "Call us at the main offica", "x" * 29, "x" * 31]
    every = sorted({x for x in base + extra + short + close if x})
    want = {frozenset((a, b)) for i, a in enumerate(every) for b in every[:i] if abs(len(a) - len(b)) <= 2 and edit(a, b) <= 2}
    got = links_of(spark, every)
    assert len(got) == len(set(got)) and set(got) == want and frozenset(close[:2]) in want and frozenset(close[2:]) in want


def links_of(spark, every):
    df = spark.createDataFrame([(x,) for x in every], "line string").withColumn("id", F.xxhash64("line"))
    lines = {r["id"]: r["line"] for r in df.collect()}
    return [frozenset((lines[r["a"]], lines[r["b"]])) for r in line_join.edit_links(line_join.distinct_lines(df)).collect()]


def near_by_deletions(words):
    """Pairs within two edits: they share a text that two deletions leave, and are then measured."""
    holders = defaultdict(set)
    for w in words:
        for i in range(len(w) + 1):
            for j in range(i + 1):
                v = w[:i] + w[i + 1:]
                holders[v[:j] + v[j + 1:]].add(w)
    return {frozenset((a, b)) for ws in holders.values() for a in ws for b in ws if a < b and edit(a, b) <= 2}


def test_template_lines(spark, monkeypatch):
    """Lines of one template that differ in their numbers; every key of the template is crowded."""
    import random
    rnd = random.Random(4)
    codes = {f"{rnd.randrange(10**6):06d}" for _ in range(2000)}
    codes |= {c[:3] + rnd.choice("0123456789") + c[4:] for c in sorted(codes)[:60]} | {c[:2] + c[3:] for c in sorted(codes)[:40]}
    codes |= {c[:6] + c[7:] + "77" for c in sorted(codes)[40:60]} | {c[:1] + "5" + c[1:] for c in sorted(codes)[60:80]}
    lines = lambda c: f"Product code {c} is available in the main store today"
    want = {frozenset(map(lines, pair)) for pair in near_by_deletions(codes)}
    compared = []
    real = line_join.stage
    monkeypatch.setattr(line_join, "stage", lambda df, name: (lambda t: compared.append((name, t.count())) or t)(real(df, name)))
    got = links_of(spark, [lines(c) for c in sorted(codes)])
    assert set(got) == want and len(got) == len(want) > 100
    assert sum(n for name, n in compared if name == "met-lines") < 40 * len(codes)  # all pairs: 1,066 a line


def test_line_classes(spark, docs, texts):
    rows = line_join.line_classes(docs).collect()
    assert len(rows) == sum(len(lines_of(t)) for t in texts.values())
    copies = Counter(x for t in texts.values() for _, x in lines_of(t))
    classes = defaultdict(list)
    for r in rows:
        line = dict(lines_of(texts[r["doc_id"]]))[r["line_no"]]
        assert r["n_copies"] == copies[line]
        classes[r["class_id"]].append((r["doc_id"], r["line_no"], r["kept"], line))
    for members in classes.values():
        members.sort()
        assert [m[2] for m in members] == [True] + [False] * (len(members) - 1)
    shown = [r for r in line_join.line_classes(odd(spark)).collect()]
    assert len(shown) == 4 + 3 + 1 + 1 + 1
    assert {r["n_links"] for r in shown if r["doc_id"] == 8} == {1}


def fingerprint(text):
    words = split(lower(text))
    if not words:
        return 0
    count = [0] * 64
    runs = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    for run in runs:
        h = xxhash.xxh64_intdigest(run.encode(), 42)
        for b in range(64):
            count[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * count[b] > len(runs))


def components(prints):
    """prints: key -> fingerprint."""
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    values = sorted(set(prints.values()))
    for i, a in enumerate(values):
        for b in values[:i]:
            if (a ^ b).bit_count() <= 2:
                root[find(a)] = find(b)
    least = defaultdict(list)
    for key, v in prints.items():
        least[find(v)].append(key)
    return {key: min(m) for m in least.values() for key in m}


@pytest.mark.parametrize("bucket", [simhash_groups.BUCKET, 1])
def test_simhash(docs, texts, bucket):
    got = {r["doc_id"]: r for r in simhash_groups.simhash_groups(docs, bucket=bucket).collect()}
    want = {k: fingerprint(t) for k, t in texts.items()}
    assert {k: r["fingerprint"] for k, r in got.items()} == {k: f"{v:016x}" for k, v in want.items()}
    assert {k: r["component_id"] for k, r in got.items()} == components(want)


@pytest.mark.parametrize("bucket", [64, 2])
def test_simhash_links(spark, bucket):
    import random
    rnd = random.Random(1)
    seeds = [rnd.getrandbits(64) for _ in range(60)]
    values = sorted({s ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, 3))) for s in seeds for _ in range(6)})
    table = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp long")
    prints = queries.table(spark, SF_DIR, "documents").sparkSession.createDataFrame(table.toPandas())
    edges = [(r["a"] % 2 ** 64, r["b"] % 2 ** 64) for r in simhash_groups.links(prints, bucket=bucket).collect()]
    assert all((a ^ b).bit_count() <= 2 for a, b in edges)
    root = {v: v for v in values}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in edges:
        root[find(a)] = find(b)
    for i, a in enumerate(values):
        for b in values[:i]:
            if (a ^ b).bit_count() <= 2:
                assert find(a) == find(b)


def test_allocation_covers():
    import numpy as np
    for parts in (2, 3, 4):
        groups = simhash_groups.correlated_parts(np.eye(64) * 50 + 25, 100, parts)
        chosen, _ = simhash_groups.allocate(groups, np.full(64, 0.5), 100, 2)
        assert sum(chosen) == 2 - parts + 1 and sorted(b for g in groups for b in g) == list(range(64))


def test_simhash_odd_rows(spark):
    got = simhash_groups.simhash_groups(odd(spark)).collect()
    assert len(got) == 11
    empty = [r for r in got if r["fingerprint"] == "0" * 16]
    assert {r["doc_id"] for r in empty} == {1, 2, 3} and {r["component_id"] for r in empty} == {1}
    assert not simhash_groups.simhash_groups(odd(spark).where("false")).collect()


def contamination(texts, items):
    """Plain windows over plain words."""
    gap = re.compile(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = defaultdict(set)
    for item, t in items:
        w = split(lower(t), gap)
        n = min(13, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            windows[tuple(w[i:i + n])].add(str(item))
    sizes = {len(x) for x in windows}
    for key, t in texts:
        w, hit, found = split(lower(t), gap), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (x := tuple(w[i:i + n])) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[x]
        sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        yield key, len(w), len(hit), len(found), sha, bool(hit) and 20 * len(hit) >= len(w)


def listed(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_winnowing(spark, docs, texts):
    bench = spark.read.parquet(f"{SF_DIR}/benchmark.parquet")
    items = [tuple(r) for r in bench.select("item_id", "text").collect()]
    want = sorted(contamination(texts.items(), items), key=str)
    assert listed(winnow.contamination(docs, bench)) == want and any(r[-1] for r in want)


def test_winnowing_odd_rows(spark):
    table = odd(spark)
    items = [(1, None), (2, ""), (3, "Looked at the moon"), (4, "x"), (None, "the old town hall"), (5, "x " * 20),
             (5, "x " * 20), (6, "the cat sat on the mat and looked at the moon above the OLD, town")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    pairs = [(r["doc_id"], r["text"]) for r in table.collect()]
    want = sorted(contamination(pairs, [(i, t) for i, t in items if i is not None]), key=str)
    assert listed(winnow.contamination(table, bench.where("item_id is not null"))) == want
    assert winnow.contamination(table, bench).count() == table.count()
    assert not winnow.contamination(table.where("false"), bench).collect()
    assert {r["n_hit"] for r in winnow.contamination(table, bench.where("false")).collect()} == {0}


def test_mixing(spark, docs):
    sizes = spark.createDataFrame([("a", 1000), ("b", 100), ("c", 10), ("d", 0)], "source string, tokens long")
    for target, repeats in ((0.9, 100.0), (1.1, 5.0), (0.1, 100.0), (1.1, 1000.0)):
        got = {r["source"]: r for r in mixing.source_weights(sizes, entropy=target, repeats=repeats).collect()}
        w = {k: r["weight"] for k, r in got.items()}
        alpha, counts = got["a"]["alpha"], {"a": 1000, "b": 100, "c": 10}
        raised = {k: (v / 1000) ** alpha for k, v in counts.items()}
        assert set(w) == set(counts)
        assert all(abs(w[k] - raised[k] / sum(raised.values())) < 1e-8 for k in w)
        entropy = -sum(x * math.log(x) for x in w.values()) / math.log(3)
        most = max(w[k] * 1110 / counts[k] for k in w)
        if alpha in (0.0, 1.0):
            assert (alpha == 0.0) == (target > 1 and repeats > 100)
        else:
            assert abs(entropy - target) < 1e-5 or abs(most - repeats) < 1e-4
    rows = mixing.mix(docs, entropy=0.99, share=1.7, block_tokens=500).collect()
    assert len(rows) == docs.count()
    drawn, tokens, budget = Counter(), Counter(), {}
    for r in rows:
        drawn[r["source"]] += r["copies"] * r["n_tokens"]
        tokens[r["source"]] += r["n_tokens"]
        budget[r["source"]] = r["weight"]
    total = sum(tokens.values())
    longest = max(r["n_tokens"] for r in rows)
    for s in tokens:
        asked = budget[s] * total * 1.7
        assert asked - 1 <= drawn[s] <= asked + longest
        counts = {r["copies"] for r in rows if r["source"] == s and r["n_tokens"]}
        assert max(counts) - min(counts) <= 1


def test_mixing_odd_rows(spark):
    got = mixing.mix(odd(spark)).collect()
    assert len(got) == 11 and {r["source"] for r in got} == {"~", "a", "b", "c"}
    assert not mixing.mix(odd(spark).where("false")).collect()


def test_mixing_spreads_rows_without_a_key(spark):
    rows = spark.range(4000).selectExpr("cast(null as long) AS doc_id", "concat('word ', id, repeat(' x', 8)) AS text", "'a' AS source")
    sizes = mixing.mix(rows, block_tokens=500).groupBy("block").count().collect()
    assert len(sizes) == 80 and max(r["count"] for r in sizes) < 100
