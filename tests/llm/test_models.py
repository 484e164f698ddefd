"""Fields, language labels, language model, licences and archives against plain Python."""

import gzip
import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest import SF_DIR
from test_native_ops import odd, split

from wardlight.llm import crf, language, licences, neural_lm, pii, warc_index


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet")


def field(k=3, width=9, seed=1):
    rng = np.random.default_rng(seed)
    return crf.Model(list("abc")[:k], rng.normal(size=(width, k)), rng.normal(size=k), rng.normal(size=(k, k)))


def paths(scores, model):
    n, k = scores.shape
    for y in itertools.product(range(k), repeat=n):
        s = model.start[y[0]] + sum(scores[i, y[i]] for i in range(n)) + sum(model.steps[y[i - 1], y[i]] for i in range(1, n))
        yield y, s


def test_field_against_enumeration():
    model, rng = field(), np.random.default_rng(4)
    lengths = np.array([1, 4, 2, 5, 4])
    scores = rng.normal(size=(lengths.sum(), 3))
    p, best = crf.marginals(scores, lengths, model), crf.viterbi(scores, lengths, model)
    *_, logs = crf.forward_backward(scores, lengths, model)
    at, total = 0, 0.0
    for n in lengths:
        every = list(paths(scores[at:at + n], model))
        z = sum(math.exp(s) for _, s in every)
        total += math.log(z)
        for i in range(n):
            for j in range(3):
                assert p[at + i, j] == pytest.approx(sum(math.exp(s) for y, s in every if y[i] == j) / z)
        assert tuple(best[at:at + n]) == max(every, key=lambda e: e[1])[0]
        at += n
    assert logs == pytest.approx(total)


def test_field_learns_transitions():
    rng = random.Random(0)
    ids, labels, lengths = [], [], []
    for _ in range(60):
        y = rng.randint(0, 1)
        for _ in range(8):
            labels.append(y)
            ids.append(np.array([y if rng.random() < 0.7 else 1 - y]))
            y = y if rng.random() < 0.9 else 1 - y
        lengths.append(8)
    model = crf.train(ids, np.array(labels), np.array(lengths), ["a", "b"], 2)
    assert model.steps[0, 0] > model.steps[0, 1] and model.steps[1, 1] > model.steps[1, 0]
    got = crf.viterbi(crf.token_scores(ids, model), np.array(lengths), model)
    assert (got == np.array(labels)).mean() > 0.7


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_spans(text):
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in CARD.finditer(text):
        d = [int(c) for c in m[0] if c.isdigit()]
        odd_sum = sum(d[-1::-2]) + sum(sum(divmod(2 * x, 10)) for x in d[-2::-2])
        if 12 <= len(d) <= 19 and odd_sum % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out)


def test_base_spans():
    rng = random.Random(3)
    pieces = ["a@b.c", "@", ".", "1.2.3.4", "300.1.1.1", "4111 1111 1111 1111", "+1 (017) 555-7713", "-", " ", "x", "é", "12", "+",
              "00255.1.2.3", "a.b@c-d.e_f@g.h", "\n", "5", "4111-1111-1111-1111"]
    for _ in range(3000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 9)))
        assert pii.base_spans(text) == plain_spans(text), text
    assert pii.base_spans("1" * 200_000 + "@" + "a" * 200_000) == []


def test_pii_query(spark, docs):
    for table in (docs, odd(spark)):
        rows = pii.find(table.select("doc_id", "text")).join(table.select("doc_id", "text").distinct(), "doc_id").collect()
        for r in rows:
            want = plain_spans(r["text"] or "")
            named = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in want)
            assert r["base_sha256"] == hashlib.sha256(named.encode()).hexdigest()
            assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(k == x for _, k, _ in want) for x in range(4)]
            assert set(named.split(",")) - {""} <= set(r["spans"].split(","))
    assert pii.find(odd(spark)).count() == 11 and not pii.find(odd(spark).where("false")).collect()


def test_pii_adds_spans(spark):
    text = "call (017) 555-7713 at noon, or the order 20450001 came in 2024 again."
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert pii.find(df).first()["spans"] == "phone:5:19"


def test_merge_runs():
    rng = random.Random(9)
    for k in (0, 1, 2, 3, 5, 8, 13):
        runs = [sorted((rng.randint(0, 20), r) for _ in range(rng.randint(0, 12))) for r in range(k)]
        assert list(warc_index.merge_runs(runs, lambda x: x)) == sorted(x for r in runs for x in r)


def test_archives(spark):
    pages = spark.read.parquet(f"{SF_DIR}/pages.parquet").select("page_id", "url", "html")
    long = "<p>" + "copy " * 40
    extra = [(900001, "http://A.example.com/x#top", long), (900002, "http://b.example.com/?q=1", long), (900003, None, long),
             (900004, "http://b.example.com/", None), (900005, "no url\n", ""), (900006, "http://[bad", "tiny"),
             (900007, "http://c.example.com/", "tiny"), (None, "http://c.example.com/", "tiny"), (900008, "x", "y" * 3_000_000),
             (900009, "http://c.example.com/", "é" * 60), (900009, "http://c.example.com/", "é" * 60)]
    table = pages.union(spark.createDataFrame(extra, "page_id long, url string, html string"))
    index, records, folder = warc_index.archive(table)
    rows = {(r["page_id"], r["payload_digest"]): r for r in records.collect()}
    want = [tuple(r) for r in table.collect()]
    assert records.count() == len(want)
    least = {}
    for page, _, html in want:
        data = (html or "").encode()
        if page is not None:
            least[data] = min(page, least.get(data, page))
    for page, url, html in want:
        data = (html or "").encode()
        r = rows[page, hashlib.sha256(data).hexdigest()]
        again = len(data) >= 100 and page != least[data]
        assert (r["record_type"], r["refers_to"]) == (("revisit", least[data]) if again else ("response", None))
        assert r["payload_bytes"] == len(data) and r["url"] == url
        assert r["payload"] is None if again else bytes(r["payload"]) == data
    listed = [(r["range"], r["place"], r["urlkey"], r["ts"], r["page_id"] is None, r["page_id"] or 0, r["run"], r["offset"], r["length"])
              for r in index.collect()]
    listed.sort()
    assert [x[2:6] for x in listed] == sorted(x[2:6] for x in listed) and len(listed) == len(want)
    for *_, page, run, offset, length in listed[::40]:
        with open(f"{folder.removeprefix('file://')}/{run}", "rb") as f:
            f.seek(offset)
            assert f"WARC-Record-ID: <urn:page:{page}>".encode() in gzip.decompress(f.read(length))
    history = warc_index.capture_history(table)
    placed = sorted((r["place"], r["urlkey"], r["capture_time"], r["page_id"] is None, r["page_id"] or 0) for r in history.collect())
    assert [x[0] for x in placed] == list(range(1, len(want) + 1))
    assert [x[1:] for x in placed] == sorted(x[1:] for x in placed)
    assert not warc_index.capture_history(table.where("false")).collect()


def test_archives_take_other_columns(spark):
    rows = [(1, "http://a.example.com/", "x" * 200, "k", 7), (2, "http://a.example.com/", "x" * 200, "k", 7)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, urlkey string, place int")
    got = {r["page_id"]: (r["urlkey"], r["place"], r["refers_to"]) for r in warc_index.capture_history(pages).collect()}
    assert got == {1: ("com,example,a)/", 1, None), 2: ("com,example,a)/", 2, 1)}


def test_url_key():
    assert warc_index.url_key("https://Blog.Example.com/A?b=1#c") == "com,example,blog)/a?b=1"
    assert warc_index.url_key(None) == ")/" and warc_index.url_key("http://[bad").startswith("~")


def test_language(docs, spark):
    got = {r["doc_id"]: r for r in language.identify(docs).collect()}
    rows = docs.select("doc_id", "text", "lang").collect()
    held = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert {k for k, r in got.items() if r["held_out"]} == {r["doc_id"] for r in held}
    assert sum(got[r["doc_id"]]["lang_pred"] == r["lang"] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got.values())
    table = odd(spark).selectExpr("*", "'en' as lang")
    rows = language.identify(table).collect()
    assert len(rows) == 11 and {r["lang_pred"] for r in rows if r["doc_id"] in (1, 2, 3)} == {"und"}
    assert {r["lang_pred"] for r in rows} == {"und", "en"}
    assert {r["lang_pred"] for r in language.identify(odd(spark).selectExpr("*", "string(null) as lang")).collect()} == {"und"}
    assert not language.identify(table.where("false")).collect()


def test_labels_switch(docs):
    rows = [(r["lang"], r["text"]) for r in docs.select("lang", "text").collect()]
    labeller = language.Labeller(*language.train(rows))
    words = {lang: [w for x, t in rows if x == lang for w in t.split()][:30] for lang in ("en", "de")}
    scores = labeller.scores(words["en"] + words["de"])
    best = crf.marginals(scores, np.array([60]), labeller.model).argmax(axis=1)
    names = [labeller.model.labels[i] for i in best]
    assert names[:30].count("en") > 26 and names[30:].count("de") > 26


def test_language_model(docs, spark):
    for table, head in ((docs, 300), (docs, neural_lm.HEAD), (odd(spark), 2)):
        rows = [(r["doc_id"], r["text"]) for r in table.select("doc_id", "text").collect()]
        tokens = lambda t: [w.encode().lower() for w in split(t or "")]
        held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
        counts, ends = Counter(), 0
        for i, t in rows:
            if not held(i):
                counts.update(tokens(t))
                ends += 1
        n, v = sum(counts.values()) + ends, len(counts) + (ends > 0)
        got = neural_lm.score(table, head=head, vocab=200).collect()
        assert len(got) == len(rows)
        want = Counter()
        for i, t in rows:
            base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens(t)) + math.log10((ends + 1) / (n + v + 1))
            known = sum(w in counts for w in tokens(t)) + (ends > 0)
            want[i, held(i), len(tokens(t)) + 1, known, n, round(base, 6)] += 1
        assert want == Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6))
                               for r in got)
        assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)
    assert not neural_lm.score(docs.where("false")).collect()


def test_language_model_is_normalised():
    rng = np.random.default_rng(2)
    net = neural_lm.Net(rng.integers(1, 50, 12).astype(float))
    seq = rng.integers(0, 12, 5000)
    net.fit(np.roll(seq, 1), np.roll(seq, 2), seq, rng, net.start())
    norms = net.log_norms()
    one, two = np.array([3, 5]), np.array([0, 11])
    p = np.exp(net.context(one, two) @ net.q.T + net.b - norms[two, one][:, None])
    assert np.allclose(p.sum(axis=1), 1)


def test_nce_learns_a_pattern():
    rng = np.random.default_rng(3)
    seq = np.tile(np.array([0, 1, 2, 3]), 20000)
    net = neural_lm.Net(np.bincount(seq, minlength=4).astype(float))
    squares = net.start()
    for _ in range(4):
        net.fit(np.roll(seq, 1), np.roll(seq, 2), seq, rng, squares)
    norms = net.log_norms()
    p = np.exp((net.context(np.array([0]), np.array([3])) @ net.q.T + net.b)[0] - norms[3, 0])
    assert p.argmax() == 1 and p[1] > 0.6


def test_licences(docs, spark):
    named = {"Apache License": "apache-2.0", "MIT License": "mit", "CC BY-NC": "cc-by-nc", "GNU General": "gpl-3.0"}
    got = {r["doc_id"]: r["families"] for r in licences.licences(docs).collect()}
    for r in docs.select("doc_id", "text").collect():
        want = sorted({f for cue, f in named.items() for line in r["text"].split("\n") if cue in line and "icense" in line})
        assert got[r["doc_id"]] == ",".join(want)
    assert licences.licences(odd(spark)).count() == 10  # one row per key
    assert not licences.licences(odd(spark).where("false")).collect()
    rows = [(1, "A driver must carry a valid license."), (2, "Licensed under the Apache License, Version 2.0."),
            (3, "Prose.\nThis work is licensed under a Creative Commons Attribution 4.0 International License.")]
    found = licences.licences(docs.select("doc_id", "text").union(spark.createDataFrame([(i + 10 ** 9, t) for i, t in rows], "doc_id long, text string")))
    assert [r["families"] for r in found.where("doc_id > 999999999").orderBy("doc_id").collect()] == ["", "apache-2.0", "cc-by"]
