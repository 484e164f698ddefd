"""Benchmark decontamination by winnowed k-gram fingerprints, extended to whole windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from wardlight.llm.common import NOT_ALNUM, let, lower_ascii, present, stage, text_key, words

#: Production parameters. K + SPAN - 1 = WINDOW: every shared run of WINDOW words shares a
#: fingerprint, because each stretch of SPAN k-grams keeps its smallest hash.
WINDOW = 13
K = 7
SPAN = WINDOW - K + 1
#: A document is contaminated if hits are at least one word in so many.
ONE_IN = 20


def tokens(text: Column) -> Column:
    """Words of letters and digits, A-Z in lower case; none for null."""
    return words(lower_ascii(present(text)), NOT_ALNUM)


def _grams(hashes: Column, k: int) -> Column:
    """Hash of each run of k word hashes; none if the text is shorter."""
    spots = F.sequence(F.lit(0), F.size(hashes) - k)
    grams = F.transform(spots, lambda i: F.xxhash64(*[F.get(hashes, i + j) for j in range(k)]))
    return F.when(F.size(hashes) < k, F.array().cast("array<bigint>")).otherwise(grams)


def fingerprints(ws: Column, window: int = WINDOW, k: int = K) -> Column:
    """array<struct<gram, at>>: the rightmost smallest k-gram of every stretch, once each.

    Texts of at least `window` words only.
    """
    span = window - k + 1
    empty = F.array().cast("array<struct<gram:bigint,at:int>>")

    def pick(grams: Column) -> Column:
        def least(start: Column) -> Column:
            back = F.reverse(F.slice(grams, start + 1, span))
            return (start + span - F.array_position(back, F.array_min(back))).cast("int")
        spots = F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(grams) - span), least))
        return F.transform(spots, lambda i: F.struct(F.get(grams, i).alias("gram"), i.alias("at")))

    def short(xs: Column) -> Column:
        return F.when(F.size(xs) < window, empty).otherwise(
            let(F.transform(xs, lambda w: F.xxhash64(w)), lambda h: let(_grams(h, k), pick)))

    return let(ws, short)


def _runs(ws: Column, starts: Column, n: int | Column) -> Column:
    """The words from each start, joined by blanks."""
    return F.transform(starts, lambda s: F.struct(s.alias("at"), F.array_join(F.slice(ws, s + 1, n), " ").alias("run")))


def benchmark_windows(benchmark: DataFrame, item: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(run, n, item): the windows of every item; an item shorter than a window is one window."""
    items = benchmark.select(F.col(item).cast("string").alias("item"), tokens(F.col(text)).alias("w"))
    n = F.least(F.size("w"), F.lit(window))
    starts = F.sequence(F.lit(0), F.size("w") - n)
    return items.where(F.size("w") > 0).select(
        "item", n.alias("n"), F.explode(_runs(F.col("w"), starts, n)).alias("x")).select(
        F.col("x.run").alias("run"), "n", "item").distinct()


def _covered(spans: Column) -> Column:
    """Words in the union of spans (struct at, n): a running end over the sorted starts."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("hit"))

    def add(acc: Column, s: Column) -> Column:
        end = s["at"] + s["n"]
        return F.struct(F.greatest(acc["end"], end).alias("end"),
                        (acc["hit"] + F.greatest(F.lit(0), end - F.greatest(acc["end"], s["at"]))).alias("hit"))

    return F.aggregate(F.sort_array(spans), start, add, lambda acc: acc["hit"])


def contamination(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text",
                  item: str = "item_id", item_text: str = "text", window: int = WINDOW, k: int = K,
                  one_in: int = ONE_IN) -> DataFrame:
    """One row per document: key, n_words, n_hit, n_items, items_sha256, contaminated.

    Document fingerprints meet the benchmark's in a join that Spark broadcasts only if
    the stored fingerprint table is below its threshold. Where one meets, the up to
    window - k + 1 windows around it are compared word by word with the items' windows, which
    is exact. Items shorter than a window cannot be winnowed: for each of their lengths
    (fewer than `window`) document runs of that length start where the item's first
    word does. A null or empty text has no words and is clean; null items have no windows;
    equal rows get equal results; empty tables give no hits or no rows. Other columns
    are ignored. `items_sha256` digests the item ids sorted as strings.
    """
    runs = stage(benchmark_windows(benchmark, item, item_text, window), "item-windows")
    gram = lambda ws: F.transform(fingerprints(ws, window, k), lambda f: f["gram"])
    marks = stage(runs.where(F.col("n") == window).select(
        F.explode(gram(F.split("run", " "))).alias("gram")).distinct(), "item-fingerprints")
    lengths = sorted(r["n"] for r in runs.where(F.col("n") < window).select("n").distinct().collect())  # below `window`

    source = docs.select(F.col(key).alias("__id"), *text_key(key, text), F.col(text).alias("__body"))
    found = source.select("__key", "__text", F.explode(fingerprints(tokens(F.col("__body")), window, k)).alias("f")).select(
        "__key", "__text", F.col("f.at").alias("at"), F.col("f.gram").alias("gram"))
    met = found.join(marks, "gram", "left_semi")
    # A document's fingerprints that meet an item: at most its own words.
    met = met.groupBy("__key", "__text").agg(F.collect_set("at").alias("at"))
    texts = source.join(met, ["__key", "__text"], "left")
    around = F.flatten(F.transform(F.coalesce("at", F.array().cast("array<int>")), lambda p: F.sequence(
        F.greatest(p - (window - k), F.lit(0)), F.least(p, F.size("w") - window))))
    starts = F.array_distinct(F.filter(around, lambda s: s >= 0))
    tries = [let(F.col("w"), lambda w: _runs(w, starts, window))]
    if lengths:
        heads = runs.where(F.col("n") < window).select("n", F.substring_index("run", " ", 1).alias("head")).distinct()
        # One row per word that starts a short item, with the lengths to try.
        tried = stage(heads.groupBy("head").agg(F.collect_set("n").alias("ns")), "item-heads")
        spots = source.select("__key", "__text", F.posexplode(tokens(F.col("__body"))).alias("at", "head")).join(tried, "head")
        spots = spots.select("__key", "__text", "at", F.explode("ns").alias("n"))
        spots = spots.groupBy("__key", "__text").agg(F.collect_set(F.struct("at", "n")).alias("short"))
        texts = texts.join(spots, ["__key", "__text"], "left")
        near = F.filter(F.coalesce("short", F.array().cast("array<struct<at:int,n:int>>")),
                        lambda s: s["at"] + s["n"] <= F.size("w"))
        tries.append(let(F.col("w"), lambda w: F.transform(near, lambda s: F.struct(
            s["at"].alias("at"), F.array_join(F.slice(w, s["at"] + 1, s["n"]), " ").alias("run")))))
    texts = texts.withColumn("w", tokens(F.col("__body")))
    judged = stage(texts.select("__id", "__key", "__text", F.size("w").cast("long").alias("n_words"),
                                F.concat(*tries).alias("tries")), "tried-windows")
    tried = judged.where(F.size("tries") > 0).select("__key", "__text", F.explode("tries").alias("x")).select(
        "__key", "__text", F.col("x.at").alias("at"), F.col("x.run").alias("run"))
    hits = tried.join(runs, "run").groupBy("__key", "__text").agg(
        F.collect_set(F.struct("at", "n")).alias("spans"), F.sort_array(F.collect_set("item")).alias("items"))
    hits = hits.select("__key", "__text", _covered(F.col("spans")).cast("long").alias("hit"),
                       F.size("items").cast("long").alias("items"), F.sha2(F.array_join("items", ","), 256).alias("sha"))
    joined = judged.drop("tries").join(hits, ["__key", "__text"], "left")
    n_hit = F.coalesce("hit", F.lit(0))
    return joined.select(
        F.col("__id").alias(key), "n_words", n_hit.cast("long").alias("n_hit"),
        F.coalesce("items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        ((n_hit > 0) & (one_in * n_hit >= F.col("n_words"))).alias("contaminated"))
