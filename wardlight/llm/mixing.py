"""Temperature mixing: source weights by bisection, realised as budgeted block permutations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from wardlight.llm.common import let, present, stage

#: Production parameters.
ENTROPY = 0.97        # target entropy of the weights, as a share of the largest possible
MAX_REPEATS = 4.0     # no source may be passed over more often than this
BUDGET_SHARE = 1.0    # tokens to draw, as a share of the tokens there are
BLOCK_TOKENS = 20_000  # tokens per block, about
GROUP = 200           # blocks per group of blocks
STEPS = 40            # bisection steps


def token_count(text: Column) -> Column:
    return F.regexp_count(present(text), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def _place(*parts: Column) -> Column:
    """A fixed pseudo-random place: 8 hex digits of the md5 of the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("long")


def _powers(tokens: Column, alpha: Column) -> Column:
    """Normalised t^alpha over an array of token counts, rounded so that engines agree."""
    top = F.array_max(tokens)
    raised = F.transform(tokens, lambda t: F.pow(t / top, alpha))
    return let(raised, lambda r: let(F.aggregate(r, F.lit(0.0), lambda a, x: a + x), lambda s: F.transform(r, lambda x: x / s)))


def _entropy(weights: Column) -> Column:
    return F.aggregate(weights, F.lit(0.0), lambda a, w: a - F.when(w > 0, w * F.ln(w)).otherwise(0.0))


def _too_flat(tokens: Column, alpha: Column, entropy: float, repeats: float, share: float) -> Column:
    """Whether alpha flattens more than asked: entropy above the target, or a source repeated too often."""
    total = F.aggregate(tokens, F.lit(0.0), lambda a, t: a + t)
    def judge(w: Column) -> Column:
        most = F.array_max(F.zip_with(w, tokens, lambda x, t: x * total * share / t))
        return (_entropy(w) > entropy * F.ln(F.size(tokens).cast("double"))) | (most > repeats)
    return let(_powers(tokens, alpha), judge)


def source_weights(sizes: DataFrame, source: str = "source", entropy: float = ENTROPY, repeats: float = MAX_REPEATS,
                   share: float = BUDGET_SHARE) -> DataFrame:
    """(source, tokens, alpha, weight, budget) from one row per source (`source`, `tokens`).

    Weights are proportional to tokens^alpha. As alpha falls from 1 to 0 they flatten; the bisection
    finds the alpha where entropy first reaches the target share of its maximum or a source
    reaches the repetition limit; alpha stays 1 if proportional weights are flat
    enough already, and is 0 if even equal weights meet both limits. Sources without tokens get weight 0.
    The table has one row per source, gathered into one array for the search.
    """
    some = sizes.where(F.col("tokens") > 0)
    rows = some.agg(F.sort_array(F.collect_list(F.struct(F.coalesce(source, F.lit("~")).alias("name"),
                                                         F.col("tokens").alias("tokens")))).alias("all"))
    counts = F.transform("all", lambda x: x["tokens"].cast("double"))

    def search(ts: Column) -> Column:
        start = F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"))

        def halve(acc: Column, _: Column) -> Column:
            mid = (acc["lo"] + acc["hi"]) / 2
            flat = _too_flat(ts, mid, entropy, repeats, share)
            return let(flat, lambda f: F.struct(F.when(f, mid).otherwise(acc["lo"]).alias("lo"),
                                                F.when(f, acc["hi"]).otherwise(mid).alias("hi")))

        found = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, halve, lambda acc: acc["hi"])
        return F.when(~_too_flat(ts, F.lit(0.0), entropy, repeats, share), F.lit(0.0)).otherwise(found)

    solved = rows.select("all", F.round(let(counts, search), 9).alias("alpha"), counts.alias("counts"))
    total = F.aggregate("counts", F.lit(0.0), lambda a, x: a + x)
    solved = solved.select("alpha", "all", total.alias("total"), _powers(F.col("counts"), F.col("alpha")).alias("w"))
    solved = solved.select("alpha", "total", "w", F.posexplode("all").alias("i", "x"))
    weight = F.round(F.get("w", F.col("i")), 9)
    return solved.select(
        F.col("x.name").alias("source"), F.col("x.tokens").alias("tokens"), "alpha", weight.alias("weight"),
        F.floor(weight * F.col("total") * F.lit(share)).cast("long").alias("budget"))


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", entropy: float = ENTROPY,
        repeats: float = MAX_REPEATS, share: float = BUDGET_SHARE, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row per document: key, source, n_tokens, alpha, weight, block, copies.

    A source's documents fall into blocks by a hash of their key and text, so rows without a key
    or with a shared one spread as well; its blocks, and the documents of a block, stand in an order given by hashes. The budget buys `budget // tokens`
    full passes over the source and, in one more pass, the documents that start within
    what is left, group of blocks after group, block after block. `copies` counts a document's passes, so a source's drawn
    tokens exceed its budget by less than one document. Running sums go over groups of
    blocks, over one group's blocks and over one block's documents, never over all documents of a source. A null source is a source of
    its own ("~"); null or empty texts have no tokens, stay in the table and take
    part in full passes only; equal rows stand next to each other. Other columns
    are ignored; an empty table gives an empty one.
    """
    rows = docs.select(
        F.col(key), F.coalesce(F.col(source).cast("string"), F.lit("~")).alias("source"),
        token_count(F.col(text)).alias("n_tokens"), F.md5(F.encode(present(F.col(text)), "UTF-8")).alias("__t"))
    rows = stage(rows.withColumn("__spot", _place(F.lit("doc"), "source", present(F.col(key).cast("string")), "__t")), "mix-rows")
    sizes = rows.groupBy("source").agg(F.sum("n_tokens").alias("tokens"))
    weights = stage(source_weights(sizes, "source", entropy, repeats, share).withColumn(
        "blocks", F.floor((F.col("tokens") + block_tokens - 1) / block_tokens).cast("long")), "mix-weights")
    placed = rows.join(weights, "source", "left").withColumn(
        "block", F.when(F.col("blocks").isNotNull(), F.col("__spot") % F.col("blocks")).otherwise(F.lit(0)))
    sums = placed.where("n_tokens > 0").groupBy("source", "block").agg(F.sum("n_tokens").alias("size"))
    sums = sums.join(weights.select("source", F.ceil(F.col("blocks") / GROUP).alias("groups")), "source").select(
        "source", "block", "size", (F.col("block") % F.col("groups")).alias("group"))

    def order(level: str, *by: str):
        return Window.partitionBy(*by).orderBy(_place(F.lit(level), "source", F.col(level).cast("string")), level)

    groups = sums.groupBy("source", "group").agg(F.sum("size").alias("all"))
    groups = groups.withColumn("first", F.sum("all").over(order("group", "source")) - F.col("all")).drop("all")
    before = sums.withColumn("then", F.sum("size").over(order("block", "source", "group")) - F.col("size")).join(
        groups, ["source", "group"]).select("source", "block", (F.col("first") + F.col("then")).alias("start"))
    inside = Window.partitionBy("source", "block").orderBy("__spot", F.col(key), "__t").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    ordered = placed.withColumn("within", F.sum("n_tokens").over(inside) - F.col("n_tokens")).join(
        before, ["source", "block"], "left")
    passes = F.floor(F.col("budget") / F.col("tokens"))
    rest = F.col("budget") - passes * F.col("tokens")
    extra = (F.col("n_tokens") > 0) & (F.col("start") + F.col("within") < rest)
    return ordered.select(
        key, "source", "n_tokens", F.coalesce("alpha", F.lit(1.0)).alias("alpha"),
        F.coalesce("weight", F.lit(0.0)).alias("weight"), "block",
        F.coalesce(passes + extra.cast("long"), F.lit(0)).cast("long").alias("copies"))
