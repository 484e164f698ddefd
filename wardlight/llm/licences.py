"""Licence families of paragraphs: a trained sparse classifier, confirmed by templates."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizer, CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from wardlight.llm.common import BLANK_CHARS, let, present, stage, words

#: Licence notices as they are commonly written, by family.
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "this project is licensed under the terms of the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
            "documentation files to deal in the software without restriction"),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at "
                   "http www apache org licenses license 2 0"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    ("gpl-3.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
                "public license as published by the free software foundation"),
    ("lgpl", "licensed under the gnu lesser general public license version 2 1"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the "
            "following conditions are met"),
    ("bsd", "released under the bsd 3 clause license"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related rights under cc0 1 0"),
)
#: Sentences that name licences without granting one.
OTHERS = (
    "a driver must carry a valid license at all times", "the license fee for the software was paid in full last year",
    "the public version of the report was released under pressure", "general terms of the work are free for any person",
    "the company lost its license to sell in the city", "all rights reserved no part may be copied",
    "version 2 0 of the program will be released in may", "a copy of the file is in the office of the foundation",
)
UNKNOWN = "unknown"

#: Production parameters.
COPIES = 40            # altered copies of each template in the training table
NEGATIVES = 2000       # corpus paragraphs drawn to be learned as unknown (smallest hashes of id and line)
FEATURES = 20_000      # word n-grams kept at most
MIN_ROWS = 2           # training rows that an n-gram is in
ALARMS = 0.001         # share of held-out unknown paragraphs that may pass the cut
MATCH = 0.6            # share of a template's word pairs that must be in the paragraph
REACH = max(len(t.split()) for _, t in TEMPLATES)  # words that a notice may go on for after its first line


def tokens(text: Column) -> Column:
    """Words of a-z, 0-9 and other letters, in lower case."""
    return words(F.lower(text), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def ngrams(ws: Column) -> Column:
    """Words and word pairs."""
    pairs = F.transform(F.sequence(F.lit(0), F.size(ws) - 2), lambda i: F.concat_ws(" ", F.get(ws, i), F.get(ws, i + 1)))
    return F.when(F.size(ws) < 2, ws).otherwise(F.concat(ws, pairs))


def paragraphs(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(id, at, line): every line that has more than blanks."""
    lines = docs.select(F.col(key).alias("id"), F.posexplode(F.split(present(F.col(text)), "\n")).alias("at", "line"))
    return lines.where(F.btrim("line", F.lit(BLANK_CHARS)) != "")


def _where(value: Column, keep) -> Column:
    """Rows whose `value` passes. A plain filter would be pushed below the projections that make
    the value and evaluate them once per use; a generated column is evaluated once."""
    return F.explode(F.filter(F.array(value), keep))


def _values(spark: SparkSession, rows, *names: str) -> DataFrame:
    return spark.range(1).select(F.explode(F.array(*[
        F.struct(*[F.lit(v).alias(n) for n, v in zip(names, r)]) for r in rows])).alias("r")).select("r.*")


def training_table(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(label, g, test): altered templates, look-alikes and a bounded sample of corpus paragraphs.

    A copy drops one word in eight, by a hash. Drawn paragraphs with a template's rarer words
    are not learned as unknown. The draw goes by place, so a line that repeats fills no more
    of it than its share.
    """
    spark = docs.sparkSession
    cue = r"licen[cs]|copyright|gnu|apache|mozilla|creative commons|bsd|redistribut|cc (by|0)"
    some = paragraphs(docs, key, text).orderBy(F.xxhash64("id", "at"), "line").limit(NEGATIVES)
    some = some.select(tokens(F.col("line")).alias("w")).where((F.size("w") > 0) & ~F.array_join("w", " ").rlike(cue))
    copies = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("id")
    made = _values(spark, TEMPLATES, "label", "t").select("label", "t", copies(COPIES)).select(
        "label", F.col("id").alias("fold"), F.filter(F.split("t", " "), lambda w, i: (F.col("id") % 4 == 0) | (
            F.pmod(F.xxhash64(w, i, F.col("id")), F.lit(8)) != 0)).alias("w"))
    fake = _values(spark, [(x,) for x in OTHERS], "t").select("t", copies(COPIES // 4)).select(
        F.lit(UNKNOWN).alias("label"), F.col("id").alias("fold"), F.split("t", " ").alias("w"))
    rest = some.select(F.lit(UNKNOWN).alias("label"), F.pmod(F.xxhash64("w", F.lit("fold")), F.lit(1 << 20)).alias("fold"), "w")
    return made.union(fake).union(rest).select("label", ngrams(F.col("w")).alias("g"), (F.col("fold") % 5 == 0).alias("test"))


class Classifier:
    """Sparse n-gram logistic regression with a calibrated cut for the unknown class."""

    def __init__(self, vectors: CountVectorizerModel, model: LogisticRegressionModel, labels: list[str], cut: float):
        self.vectors, self.model, self.labels, self.cut = vectors, model, labels, cut
        weights = model.coefficientMatrix.toArray()
        #: N-grams with a weight in some class; the penalty leaves few, and no other can change a prediction.
        self.active = [g for g, used in zip(vectors.vocabulary, (weights != 0).any(axis=0)) if used]

    @staticmethod
    def fit(table: DataFrame) -> Classifier:
        table = stage(table, "licence-training")
        labels = sorted(r["label"] for r in table.select("label").distinct().collect())
        y = F.array_position(F.array(*[F.lit(x) for x in labels]), F.col("label")).cast("double") - 1
        vectors = CountVectorizer(inputCol="g", outputCol="v", vocabSize=FEATURES, minDF=MIN_ROWS, binary=True).fit(table.where("not test"))
        ready = vectors.transform(table).withColumn("y", y)
        model = LogisticRegression(featuresCol="v", labelCol="y", regParam=0.002, elasticNetParam=0.5, maxIter=60,
                                   family="multinomial").fit(ready.where("not test"))
        fitted = Classifier(vectors, model, labels, 0.0)
        # The cut: the smallest family probability that at most ALARMS of the held-out unknown ones reach.
        judged = fitted.predict(table.where(F.col("test") & (F.col("label") == UNKNOWN)))
        high = judged.agg(F.percentile("p", F.lit(1 - ALARMS))).first()[0]
        return Classifier(vectors, model, labels, max(0.5, high or 0.0))

    def predict(self, rows: DataFrame) -> DataFrame:
        """Rows whose likeliest family that is not unknown reaches the cut, with `family` and its probability `p`."""
        known = rows.withColumn("g", F.filter("g", lambda x: x.isin(self.active)))
        scored = self.model.transform(self.vectors.transform(known))
        families = [(i, x) for i, x in enumerate(self.labels) if x != UNKNOWN]
        best = let(vector_to_array("probability"), lambda p: F.array_max(F.array(*[
            F.struct(F.get(p, F.lit(i)).alias("p"), F.lit(x).alias("family")) for i, x in families])))
        return scored.select(*rows.columns, _where(best, lambda b: b["p"] >= self.cut).alias("__best")).select(
            *rows.columns, F.col("__best.p").alias("p"), F.col("__best.family").alias("family"))


def confirmation(g: Column, family: Column) -> Column:
    """Largest share of a template's word pairs, over the family's templates, that the n-grams have."""
    def share(t: str) -> Column:
        ws = t.split()
        pairs = sorted({f"{a} {b}" for a, b in zip(ws, ws[1:])})
        return F.size(F.array_intersect(F.array(*[F.lit(p) for p in pairs]), g)) / len(pairs)

    return F.greatest(F.lit(0.0), *[F.when(family == f, share(t)).otherwise(0.0) for f, t in TEMPLATES])


def joined_lines(docs: DataFrame, key: str, text: str, found: DataFrame) -> DataFrame:
    """(id, body, at, w): each line's words with the next REACH words of the lines that follow it.

    Lines that are `found` (id, body, at) and lines without words end a run; a line with none
    after it is left out. A template that begins in a line is whole in its row, however it is wrapped.
    """
    spots = found.groupBy(F.col("id").alias("__id"), F.col("body").alias("__body")).agg(F.collect_set("at").alias("done"))
    rows = docs.select(F.col(key).alias("id"), F.xxhash64(present(F.col(text))).alias("body"), present(F.col(text)).alias("t"))
    rows = rows.join(spots, F.col("id").eqNullSafe(F.col("__id")) & (F.col("body") == F.col("__body")), "left")
    none = F.array().cast("array<string>")
    lines = F.transform(F.split("t", "\n"), lambda x, i: F.when(
        F.coalesce(F.array_contains("done", i), F.lit(False)), none).otherwise(tokens(x)))

    def windows(p: Column) -> Column:
        def after(i: Column) -> Column:
            some = F.slice(p["heads"], i + 2, REACH)
            return let(some, lambda xs: let(F.array_position(xs, none), lambda stop: F.slice(F.flatten(
                F.when(stop == 0, xs).otherwise(F.slice(xs, 1, F.greatest(stop - 1, F.lit(0)).cast("int")))), 1, REACH)))

        made = F.transform(p["lines"], lambda x, i: let(after(i), lambda rest: F.struct(
            i.alias("at"), F.when((F.size(x) > 0) & (F.size(rest) > 0), F.concat(x, rest)).alias("w"))))
        return F.filter(made, lambda m: m["w"].isNotNull())

    runs = let(lines, lambda xs: let(F.struct(xs.alias("lines"), F.transform(xs, lambda x: F.slice(x, 1, REACH)).alias("heads")), windows))
    return rows.select("id", "body", F.explode(runs).alias("x")).select("id", "body", F.col("x.at").alias("at"), F.col("x.w").alias("w"))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per paragraph with a licence: key, line_no, family, p, match.

    A paragraph is a line, or a line with the words that follow it on the next ones, for
    notices that are wrapped. It counts if its family's probability reaches the calibrated
    cut and a template of the family confirms it. Joins that begin on adjacent lines and name one
    family are one notice, placed where most of the template is (the last of equal ones).
    """
    model = Classifier.fit(training_table(docs, key, text))

    def confirmed(rows: DataFrame) -> DataFrame:
        judged = model.predict(rows.withColumn("g", let(F.col("w"), ngrams))).withColumn("g", let(F.col("w"), ngrams))
        return judged.withColumn("match", let(F.col("g"), lambda g: confirmation(g, F.col("family")))).where(
            F.col("match") >= MATCH).select("id", "body", "at", "family", "p", "match")

    whole = docs.select(F.col(key).alias("id"), F.col(text).alias("t"), F.xxhash64(present(F.col(text))).alias("body"))
    lines = whole.select("id", "body", F.posexplode(F.split(present("t"), "\n")).alias("at", "line")).where(
        F.btrim("line", F.lit(BLANK_CHARS)) != "")
    alone = stage(confirmed(lines.select("id", "body", "at", tokens(F.col("line")).alias("w"))), "licence-lines")
    wrapped = confirmed(joined_lines(docs, key, text, alone)).groupBy("id", "body", "family", "at").agg(
        F.max("p").alias("p"), F.max("match").alias("match"), F.count(F.lit(1)).alias("rows"))
    by_line = Window.partitionBy("id", "body", "family").orderBy("at")  # the notices of one document
    apart = F.coalesce(F.col("at") - F.lag("at").over(by_line) > 1, F.lit(True)).cast("int")
    notices = wrapped.withColumn("apart", apart).withColumn("notice", F.sum("apart").over(by_line)).groupBy(
        "id", "body", "family", "notice").agg(F.max_by(F.struct("at", "p", "match", "rows"), F.struct("match", "at")).alias("x"))
    notices = notices.select("id", "family", "x.*").select("id", F.explode(F.array_repeat("at", F.col("rows").cast("int"))).alias("at"), "family", "p", "match")
    return alone.select("id", "at", "family", "p", "match").union(notices).select(
        F.col("id").alias(key), F.col("at").alias("line_no"), "family", "p", "match")


def licences(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, families (sorted, comma-joined, empty if none), n_notices, p.

    Null and empty texts have no paragraphs and no licence; rows that repeat a key are
    taken together; null keys form one row; an empty table gives an empty one; other
    columns are ignored. The fit sees a bounded training table; all paragraphs are scored.
    """
    if docs.isEmpty():
        return docs.select(F.col(key), F.lit("").alias("families"), F.lit(0).cast("long").alias("n_notices"), F.lit(0.0).alias("p"))
    found = scan(docs, key, text).groupBy(key).agg(
        F.array_join(F.sort_array(F.collect_set("family")), ",").alias("families"),  # a fixed set of families
        F.count(F.lit(1)).alias("n"), F.max("p").alias("best")).withColumnRenamed(key, "__id")
    ids = docs.select(F.col(key)).distinct()
    return ids.join(found, ids[key].eqNullSafe(found["__id"]), "left").select(
        key, F.coalesce("families", F.lit("")).alias("families"), F.coalesce("n", F.lit(0)).cast("long").alias("n_notices"),
        F.coalesce("best", F.lit(0.0)).alias("p"))
