"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from wardlight.sources.stage import stage

#: The blanks that separate words, and the words that contamination is judged on.
BLANKS = r"[\x20\x09-\x0D]+"
BLANK_CHARS = "\x20\x09\x0a\x0b\x0c\x0d"
NOT_ALNUM = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body) -> Column:
    """Evaluate `value` once per row and use it in `body` as often as needed.

    A column that an expression names several times may be inlined by the optimizer;
    a lambda's argument never is.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def present(text) -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def words(text: Column, gaps: str = BLANKS) -> Column:
    """Maximal runs of characters outside `gaps`; none for an empty text."""
    return F.array_remove(F.split(text, gaps), "")


def crc_mod(key: str, n: int) -> Column:
    """crc32 of the key's decimal text, modulo n (a null key counts as the empty text)."""
    return F.crc32(F.encode(present(F.col(key).cast("string")), "UTF-8")) % n


def text_key(key: str, text: str) -> list[Column]:
    """Identity of a row for joins: equal rows share it and get equal results.

    A null key is told apart from every other key, and rows that repeat a key with
    another text are kept apart by the text's hash.
    """
    return [F.coalesce(F.col(key).cast("string"), F.lit("~")).alias("__key"), F.xxhash64(present(text)).alias("__text")]


def slices(texts: list[str], chars: int = 2_000_000):
    """Consecutive parts of a batch of about `chars` characters, which bounds a worker's memory."""
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t)
        if size >= chars:
            yield part
            part, size = [], 0
    if part:
        yield part


__all__ = ["BLANKS", "BLANK_CHARS", "NOT_ALNUM", "crc_mod", "let", "lower_ascii", "present", "slices", "stage", "table",
           "text_key", "words"]
