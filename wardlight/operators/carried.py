"""Ids carried from run to run: each id is taken once over all runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from wardlight.operators.clean import keep_first
from wardlight.sources.layout import store_bucketed

#: Bits of one stored word of the filter (fixed by Spark's bitmap functions).
WORD_BITS = 32_768
BITS_PER_ID = 16


def _spot(key: str, words: int) -> Column:
    """The filter bit of an id, from 1 on."""
    return F.pmod(F.xxhash64(key), F.lit(words * WORD_BITS)) + 1


def membership(ids: DataFrame, key: str, words: int) -> DataFrame:
    """(word, bits): a bitmap filter of the ids in `words` words. Filters of one size merge by OR."""
    spot = _spot(key, words)
    return ids.groupBy(F.bitmap_bucket_number(spot).alias("word")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(spot)).alias("bits"))


def merged(*filters: DataFrame) -> DataFrame:
    out = filters[0]
    for other in filters[1:]:
        out = out.unionByName(other)
    return out.groupBy("word").agg(F.bitmap_or_agg("bits").alias("bits"))


def _bit(bits: Column, place: Column) -> Column:
    byte = F.conv(F.hex(F.substr(bits, F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, (place % 8).cast("int"))


class Carried:
    """The ids taken so far: a table bucketed by id and a filter built from it.

    `words` sets the size of the filter (about BITS_PER_ID bits an id); it changes cost alone.
    """

    def __init__(self, words: int = 64):
        self.words = words
        self.seen: DataFrame | None = None
        self.filter: DataFrame | None = None

    def take(self, rows: DataFrame, key: str = "id", order: str | None = None) -> DataFrame:
        """One row per id that no earlier run has taken (stored, bucketed by id); its ids count as taken.

        A null id is one id. Rows whose bit the filter lacks are new for certain and skip the
        anti join; it meets the others on the stored side's buckets. Spark broadcasts the filter
        while it is small and joins it by word otherwise.
        """
        fresh = rows
        if self.seen is not None:
            at = _spot(key, self.words)
            marked = rows.withColumns({"__word": F.bitmap_bucket_number(at), "__place": F.bitmap_bit_position(at)}).join(
                self.filter.withColumnRenamed("word", "__word"), "__word", "left")
            maybe = F.coalesce(_bit(F.col("bits"), F.col("__place")) == 1, F.lit(False))
            marked = marked.withColumn("__maybe", maybe).drop("__word", "__place", "bits")
            known = self.seen.select(F.col(key).alias("__seen"))
            old = marked.where("__maybe").join(known, F.col(key).eqNullSafe(F.col("__seen")), "left_anti")
            fresh = marked.where("NOT __maybe").unionByName(old).drop("__maybe")
        kept = store_bucketed(keep_first(fresh, key, order), "taken-rows", (key,))
        ids = kept.select(key)
        self.seen = store_bucketed(ids if self.seen is None else self.seen.unionByName(ids), "taken-ids", (key,))
        own = membership(ids, key, self.words)
        self.filter = own if self.filter is None else merged(self.filter, own)
        self.filter = store_bucketed(self.filter, "taken-filter", ("word",))
        return kept
