"""Run counters gathered while tables are written, without a second scan."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F


@dataclass
class RunSummary:
    """Counters of a run, as (section, metric, value) texts.

    `watched` adds an observation to a table; its values are known once that table has been
    written. It belongs at the end of a plan: there a lost task is counted once, while below a
    shuffle a repeated stage would count again.
    """

    pending: list[tuple[str, Observation]] = field(default_factory=list)

    def watched(self, section: str, df: DataFrame, **metrics: Column) -> DataFrame:
        seen = Observation()
        self.pending.append((section, seen))
        return df.observe(seen, *[m.cast("string").alias(name) for name, m in metrics.items()])

    def rows(self) -> list[tuple[str, str, str | None]]:
        """Every counter of the tables written so far."""
        return [(section, name, value) for section, seen in self.pending for name, value in seen.get.items()]

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows(), "section string, metric string, value string")


def rows_and_days(day: str) -> dict[str, Column]:
    return {"rows": F.count(F.lit(1)), "first": F.min(day), "last": F.max(day)}


def split_rows(split: str = "dataset_split") -> dict[str, Column]:
    return {part: F.count_if(F.col(split) == part) for part in ("train", "val", "test")}


def distinct_users(pos: str) -> Column:
    """Users of a table that numbers each user's rows from 0."""
    return F.count_if(F.col(pos) == 0)
