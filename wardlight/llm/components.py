"""Connected components of a link table, by joins only."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from wardlight.llm.common import stage
from wardlight.sources.stage import drop_stage


def connected(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root): each linked node with the smallest node of its component.

    Every round takes the smallest label among the neighbours (a map-side combined
    minimum) and then the label of that label, so a chain shortens by doubling. Each round
    is a stored table; the loop ends when a round changes nothing. Links of a hot node
    are split by the skew handling of the sort-merge join. Nulls link nothing; an empty
    table gives an empty one.
    """
    pairs = links.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(
        F.col(a).alias("node"), F.col(b).alias("other"))
    both = stage(pairs.union(pairs.select("other", "node")).distinct(), "links")
    labels = stage(both.groupBy("node").agg(F.min("other").alias("near")).select(
        "node", F.least("node", "near").alias("root")), "labels")
    held = labels
    while True:
        near = both.join(labels.withColumnRenamed("node", "other"), "other").groupBy("node").agg(
            F.min("root").alias("near"))
        step = labels.join(near, "node").select(
            "node", F.col("root").alias("was"), F.least("root", "near").alias("root"))
        jump = labels.select(F.col("node").alias("root"), F.col("root").alias("far"))
        moved = stage(step.join(jump, "root", "left").select(
            "node", "was", F.least("root", "far").alias("root")), "labels")
        drop_stage(held)
        held, labels = moved, moved.select("node", "root")
        if moved.where(F.col("was") != F.col("root")).isEmpty():
            drop_stage(both)
            return labels
