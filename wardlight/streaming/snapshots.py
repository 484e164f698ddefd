"""Result tables of streams in update mode: a base, a few change sets, and an atomically published snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from wardlight.sources.stage import file_system

#: Change sets that a reader may have to merge; one more and they become a new base.
MOST_CHANGES = 8


class SnapshotTable:
    """The last state of every key, kept under one folder.

    A batch n writes `change-n` (written anew if the batch is repeated). When `most` change sets have
    gathered, base and change sets are merged into `base-n`, and the empty file `snapshots/n`,
    created by a rename, makes it the base for readers. What is older than the snapshot before it is
    deleted, so a reader that began with that one ends. A run that fails between the two writes leaves
    the old snapshot in force, and the repeated batch writes both again.
    """

    def __init__(self, spark: SparkSession, path: str, schema, keys: tuple[str, ...], most: int = MOST_CHANGES):
        self.spark, self.path, self.schema, self.keys, self.most = spark, path.rstrip("/"), schema, keys, most

    def _numbers(self, prefix: str) -> list[int]:
        """The finished numbers of change sets, bases or snapshots, in order."""
        folder, _, start = prefix.rpartition("/")
        fs, where = file_system(self.spark, f"{self.path}/{folder}" if folder else self.path)
        if not fs.exists(where):
            return []
        out = []
        for status in fs.listStatus(where):
            name = status.getPath().getName()
            if name.startswith(start) and name[len(start):].isdigit():
                done = not status.isDirectory() or fs.exists(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS"))
                out += [int(name[len(start):])] if done else []
        return sorted(out)

    def _parts(self) -> tuple[list[str], int]:
        """Folders that hold the present state, and the number of the base in force (-1: none)."""
        base = max(self._numbers("snapshots/"), default=-1)
        changes = [n for n in self._numbers("change-") if n > base]
        return ([f"base-{base}"] if base >= 0 else []) + [f"change-{n}" for n in changes], base

    def read(self) -> DataFrame:
        """One row per key: at most one base and `most` change sets are read, however many batches there were."""
        parts, _ = self._parts()
        return self._merged(parts)

    def _merged(self, parts: list[str]) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(f"{self.schema.toDDL()}, __batch long").parquet(*[f"{self.path}/{p}" for p in parts])
        values = F.struct(*[c for c in self.schema.names if c not in self.keys], "__batch")
        last = rows.groupBy(*self.keys).agg(F.max_by(values, "__batch").alias("last"))
        return last.select(*[F.col(c) if c in self.keys else F.col(f"last.{c}").alias(c) for c in self.schema.names])

    def add(self, batch: DataFrame, n: int) -> None:
        """Take in batch n; a batch that is already in the base is left out."""
        parts, base = self._parts()
        if n <= base:
            return
        batch.select(*self.schema.names, F.lit(n).cast("long").alias("__batch")).write.mode("overwrite").parquet(f"{self.path}/change-{n}")
        if len(parts) - (base >= 0) >= self.most:
            self.compact(n)

    def compact(self, n: int) -> None:
        """Merge everything up to batch n into a base and publish it."""
        parts, base = self._parts()
        merged = self._merged(parts).withColumn("__batch", F.lit(n).cast("long"))
        merged.write.mode("overwrite").parquet(f"{self.path}/base-{n}")
        self._publish(n)
        for name in [f"base-{m}" for m in self._numbers("base-") if m < base] + [f"change-{m}" for m in self._numbers("change-") if m <= base] + [
                f"snapshots/{m}" for m in self._numbers("snapshots/") if m < base]:
            fs, where = file_system(self.spark, f"{self.path}/{name}")
            fs.delete(where, True)

    def _publish(self, n: int) -> None:
        fs, ready = file_system(self.spark, f"{self.path}/snapshots/_{n}")
        fs.create(ready, True).close()
        if not fs.rename(ready, file_system(self.spark, f"{self.path}/snapshots/{n}")[1]):
            raise OSError(f"snapshot {n} of {self.path} could not be published")
