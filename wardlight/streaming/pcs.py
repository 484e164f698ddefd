"""Exact user-day counts of an activity stream, with maps of the open user-days and their pcs."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from wardlight.streaming.logs import SUMS

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: Parts into which the users of a day are hashed; each is one key of the state.
SLICES = 128


class UserDays(StatefulProcessor):
    """Running sums of the users of one slice of a day and the pcs each has used; both leave the state with the day."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sums = handle.getMapState("sums", "user string", ", ".join(f"{n} long" for n in [*SUMS, "pcs"]))
        self.pcs = handle.getMapState("pcs", "user string, pc string", "seen boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = not self.sums.exists()
        known = not first  # whether the state may hold pcs of this slice
        total: dict = {}
        for part in rows:
            if first and not known:
                self.handle.registerTimer(int(part["day_end"].iloc[0]))
            for user, *values in part[["user", *SUMS]].itertuples(index=False, name=None):
                total[user] = [a + b for a, b in zip(total[user], [*values, 0])] if user in total else [*values, 0]
            for pair in dict.fromkeys(part[["user", "pc"]].itertuples(index=False, name=None)):
                if pair[1] is not None and not (known and self.pcs.containsKey(pair)):
                    self.pcs.updateValue(pair, (True,))
                    total[pair[0]][-1] += 1
            known = True
        for user, values in total.items():
            held = None if first else self.sums.getValue((user,))
            total[user] = values = [a + b for a, b in zip(values, held)] if held else values
            self.sums.updateValue((user,), tuple(values))
        yield pd.DataFrame([[user, key[0], *values] for user, values in total.items()], columns=["user", "email_day", *SUMS, "unique_pcs"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.sums.clear()
        self.pcs.clear()
        return iter(())

    def close(self) -> None:
        pass


def user_day_exact(events: DataFrame, date: str = "date", delay: str = "1 day", slices: int = SLICES) -> DataFrame:
    """Logon, device and file counts and exact distinct pcs per (user, day) of a stream of cleaned activity.

    Every batch gives the user-days that it changed, for sinks that take final rows. A day's state
    goes when the watermark passes its end; later events are dropped. Sums and pcs of the users of a
    day lie in the state store as maps, not in rows. Start it under `rocks`. A key of the state is a
    slice of a day's users, so that keys, timers and expiry cost the days and slices, not the
    user-days; a user-day costs a few calls between Python and the state store, one per pc among them.
    `logs.user_day_parts` is the fast form for tables.
    """
    timed = events.withColumn(date, F.col(date).cast("timestamp")).withWatermark(date, delay)
    rows = timed.select(F.col("user").cast("string").alias("user"), F.to_date(date).alias("email_day"), date, F.col("pc").cast("string").alias("pc"),
                        F.pmod(F.xxhash64("user"), F.lit(slices)).cast("int").alias("slice"),
                        *[F.coalesce(F.expr(e).cast("long"), F.lit(0).cast("long")).alias(n) for n, e in SUMS.items()],
                        (F.unix_millis(F.to_date(date).cast("timestamp")) + 86_400_000).alias("day_end"))
    out = "user string, email_day date, " + ", ".join(f"{n} long" for n in [*SUMS, "unique_pcs"])
    days = rows.groupBy("email_day", "slice").transformWithStateInPandas(UserDays(), out, "Update", "eventTime")
    return days.withColumn("user", F.col("user").cast(events.schema["user"].dataType))


@contextmanager
def rocks(spark: SparkSession):
    """Streams that start inside keep their state in RocksDB, as state maps need."""
    was = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, was) if was else spark.conf.unset(_PROVIDER)
