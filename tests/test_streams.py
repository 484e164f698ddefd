"""Streams with bounded state: later files update keys, closed days leave the state, snapshots bound the reading."""

import os
from datetime import datetime

import pytest

from wardlight.streaming import logs, pcs
from wardlight.streaming.snapshots import SnapshotTable

SCHEMA = "id string, user string, date timestamp, activity string, is_after_hours int, pc string"
FILES = [
    [("1", "u", datetime(2024, 1, 1, 9), "a"), ("2", "v", datetime(2024, 1, 1, 10), "a")],
    [("3", "u", datetime(2024, 1, 1, 23), "b"), ("4", "u", datetime(2024, 1, 2, 8), None)],  # the first one is late
    [("5", "u", datetime(2024, 1, 9, 8), "a")],
    [("6", "u", datetime(2024, 1, 9, 9), "a")],
]
WANT = {("u", "2024-01-01"): (2, 2), ("v", "2024-01-01"): (1, 1), ("u", "2024-01-02"): (1, 0), ("u", "2024-01-09"): (2, 1)}


def batches(spark, tmp_path, make, keys):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    sizes = []
    for rows in FILES:
        data = [(i, u, t, "Logon", 0, pc) for i, u, t, pc in rows]
        spark.createDataFrame(data, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        days = make(spark.readStream.schema(SCHEMA).parquet(source))
        run = logs.start_table(days, out, "days", keys)
        run.awaitTermination()
        sizes.append(run.lastProgress.stateOperators[0].numRowsTotal)
    return SnapshotTable(spark, f"{out}/days", days.schema, keys).read(), sizes


def counts(table):
    return {(r["user"], str(r["email_day"])): (r["logon_count"], r["unique_pcs"]) for r in table.collect()}


def test_late_event_updates_its_day_and_closed_days_leave_the_state(spark, tmp_path):
    parts, sizes = batches(spark, tmp_path, logs.user_day_parts, ("user", "email_day", "pc"))
    assert counts(logs.fold_user_days(parts)) == WANT
    assert max(sizes) >= 3 and sizes[-1] == 1
    # A batch holds the keys that it changed, not the whole table.
    sizes = [spark.read.parquet(f"{tmp_path}/out/days/{f}").count() for f in os.listdir(tmp_path / "out/days") if f.startswith("change-")]
    assert sorted(sizes)[-1] <= 2 and len(sizes) >= 4


def test_state_map_of_pcs(spark, tmp_path):
    with pcs.rocks(spark):
        table, _ = batches(spark, tmp_path, pcs.user_day_exact, ("user", "email_day"))
    assert counts(table) == WANT


def test_users_of_a_day_share_keys_and_timers(spark, tmp_path):
    """Two batches of many users, repeated and null pcs, a user without a name: exact counts, few timers."""
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    logons, seen, timers = {}, {}, []
    for batch in range(2):
        data = [(str(i), None if u == 0 else f"u{u}", datetime(2024, 1, 1, 9 + batch), "Logon", 0, [None, "a", "b", "c"][(u + i % (2 + batch)) % 4])
                for i, u in enumerate(j % 300 for j in range(900))]
        for _, u, _, _, _, pc in data:
            logons[u] = logons.get(u, 0) + 1
            seen.setdefault(u, set()).update({pc} - {None})
        spark.createDataFrame(data, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        with pcs.rocks(spark):
            days = pcs.user_day_exact(spark.readStream.schema(SCHEMA).parquet(source), slices=16)
            run = logs.start_table(days, out, "days", ("user", "email_day"))
            run.awaitTermination()
        timers += [p.stateOperators[0].customMetrics["numRegisteredTimers"] for p in run.recentProgress if p.stateOperators]
    got = counts(SnapshotTable(spark, f"{out}/days", days.schema, ("user", "email_day")).read())
    assert got == {(u, "2024-01-01"): (n, len(seen[u])) for u, n in logons.items()} and len(got) == 300
    assert 0 < sum(timers) <= 16


def test_tables_stored_as_one_file_or_as_a_folder_of_files(spark, tmp_path):
    """A folder of part files, or of folders by a partition column, is one table, as for a batch reader."""
    table = spark.range(40).selectExpr("id", "id % 2 as half", "cast(id as string) as w")
    table.repartition(3).write.parquet(str(tmp_path / "parts" / "t.parquet"))
    table.write.partitionBy("half").parquet(str(tmp_path / "halves" / "t.parquet"))
    (tmp_path / "one").mkdir()
    table.toPandas().to_parquet(tmp_path / "one" / "t.parquet")
    for folder, name in (("parts", "t.parquet"), ("halves", "t.parquet"), ("one", "t.parquet"), ("one", "*.parquet")):
        got = logs.run_to_table(logs.read_parquet_stream(spark, str(tmp_path / folder), name).select("id", "half", "w"), "read")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, table.collect())), folder


def rows(spark, n, size=5):
    return spark.createDataFrame([((n + i) % 12, n * 100 + i, None if i == 2 else "x") for i in range(size)], "k int, v int, w string")


def test_snapshots_bound_what_is_read(spark, tmp_path):
    table = SnapshotTable(spark, str(tmp_path / "t"), rows(spark, 0).schema, ("k",), most=3)
    want = {}
    assert table.read().count() == 0
    for n in range(14):
        table.add(rows(spark, n), n)
        table.add(rows(spark, n), n)  # a batch may come twice
        want |= {r["k"]: (r["v"], r["w"]) for r in rows(spark, n).collect()}
        assert {r["k"]: (r["v"], r["w"]) for r in table.read().collect()} == want
        assert len(table._parts()[0]) <= 1 + 3
    assert len(os.listdir(tmp_path / "t")) <= 2 + 3 * 3 + 1  # older bases and change sets are deleted


@pytest.mark.parametrize("broken", ["_publish", "_merged"])
def test_a_crash_between_base_and_snapshot_changes_nothing(spark, tmp_path, monkeypatch, broken):
    table = SnapshotTable(spark, str(tmp_path / "t"), rows(spark, 0).schema, ("k",), most=2)
    for n in range(2):
        table.add(rows(spark, n), n)

    def fail(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(table, broken, fail)
        with pytest.raises(OSError):
            table.add(rows(spark, 2), 2)
    want = {}
    for n in range(3):
        want |= {r["k"]: r["v"] for r in rows(spark, n).collect()}
    assert {r["k"]: r["v"] for r in table.read().collect()} == want and table._parts()[1] == -1
    table.add(rows(spark, 2), 2)  # the stream repeats the batch
    assert {r["k"]: r["v"] for r in table.read().collect()} == want and table._parts() == (["base-2"], 2)
