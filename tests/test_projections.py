"""Projections by deltas against full recomputes, tables with snapshots, and pauses that end."""

from __future__ import annotations

import datetime
import random

import pytest
from pyspark.sql import functions as F

from cataloom.streaming.events import KeyedTable, read_log
from cataloom.streaming.projections import GroupRecords, records
from cataloom.streaming.subscribers import PAUSED, RUNNING, Subscribers, run_subscriber

CHANGES = "file string, seq long, groups array<string>, weight int, value int, year int, dead boolean"


def test_records_equal_a_full_recompute_after_random_updates_and_deletes(spark, tmp_path):
    rng = random.Random(3)
    kept = GroupRecords.at(spark, f"{tmp_path}/p", "file", "artist", snapshot_every=3)
    state, seq, worked_again = {}, 0, 0
    for batch in range(7):
        rows = []
        for _ in range(rng.randint(1, 25)):
            seq += 1
            file = f"f{rng.randrange(20)}"
            dead = rng.random() < 0.25
            artists = [rng.choice(["a", "b", "c", "d", None]) for _ in range(rng.randint(0, 3))]
            row = (file, seq, artists, rng.choice([None, 0, 3, 8]), rng.choice([None, 2, 5]), rng.choice([None, *range(1970, 1980)]), dead)
            rows.append(row)
            state[file] = None if dead else row
        rng.shuffle(rows)
        changes = spark.createDataFrame(rows, CHANGES)
        for _ in range(2 if batch == 4 else 1):  # a batch may run again
            worked_again += kept.update(changes, batch, "seq", F.col("dead")).where("again").count()
        want = {}
        for row in state.values():
            for artist in {a for a in (row[2] if row else []) if a}:
                want.setdefault(artist, []).append((row[3] or 0, row[4] or 0, row[5]))
        found = {r.artist: (r.albums, r.weight, r.weighted, r.low, r.high) for r in kept.read().collect()}
        years = lambda some: [y for *_, y in some if y is not None]
        assert found == {a: (len(s), sum(w for w, *_ in s), sum(w * v for w, v, _ in s), min(years(s), default=None), max(years(s), default=None)) for a, s in want.items()}
    assert worked_again > 0
    full = records(spark.createDataFrame([(a, *x) for a, s in want.items() for x in s], "artist string, weight int, value int, year int"), "artist")
    assert {r.artist: (r.albums, r.weight, r.weighted, r.low, r.high) for r in full.collect()} == found


def test_snapshots_shorten_what_is_read(spark, tmp_path):
    table = KeyedTable(spark, f"{tmp_path}/t", "k", snapshot_every=2)
    put = lambda rows, batch: table.merge(spark.createDataFrame(rows, "k string, seq long, v int, dead boolean"), batch, [F.col("seq")], F.col("dead"))
    put([("a", 1, 1, False), ("b", 2, 1, False)], 0)
    put([("a", 5, 2, False)], 1)
    put([("a", 3, 9, False), ("b", 6, 0, True)], 2)  # late news of a doesn't win over the snapshot
    at = lambda rows: {r.k: r.v for r in rows.collect()}
    assert at(table.read()) == {"a": 2} and at(table.read(before=2)) == {"a": 2, "b": 1} and at(table.read(before=1)) == {"a": 1, "b": 1}
    files = [f for f in table.read().inputFiles()]
    assert any("_snapshot=1" in f for f in files) and not any("/batch=0/" in f or "/batch=1/" in f for f in files)
    put([("b", 4, 7, False)], 3)  # what was deleted stays so for older news, also in a snapshot
    assert at(table.read()) == {"a": 2}
    put([("b", 9, 8, False)], 4)
    assert at(table.read()) == {"a": 2, "b": 8} and table.batches() == [0, 1, 2, 3, 4]


def test_a_pause_ends_at_its_time_and_nothing_is_skipped(spark, tmp_path):
    now = datetime.datetime(2024, 1, 1, 12, 0)
    clock = lambda: now
    people = Subscribers(spark, f"{tmp_path}/s")
    people.register("one", "two")
    people.register("one")
    people.set_status("absent", PAUSED)
    assert [(r.id, r.status) for r in people.statuses(now).collect()] == [("one", RUNNING), ("two", RUNNING)]
    seen: list[int] = []
    schema = "event_id long, event_type string"

    def arrive(*ids: int) -> None:
        spark.createDataFrame([(k, "t") for k in ids], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/log")

    def go(handle=None) -> bool:
        stream = read_log(spark, f"{tmp_path}/log", schema)
        return run_subscriber(people, "one", stream, handle or (lambda rows, n: seen.extend(r.event_id for r in rows.collect())), f"{tmp_path}/checkpoint", clock)

    arrive(1, 2)
    assert go() and sorted(seen) == [1, 2]
    people.pause_for("one", 600, now)
    arrive(3)
    assert not go() and sorted(seen) == [1, 2]
    now += datetime.timedelta(seconds=599)
    assert not go() and [r.status for r in people.statuses(now).collect()] == [PAUSED, RUNNING]
    now += datetime.timedelta(seconds=1)
    assert go() and sorted(seen) == [1, 2, 3]

    # Paused between two batches: the first is handled, the second waits.
    arrive(4)
    arrive(5)

    def pausing(rows, n):
        seen.extend(r.event_id for r in rows.collect())
        people.pause_until("one", now + datetime.timedelta(seconds=10))

    assert not go(pausing) and len(seen) == 4
    now += datetime.timedelta(seconds=11)
    assert go() and sorted(seen) == [1, 2, 3, 4, 5]

    def failing(rows, n):
        raise ValueError("a handler's own error")

    arrive(6)
    with pytest.raises(Exception, match="own error"):
        go(failing)
    assert go() and sorted(seen) == [1, 2, 3, 4, 5, 6]
