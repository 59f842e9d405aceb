"""Streams against the batch operators on the same events."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from cataloom.operators import eventlog
from cataloom.streaming import events as streams

EVENTS = "/root/testdata/sf0.001/events.parquet"


@pytest.fixture
def log(spark, tmp_path):
    rows = spark.read.parquet(EVENTS).withColumn("state", (F.pmod(F.xxhash64("event_id"), F.lit(7))).cast("int"))
    for k in range(3):
        rows.where(F.floor(F.col("event_id") / F.lit(1 + rows.count() // 3)) == k).coalesce(1).write.mode("append").parquet(f"{tmp_path}/log")
    return rows, f"{tmp_path}/log"


def test_state_fold_stream_equals_batch_and_python(spark, log, tmp_path):
    rows, path = log
    stream = streams.fold_state_stream(streams.read_log(spark, path, rows.schema), "user_id", "event_id", F.col("state"))
    query = stream.writeStream.outputMode("update").foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={n}")).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    query.awaitTermination()
    updates = spark.read.parquet(f"{tmp_path}/out")
    assert updates.select("batch").distinct().count() > 1
    last = updates.groupBy("key").agg(F.max_by("state", "batch").alias("state")).where("state > 0")
    got = {r.key: r.state for r in last.collect()}
    batch = {r.user_id: r.state for r in eventlog.fold_states(rows, "user_id", "event_id", F.col("state")).collect()}
    python = {}
    for r in sorted(rows.collect(), key=lambda r: r.event_id):
        python[r.user_id] = streams.next_state(python.get(r.user_id, 0), r.state)
    assert got == batch == {k: s for k, s in python.items() if s}


def test_compaction_stream_equals_batch_and_repeats_safely(spark, log, tmp_path):
    rows, path = log
    table = streams.KeyedTable(spark, f"{tmp_path}/table", "user_id")
    streams.compact_stream(streams.read_log(spark, path, rows.schema), table, "event_id", f"{tmp_path}/c1").awaitTermination()
    expected = {(r.user_id, r.event_id) for r in eventlog.compact(rows, ["user_id"], "event_id").collect()}
    assert {(r.user_id, r.event_id) for r in table.read().collect()} == expected
    # A replay from the start over the same table.
    streams.compact_stream(streams.read_log(spark, path, rows.schema), table, "event_id", f"{tmp_path}/c2").awaitTermination()
    assert {(r.user_id, r.event_id) for r in table.read().collect()} == expected
    fresh = table.rewrite(f"{tmp_path}/fresh")
    assert {(r.user_id, r.event_id) for r in fresh.read().collect()} == expected


def test_a_batch_writes_its_own_rows_only(spark, tmp_path):
    table = streams.KeyedTable(spark, f"{tmp_path}/t", "k")
    one = lambda rows: spark.createDataFrame(rows, "k string, seq long, gone boolean")
    table.merge(one([(f"k{i}", i, False) for i in range(50)]), 0, [F.col("seq")], F.col("gone"))
    table.merge(one([("k1", 100, True), ("new", 101, False)]), 1, [F.col("seq")], F.col("gone"))
    assert spark.read.parquet(f"{tmp_path}/t/batch=1").count() == 2
    assert {r.k for r in table.read().collect()} == {f"k{i}" for i in range(50) if i != 1} | {"new"} and table.read(1).count() == 50
    table.merge(one([("new", 101, False)]), 1, [F.col("seq")], F.col("gone"))
    assert table.read().count() == 51


def test_graph_sync_drops_stale_edges(spark, tmp_path):
    edges = streams.KeyedTable(spark, f"{tmp_path}/edges", "album")
    of = lambda albums: albums.select(F.col("album").alias("src"), F.explode("genres").alias("dst"), F.lit("PRIMARY").alias("type"), F.lit(3.0).alias("weight"))
    schema = "album string, seq long, genres array<string>"
    streams.sync_graph(spark.createDataFrame([("a", 1, ["x", "y"]), ("b", 2, ["x"])], schema), 0, edges, "seq", of)
    streams.sync_graph(spark.createDataFrame([("a", 3, ["y"]), ("b", 4, [])], schema), 1, edges, "seq", of)
    assert {(r.album, e.dst) for r in edges.read().collect() for e in r.edges} == {("a", "y")}


def test_list_runs_of_a_batch(spark, tmp_path):
    components = spark.createDataFrame([(1, "s1", 1, True), (1, "i1", 6, False), (2, "s2", 6, True)], "root long, component string, state int, is_segment boolean")
    streams.run_lists(spark.createDataFrame([(1,), (2,), (3,), (1,)], "root long"), 0, lambda roots: components.join(roots, "root"), f"{tmp_path}/out")
    read = lambda name: spark.read.parquet(f"{tmp_path}/out/{name}").drop("batch").collect()
    assert [tuple(r) for r in read("enqueued")] == [(1, "s1")]
    assert {(r.root, r.status) for r in read("statuses")} == {(1, "Started"), (2, "Completed"), (3, "Invalid")} and len(read("events")) == 3


def test_deletes_and_pause(spark, log, tmp_path):
    rows, path = log
    table = streams.KeyedTable(spark, f"{tmp_path}/t", "user_id")
    flag = {"paused": True}
    source = streams.read_log(spark, path, rows.schema, 10, ["click"])
    handle = lambda b, n: table.merge(b, n, [F.col("event_id")], F.col("state") == 0)
    with pytest.raises(Exception):  # noqa: B017
        streams.run(source, handle, f"{tmp_path}/c", lambda: flag["paused"]).awaitTermination()
    assert table.read() is None
    flag["paused"] = False
    streams.run(source, handle, f"{tmp_path}/c", lambda: flag["paused"]).awaitTermination()
    last = eventlog.compact(rows.where("event_type = 'click'"), ["user_id"], "event_id").where("state != 0")
    assert {r.user_id for r in table.read().collect()} == {r.user_id for r in last.collect()}


def test_group_handlers_and_dead_letters(spark, log, tmp_path):
    rows, _ = log

    def handler(group):
        if group["user_id"].iloc[0] % 2:
            raise ValueError("odd")
        return group[["user_id"]].head(1).assign(first=group["event_id"].iloc[0])

    out = streams.handle_groups(rows.select("user_id", "event_id"), ["user_id"], "event_id", handler, "user_id long, first long")
    streams.with_dead_letters(out, f"{tmp_path}/good", f"{tmp_path}/dead", 0)
    good, dead = spark.read.parquet(f"{tmp_path}/good"), spark.read.parquet(f"{tmp_path}/dead")
    assert {r.user_id: r.first for r in good.collect()} == {r.user_id: r.m for r in rows.where("user_id % 2 = 0").groupBy("user_id").agg(F.min("event_id").alias("m")).collect()}
    assert dead.count() == rows.where("user_id % 2 = 1").select("user_id").distinct().count() and dead.first().error == "ValueError: odd"


def test_rate_windows_stream(spark, log, tmp_path):
    rows, path = log
    # Watermarks need a zoned type.
    source = streams.read_log(spark, path, rows.schema, 10).withColumn("ts", F.col("ts").cast("timestamp"))
    query = streams.rate_windows(source, "ts", "1 day", 30).writeStream.outputMode("complete").format("memory").queryName("rates").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    query.awaitTermination()
    expected = {(r.window_start, r.n, r.throttled) for r in eventlog.windows_over_limit(rows.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "1 day", 30).collect()}
    assert {tuple(r) for r in spark.sql("select * from rates").collect()} == expected


def test_export_replaces_children(spark, tmp_path):
    parents, tracks = streams.KeyedTable(spark, f"{tmp_path}/p", "album"), streams.KeyedTable(spark, f"{tmp_path}/k", "album")
    schema = "album string, seq long, name string, tracks array<string>"
    streams.export(spark.createDataFrame([("a", 1, "A", ["x", "y"]), ("b", 2, "B", ["z"])], schema), 0, parents, {"tracks": ("album", tracks)}, "seq")
    streams.export(spark.createDataFrame([("a", 3, "A2", ["y"])], schema), 1, parents, {"tracks": ("album", tracks)}, "seq")
    assert {(r.album, r.name) for r in parents.read().collect()} == {("a", "A2"), ("b", "B")}
    assert {(r.album, t) for r in tracks.read().collect() for t in r.tracks} == {("a", "y"), ("b", "z")}
