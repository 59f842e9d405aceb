"""The event log as a source with cursor, limit and topics, and the export whose writes are seen whole or not at all."""

from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

from cataloom.sources import event_log, export


@pytest.fixture(scope="module")
def log(spark, tmp_path_factory):
    """Files of 10 numbers each with gaps, written out of order, and some of a second topic."""
    spark.dataSource.register(event_log.EventLog)
    path = f"{tmp_path_factory.mktemp('log')}/events"
    for start in (20, 0, 10, 30):
        rows = [(k, "even" if k % 2 == 0 else "odd", f"k{k % 3}") for k in range(start, start + 10) if k % 5 != 3]
        spark.createDataFrame(rows, "id long, topic string, key string").coalesce(1).write.mode("append").parquet(path)
    return path


NUMBERS = [k for k in range(40) if k % 5 != 3]


def test_the_log_in_batch_from_a_cursor_with_a_limit_and_topics(spark, log):
    read = lambda **o: sorted(r.id for r in spark.read.format("event_log").options(path=log, **o).load().collect())
    assert read() == NUMBERS and read(cursor="16") == [k for k in NUMBERS if k > 16] and read(cursor="99") == []
    assert read(cursor="4", limit="5", checkpoint="none", topics="even") == [k for k in NUMBERS if k > 4 and k % 2 == 0][:5]
    assert read(tasks="1", topics="odd,even") == NUMBERS and read(topics="absent") == []
    frame = spark.read.format("event_log").options(path=log, tasks="4").load()
    assert frame.dtypes == [("id", "bigint"), ("topic", "string"), ("key", "string")] and frame.rdd.getNumPartitions() == 4


def test_the_log_as_a_stream_restarts_goes_on_and_replays(spark, log, tmp_path):
    batches: list[list[int]] = []

    def run(checkpoint: str, **options) -> int:
        before = len(batches)
        told = {"path": log, "checkpoint": f"{tmp_path}/{checkpoint}"} | options
        stream = spark.readStream.format("event_log").options(**told).load()
        query = stream.writeStream.foreachBatch(lambda rows, n: batches.append(sorted(r.id for r in rows.collect())))
        query.option("checkpointLocation", f"{tmp_path}/{checkpoint}").trigger(availableNow=True).start().awaitTermination()
        return len(batches) - before

    while run("a", cursor="9", limit="6"):  # each run is a restart
        pass
    wanted = [k for k in NUMBERS if k > 9]
    assert batches == [wanted[k : k + 6] for k in range(0, len(wanted), 6)]
    batches.clear()
    run("b", topics="odd")  # a replay of one topic from the start
    assert batches == [[k for k in NUMBERS if k % 2]]
    spark.createDataFrame([(50, "even", "k"), (51, "odd", "k")], "id long, topic string, key string").coalesce(1).write.mode("append").parquet(log)
    batches.clear()
    run("b", topics="odd")
    run("a", cursor="9", limit="6")
    assert batches == [[51], [50, 51]]


def test_a_limit_needs_a_checkpoint(spark, log):
    with pytest.raises(Exception, match="checkpoint"):
        spark.read.format("event_log").options(path=log, limit="3").load().collect()


ALBUMS = "file string, name string, tracks array<struct<name:string,seconds:int>>, genres array<string>"


def test_parents_and_children_are_seen_together(spark, tmp_path):
    spark.dataSource.register(export.Export)
    path = f"{tmp_path}/out"
    save = lambda rows, batch: rows.write.format("catalogue_export").mode("append").options(path=path, key="file", children="tracks,genres", batch=str(batch)).save()
    see = lambda table, **o: sorted((tuple(r) for r in export.read_export(spark, path, "file", table, **o).collect()), key=str)
    assert export.read_export(spark, path, "file") is None
    first = [("a", "A", [("one", 1), ("two", 2)], ["g"]), ("b", "B", None, []), ("c", None, [("x", None)], ["g", "h"])]
    save(spark.createDataFrame(first, ALBUMS).repartition(3), 0)
    assert see("parents") == [("a", "A"), ("b", "B"), ("c", None)] and see("genres") == [("a", 0, "g"), ("c", 0, "g"), ("c", 1, "h")]
    assert [(k, p, t.name) for k, p, t in see("tracks")] == [("a", 0, "one"), ("a", 1, "two"), ("c", 0, "x")]

    # A task fails after others have written: nothing of the batch is seen.
    fails = F.udf(lambda name: 1 // 0 if name == "bad" else name)
    rows = spark.createDataFrame([(f"n{k}", "bad" if k == 7 else "good", [("t", k)], []) for k in range(8)], ALBUMS)
    with pytest.raises(Exception, match="division"):
        save(rows.repartition(4).withColumn("name", fails("name")), 1)
    assert len(see("parents")) == 3 and len(export.manifests(path)) == 1
    for _ in range(30):  # tasks that were running when the job failed may end a little later
        time.sleep(1)
        if not export.vacuum(path):
            break
    assert len(see("tracks")) == 3 and export.vacuum(path) == 0

    # A later batch replaces a parent and all its children; running it again changes nothing.
    for _ in range(2):
        save(spark.createDataFrame([("a", "A2", [("new", 9)], [])], ALBUMS), 1)
    assert see("parents") == [("a", "A2"), ("b", "B"), ("c", None)] and see("genres") == [("c", 0, "g"), ("c", 1, "h")]
    assert [(k, t.name) for k, _, t in see("tracks")] == [("a", "new"), ("c", "x")]
    assert see("parents", update=False)[0] == ("a", "A") and export.vacuum(path) == 3


def test_a_stream_is_exported_batch_by_batch(spark, tmp_path):
    spark.dataSource.register(export.Export)
    path = f"{tmp_path}/out"
    for k in range(2):
        spark.createDataFrame([("a", f"A{k}", [("t", k)], None), (f"b{k}", "B", [], ["g"])], ALBUMS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(ALBUMS).parquet(f"{tmp_path}/in").writeStream.format("catalogue_export").options(path=path, key="file", children="tracks,genres")
        stream.option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    assert sorted((r.file, r.name) for r in export.read_export(spark, path, "file").collect()) == [("a", "A1"), ("b0", "B"), ("b1", "B")]
    assert [(r.file, r.tracks.seconds) for r in export.read_export(spark, path, "file", "tracks").collect()] == [("a", 1)]
