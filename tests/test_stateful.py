"""Stateful processors: lookups against a plain run of the log and the batch version, over shuffled batches; limits that
reset as time moves on."""

from __future__ import annotations

import datetime
import random

import pytest
from pyspark.sql import functions as F

from cataloom.streaming import stateful


@pytest.fixture(scope="module")
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    stateful.use_rocksdb(spark)
    yield spark
    spark.conf.set(name, before)


def a_log(seed: int, lookups: int = 25, albums: int = 8) -> list[tuple]:
    """News of files in an order in which it can arrive: some lookups fail, share an album, or end early; albums are
    parsed for other reasons, before or after; some news comes twice or too early."""
    rng = random.Random(seed)
    lines = []
    for k in range(lookups):
        key, album = f"lookup:q{k}", f"a{rng.randrange(albums)}"
        line = [(key, "Started", f"search/{k}", None), (key, "SearchSaved", f"search/{k}", None)]
        line += [(key, "SearchParseFailed", f"search/{k}", "broken")] if rng.random() < 0.3 else []
        line += [(key, "SearchParsed", f"search/{k}", album)] if rng.random() < 0.8 else []
        line += [(key, "AlbumSaved", album, None)] if rng.random() < 0.6 else []
        line += [(key, "AlbumParseFailed", album, "bad page")] if rng.random() < 0.3 else []
        line += [(key, "AlbumParsed", album, None)] if rng.random() < 0.3 else []
        line += [line[1], line[0]] if rng.random() < 0.3 else []
        lines.append(line[: rng.randint(1, len(line))])
    lines.append([("lookup:none", "SearchSaved", "search/x", None), ("lookup:none", "AlbumParsed", "a1", None)])
    lines += [[(f"album:a{k}", "AlbumParsed", f"a{k}", None)] for k in range(0, albums, 2)]
    out = []
    while any(lines):
        out.append(rng.choice([x for x in lines if x]).pop(0))
    return out


def plain_run(log: list[tuple]) -> dict[str, tuple]:
    """One event at a time; events for other keys go to the end of the log."""
    state, known, waiting, todo = {}, set(), {}, list(log)
    while todo:
        key, kind, file_name, detail = todo.pop(0)
        if key.startswith("album:"):
            name = key[6:]
            if kind == "AlbumParsed":
                known.add(name)
                todo += [(w, "AlbumParsed", name, None) for w in waiting.pop(name, [])]
            elif name in known:
                todo.append((detail, "AlbumParsed", name, None))
            else:
                waiting.setdefault(name, []).append(detail)
                todo.append((detail, "AlbumUnknown", name, None))
            continue
        step, album = state.get(key, (0, None))
        target = {"Started": 2, "SearchSaved": 3, "SearchParseFailed": 4, "SearchParsed": 5, "AlbumUnknown": 6, "AlbumSaved": 7, "AlbumParseFailed": 8, "AlbumParsed": 9}[kind]
        if (kind == "Started") != (step == 0) or target <= step or (target > 5 and album is None):
            continue
        if kind == "SearchParsed":
            album = detail
            todo.append((f"album:{album}", "Asked", album, key))
        state[key] = (target, album)
    return {k: (stateful.NAMES[s], a) for k, (s, a) in state.items()}


def streamed(spark, log: list[tuple], folder, seed: int) -> tuple[dict, list]:
    """The stream over a log that is cut into batches at random; its events are written behind the log until none come."""
    rng = random.Random(seed)
    schema = stateful.EVENTS
    seq, rest, found, commands = 0, list(log), {}, []

    def append(rows: list[tuple]) -> None:
        nonlocal seq
        numbered = []
        for row in rows:
            seq += 1
            numbered.append((seq, *row))
        rng.shuffle(numbered)  # within a batch the numbers tell the order
        spark.createDataFrame(numbered, schema).coalesce(1).write.mode("append").parquet(f"{folder}/log")

    def take(batch, number: int) -> None:
        for r in batch.collect():
            if r.row == "lookup":
                found[r.key] = (r.kind, r.file_name)
            elif r.row == "command":
                commands.append((r.key, r.file_name))
            else:
                back.append((r.key, r.kind, r.file_name, r.detail))

    while rest:
        size = rng.randint(10, 80)
        back: list[tuple] = rest[:size]
        rest = rest[size:]
        while back:
            append(back)
            back = []
            stream = stateful.run_lookups(spark.readStream.schema(schema).parquet(f"{folder}/log"))
            stream.writeStream.foreachBatch(take).outputMode("update").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return found, commands


def test_lookups_streamed_in_shuffled_batches_equal_the_plain_and_the_batch_run(rocks, tmp_path):
    for seed in (1, 2):
        log = a_log(seed)
        found, commands = streamed(rocks, log, f"{tmp_path}/{seed}", seed)
        want = plain_run(log)
        assert {k: kind for k, (kind, _) in found.items()} == {k: kind for k, (kind, _) in want.items()}
        assert len(commands) == len(set(commands)) and {k for k, f in commands if f.startswith("search/")} == set(want)
        assert len({kind for kind, _ in want.values()}) >= 5
        batch = stateful.lookup_outcomes(rocks.createDataFrame([(k, *row) for k, row in enumerate(log)], stateful.EVENTS)).collect()
        assert {r.key: (r.step, r.album) for r in batch} == want


def test_limits_reset_as_time_moves_on(rocks, tmp_path):
    start = datetime.datetime(2024, 1, 1)
    at = lambda s: start + datetime.timedelta(seconds=s)
    batches = [
        [(1, "a", at(1)), (2, "a", at(2)), (3, "a", at(3)), (4, "b", at(4)), (5, None, at(4)), (6, "a", None)],
        [(7, "a", at(30)), (8, "b", at(61))],  # the window of a goes on, b's second starts; a's ends by the watermark
        [(9, "b", at(62)), (10, "b", at(63)), (11, "b", at(64))],
        [(12, "a", at(200))],
        [(13, "c", at(400))],
    ]
    schema = "id long, who string, ts timestamp"
    rows = []
    for batch in batches:
        rocks.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        requests = rocks.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        query = stateful.limited(requests, "who", "ts", "id", limit=2, window_seconds=60).writeStream.foreachBatch(lambda batch, n: rows.extend(batch.collect()))
        query.outputMode("append").option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    kinds = {r.id: r.kind for r in rows if r.id is not None}
    assert kinds == {1: "admitted", 2: "admitted", 3: "throttled", 4: "admitted", 7: "throttled", 8: "admitted", 9: "admitted", 10: "throttled", 11: "throttled", 12: "admitted", 13: "admitted"}
    base = int(start.replace(tzinfo=datetime.timezone.utc).timestamp() * 1000)
    resets = {(r.key, (r.at_ms - base) // 1000): r.n for r in rows if r.kind == "reset"}
    assert resets[("a", 60)] == 4 and resets[("b", 120)] == 4 and ("a", 240) in resets
