"""Keyed processes with several states and timers: the orchestration of album lookups, and request limits that reset.

Both are ``transformWithState`` processors, so the session needs the RocksDB state store (``use_rocksdb``). Their output has
rows of several kinds; what is meant for other keys comes back to them as further input through the event log.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

# Steps of an album lookup. They only rise, whatever the order in which news of files arrives.
STEPS = {
    "Started": 1, "SearchCrawling": 2, "SearchParsing": 3, "SearchParseFailed": 4, "SearchParsed": 5,
    "AlbumCrawling": 6, "AlbumParsing": 7, "AlbumParseFailed": 8, "AlbumParsed": 9,
}
NAMES = {number: name for name, number in STEPS.items()}
#: News of a file and the step to which it takes a lookup.
SEARCH_NEWS = {"SearchSaved": "SearchParsing", "SearchParseFailed": "SearchParseFailed", "SearchParsed": "SearchParsed"}
ALBUM_NEWS = {"AlbumSaved": "AlbumParsing", "AlbumParseFailed": "AlbumParseFailed", "AlbumParsed": "AlbumParsed"}

#: Input: the log's number, lookup or album, what happened, to which file, found album or error, on behalf of which lookup.
EVENTS = "seq long, key string, kind string, file_name string, detail string"
#: Output: a lookup's new state, a command to the crawler, or an event for the log (another key's news).
NEWS = "row string, key string, kind string, file_name string, detail string"


def use_rocksdb(spark: SparkSession) -> None:
    """Let this session's streaming queries keep their state in RocksDB, as these processors need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


class AlbumLookups(StatefulProcessor):
    """A lookup goes from a search page to an album page; an album knows who waits for it.

    Keys are ``lookup:<query>`` and ``album:<file>``. A lookup that starts has its search page crawled. When that is parsed,
    its album is asked: one that is known ends the lookup, otherwise the album page is crawled and the lookup waits, also for
    the same album parsed for another reason. A step is taken only if it is higher than the one before (``Started`` again
    changes nothing); news of an album page before the search result is no news. Events of a key are taken by their number
    within a batch."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.lookup = handle.getValueState("lookup", "step int, search string, album string, error string")
        self.known = handle.getValueState("known", "known boolean")
        self.waiting = handle.getMapState("waiting", "lookup string", "since long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: ANN001, N802, N803
        for event in sorted(rows, key=lambda r: r["seq"]):
            yield from self._of_album(key[0], event) if key[0].startswith("album:") else self._of_lookup(key[0], event)

    def _of_lookup(self, key: str, event: Row) -> Iterator[Row]:
        step, search, album, error = self.lookup.get() if self.lookup.exists() else (0, None, None, None)
        kind = event["kind"]
        commands = []
        if kind == "Started" and step == 0:
            after, search = "SearchCrawling", event["file_name"]
            commands.append(Row(row="command", key=key, kind="crawl", file_name=search, detail=None))
        elif step and kind in SEARCH_NEWS:
            after = SEARCH_NEWS[kind]
        elif step and album is not None and kind in ALBUM_NEWS:
            after = ALBUM_NEWS[kind]
        elif step and album is not None and kind == "AlbumUnknown":
            after = "AlbumCrawling"
        else:
            return
        if STEPS[after] <= step:
            return
        if after == "SearchParsed":
            album = event["detail"]
            commands.append(Row(row="event", key=f"album:{album}", kind="Asked", file_name=album, detail=key))
        elif after == "AlbumCrawling":
            commands.append(Row(row="command", key=key, kind="crawl", file_name=album, detail=None))
        error = event["detail"] if after.endswith("ParseFailed") else None
        self.lookup.update((STEPS[after], search, album, error))
        yield Row(row="lookup", key=key, kind=after, file_name=album or search, detail=error)
        yield from commands

    def _of_album(self, key: str, event: Row) -> Iterator[Row]:
        name = key.removeprefix("album:")
        if event["kind"] == "AlbumParsed":
            self.known.update((True,))
            waiting = sorted(k[0] for k in self.waiting.keys())
            for lookup in waiting:
                yield Row(row="event", key=lookup, kind="AlbumParsed", file_name=name, detail=None)
            self.waiting.clear()
        elif event["kind"] == "Asked":
            if self.known.exists():
                yield Row(row="event", key=event["detail"], kind="AlbumParsed", file_name=name, detail=None)
            else:
                self.waiting.updateValue((event["detail"],), (event["seq"],))
                yield Row(row="event", key=event["detail"], kind="AlbumUnknown", file_name=name, detail=None)

    def close(self) -> None:
        pass


def run_lookups(events: DataFrame) -> DataFrame:
    """The rows that a stream of events (``EVENTS``) gives (``NEWS``); its rows of kind event belong into the log again."""
    return events.where("key is not null").groupBy("key").transformWithState(AlbumLookups(), outputStructType=NEWS, outputMode="Update", timeMode="None")


def lookup_outcomes(events: DataFrame) -> DataFrame:
    """(key, step, album) of each lookup once all its news is in, worked out in batch from a finished log of files' news
    alone: which album its search found first, and whether that album was parsed by anyone."""
    mine = events.where(F.col("key").startswith("lookup:"))
    seq, kind = F.col("seq"), F.col("kind")
    start = mine.where(kind == "Started").groupBy("key").agg(F.min("seq").alias("start"), F.min_by("file_name", "seq").alias("search"))
    after = mine.join(start, "key").where(seq > F.col("start"))
    found = after.groupBy("key").agg(F.min(F.when(kind == "SearchParsed", seq)).alias("at"), F.min_by("detail", F.when(kind == "SearchParsed", seq)).alias("album"), F.count_if(kind == "SearchSaved").alias("saved"), F.count_if(kind == "SearchParseFailed").alias("failed"))
    later = after.join(found.where("at is not null").select("key", "at"), "key").where(seq > F.col("at")).groupBy("key")
    later = later.agg(F.count_if(kind == "AlbumSaved").alias("a_saved"), F.count_if(kind == "AlbumParseFailed").alias("a_failed"), F.count_if(kind == "AlbumParsed").alias("a_parsed"))
    known = events.where(F.col("key").startswith("album:") & (kind == "AlbumParsed")).select(F.expr("substring(key, 7)").alias("album")).distinct().withColumn("known", F.lit(True))
    out = start.join(found, "key", "left").join(later, "key", "left").join(known, "album", "left")
    step = (
        F.when(F.col("at").isNull(), F.when(F.col("failed") > 0, "SearchParseFailed").when(F.col("saved") > 0, "SearchParsing").otherwise("SearchCrawling"))
        .when(F.col("known") | (F.col("a_parsed") > 0), "AlbumParsed").when(F.col("a_failed") > 0, "AlbumParseFailed").when(F.col("a_saved") > 0, "AlbumParsing").otherwise("AlbumCrawling")
    )
    return out.select("key", step.alias("step"), "album")


class RequestLimit(StatefulProcessor):
    """Counts a key's requests and marks those beyond a limit as throttled; a timer sets the count back at the end of each
    window, and nothing of the key is kept until its next request. Windows are by event time."""

    def __init__(self, limit: int, window_ms: int) -> None:
        self.limit, self.window_ms = limit, window_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.window = handle.getValueState("window", "ends long, n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: ANN001, N802, N803
        ends, n = self.window.get() if self.window.exists() else (0, 0)
        for request in sorted(rows, key=lambda r: (r["ts_ms"], r["id"])):
            at = request["ts_ms"]
            if at >= ends:
                if ends:
                    self.handle.deleteTimer(ends)
                ends, n = at - at % self.window_ms + self.window_ms, 0
                self.handle.registerTimer(ends)
            n += 1
            yield Row(key=key[0], kind="throttled" if n > self.limit else "admitted", at_ms=at, id=request["id"], n=n)
        self.window.update((ends, n))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: ANN001, N802, N803
        ends, n = self.window.get() if self.window.exists() else (0, 0)
        if expiredTimerInfo.getExpiryTimeInMs() >= ends:
            self.window.clear()
            yield Row(key=key[0], kind="reset", at_ms=ends, id=None, n=n)

    def close(self) -> None:
        pass


def limited(requests: DataFrame, key: str, ts: str, request_id: str, limit: int, window_seconds: int, late: str = "0 seconds") -> DataFrame:
    """(key, kind, at_ms, id, n): each request admitted or throttled, and a row for each window that ended with how many
    requests it had. ``limit`` requests of a window are admitted."""
    rows = requests.select(F.col(key).cast("string").alias("key"), F.col(ts).cast("timestamp").alias("ts"), F.col(request_id).cast("long").alias("id")).where("ts is not null and key is not null")
    rows = rows.withColumn("ts_ms", F.unix_millis("ts")).withWatermark("ts", late)
    out = "key string, kind string, at_ms long, id long, n long"
    return rows.groupBy("key").transformWithState(RequestLimit(limit, window_seconds * 1000), outputStructType=out, outputMode="Append", timeMode="EventTime")
