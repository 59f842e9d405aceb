"""The event log in batch: compaction, cursors, grouping, and folds of states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cataloom.operators.catalog import latest_by

# States of a stored file. Failures may be left for any state; otherwise states only rise.
FILE_STATES = {"CrawlEnqueued": 1, "CrawlFailed": 2, "FileSaved": 3, "FileParsed": 4, "FileParseFailed": 5, "ReadModelUpdated": 6}
FAILED_STATES = (2, 5)


def compact(events: DataFrame, keys: list[str], sequence: str) -> DataFrame:
    """The latest event of each key; events without a key are all kept."""
    has_key = F.lit(True)
    for k in keys:
        has_key = has_key & F.col(k).isNotNull()
    keyed = latest_by(events.where(has_key), keys, [F.col(sequence)])
    return keyed.unionByName(events.where(~has_key))


def after_cursor(events: DataFrame, sequence: str, cursor: int, topics: list[str] | None, topic: str, limit: int) -> DataFrame:
    """The next ``limit`` events of some topics (all for none given) after a cursor, in order."""
    rows = events.where(F.col(sequence) > cursor)
    if topics is not None:
        rows = rows.where(F.col(topic).isin(topics))
    return rows.orderBy(sequence).limit(limit)


def topic_tails(events: DataFrame, topic: str, sequence: str, key: str) -> DataFrame:
    return events.groupBy(topic).agg(F.count("*").alias("n"), F.sum(F.col(key).isNull().cast("long")).alias("without_key"), F.max(sequence).alias("tail"))


def grouped_by(events: DataFrame, group: Column, sequence: str, body: Column) -> DataFrame:
    """Events of each group in order, for handlers that take a group at a time."""
    return events.groupBy(group.alias("group")).agg(F.array_sort(F.collect_list(F.struct(F.col(sequence).alias("seq"), body.alias("body")))).alias("events"))


def chunked(events: DataFrame, sequence: str, size: int, group: str | None = None) -> DataFrame:
    """Events with ``chunk``: groups of at most ``size`` consecutive ids of the log; within a group value if one is given,
    where an event without one is a group of its own by its id. No sort of the whole log is needed."""
    chunk = F.floor(F.col(sequence) / size)
    if group is None:
        return events.withColumn("chunk", chunk.cast("string"))
    own = F.coalesce(F.concat(F.lit("g:"), F.col(group).cast("string"), F.lit("/"), chunk.cast("string")), F.concat(F.lit("e:"), F.col(sequence).cast("string")))
    return events.withColumn("chunk", own)


def fold_states(events: DataFrame, key: str, sequence: str, state: Column, failed: tuple[int, ...] = FAILED_STATES, states: int = 7, chunk: int = 1024) -> DataFrame:
    """(key, state): states applied in order. From a failed state any state is allowed, otherwise only higher ones; a
    null state in an event deletes what is known.

    The order matters, so this is no maximum; but a run of events is a map from the state before to the state after,
    and maps compose. Each key's events are folded in chunks of the sequence to one map of ``states`` entries, and the
    maps of a key are composed, so no task holds all events of a hot key."""
    bad = F.array(*[F.lit(x) for x in failed])

    def step(now: Column, new: Column) -> Column:
        return F.when(new == 0, F.lit(0)).when((now == 0) | F.array_contains(bad, now) | (new > now), new).otherwise(now)

    def apply(after: Column, event: Column) -> Column:
        return F.transform(after, lambda s: step(s, event["state"]))

    same = F.array(*[F.lit(k) for k in range(states)])
    rows = events.select(key, F.col(sequence).cast("long").alias("__seq"), F.coalesce(state, F.lit(0)).cast("int").alias("__state"))
    listed = rows.groupBy(key, F.floor(F.col("__seq") / chunk).alias("__chunk")).agg(F.array_sort(F.collect_list(F.struct(F.col("__seq").alias("seq"), F.col("__state").alias("state")))).alias("s"))
    maps = listed.select(key, "__chunk", F.aggregate("s", same, apply).alias("map"))
    ordered = maps.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("__chunk", "map"))).alias("m"))
    return ordered.select(key, F.aggregate("m", F.lit(0), lambda now, m: F.get(m["map"], now)).alias("state")).where("state > 0")


def fold_lookups(events: DataFrame, key: str, sequence: str, step_number: Column, correlation: str) -> DataFrame:
    """(key, step, correlation): a transition is taken if the step rises or the correlation id differs.

    An event of another correlation is always taken, so the correlation is that of the last event, and the step is the
    highest since the last event of another one. Aggregates by key and correlation say where that was; no task holds all
    events of a key."""
    rows = events.select(F.col(key).alias("__key"), F.col(sequence).alias("seq"), step_number.alias("step"), F.col(correlation).cast("string").alias("by"))
    last = rows.groupBy("__key", "by").agg(F.max("seq").alias("seq"))
    ends = last.groupBy("__key").agg(F.max_by(F.struct("by"), "seq").alias("last"), F.max("seq").alias("end"))
    # The last event of another correlation.
    broken = last.join(ends, "__key").where("seq < end").groupBy("__key").agg(F.max("seq").alias("broken"))
    ends = ends.join(broken, "__key", "left").select(F.col("__key").alias("k"), F.col("last.by").alias("correlation"), "broken")
    tail = rows.join(ends, rows["__key"].eqNullSafe(ends["k"]) & rows["by"].eqNullSafe(ends["correlation"])).where("broken is null or seq > broken")
    # At the very start nothing is known: step 0 without a correlation.
    return tail.groupBy(F.col("k").alias(key), "correlation").agg(F.when(F.first("broken").isNull() & F.first("correlation").isNull(), F.greatest(F.max("step"), F.lit(0))).otherwise(F.max("step")).alias("step")).select(key, "step", "correlation")


def latest_failures(events: DataFrame, key: str, sequence: str, failed: Column, error: Column) -> DataFrame:
    """(key, error) of the keys whose latest event is a failure."""
    rows = events.select(key, F.col(sequence).alias("seq"), failed.alias("failed"), error.alias("error"))
    last = rows.groupBy(key).agg(F.max_by(F.struct("failed", "error"), F.col("seq")).alias("last"))
    return last.where("last.failed").select(key, "last.error")


def windows_over_limit(events: DataFrame, ts: str, width: str, limit: int, keys: list[str] | None = None) -> DataFrame:
    """Requests by fixed window, with whether the limit is passed."""
    counts = events.groupBy(F.window(ts, width).alias("w"), *(keys or [])).agg(F.count("*").alias("n"))
    return counts.select(F.col("w.start").alias("window_start"), *(keys or []), "n", (F.col("n") > limit).alias("throttled"))
