"""The event log as streams: state folds, keyed read models, grouped handlers, dead letters and rate windows.

A stream's place is its checkpoint; a replay is a new checkpoint folder, a pause is stopping the query. A batch that
fails is run again, so every sink here gives the same result when a batch repeats.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from cataloom.operators import graph, lookups
from cataloom.operators.catalog import latest_by
from cataloom.operators.eventlog import FAILED_STATES


def read_log(spark: SparkSession, path: str, schema, files_per_batch: int = 1, topics: list[str] | None = None, topic: str = "event_type") -> DataFrame:
    """Events from Parquet files as they arrive, of some topics or of all."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    return rows if topics is None else rows.where(F.col(topic).isin(topics))


def next_state(now: int, new: int, failed: Iterable[int] = FAILED_STATES) -> int:
    """One step of a state fold: 0 deletes; from nothing or a failure any state is taken, otherwise only a higher one."""
    if new == 0 or now == 0 or now in failed or new > now:
        return new
    return now


def fold_state_stream(events: DataFrame, key: str, sequence: str, state: Column) -> DataFrame:
    """(key, state) updates: the states of each key folded in order of the log, across batches. A state of 0 is a delete."""
    rows = events.select(F.col(key).alias("key"), F.col(sequence).cast("long").alias("seq"), F.coalesce(state, F.lit(0)).cast("int").alias("state"))
    kind = rows.schema["key"].dataType.simpleString()

    def fold(key: tuple, batches: Iterator[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
        now = kept.get[0] if kept.exists else 0
        for new in pd.concat(list(batches)).sort_values("seq")["state"]:
            now = next_state(now, int(new))
        kept.update((now,))
        yield pd.DataFrame({"key": [key[0]], "state": [now]})

    return rows.groupBy("key").applyInPandasWithState(fold, f"key {kind}, state int", "state int", "update", GroupStateTimeout.NoTimeout)


class KeyedTable:
    """A read model by key: the changed rows of each batch as a Parquet partition ``batch=<number>``, so that running a
    batch again replaces what it wrote. Readers take the last change of each key. Every ``snapshot_every`` batches the last
    rows of all keys are written beside, so that a read costs a snapshot and the batches since, not the whole history."""

    def __init__(self, spark: SparkSession, path: str, key: str, snapshot_every: int = 50) -> None:
        self.spark, self.path, self.key, self.snapshot_every = spark, path.rstrip("/"), key, snapshot_every

    def _names(self) -> list[str]:
        """The names of folders in the table's folder."""
        folder = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        files = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return [f.getPath().getName() for f in files.listStatus(folder)] if files.exists(folder) else []

    def _snapshot(self, names: list[str], before: int | None) -> int | None:
        """The last finished snapshot of the batches before one."""
        folder = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        files = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        done = sorted(int(n.partition("=")[2]) for n in names if n.startswith("_snapshot="))
        for number in reversed([k for k in done if before is None or k < before]):
            if files.exists(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/_snapshot={number}/_SUCCESS")):
                return number
        return None

    def batches(self) -> list[int]:
        """The numbers of the batches written so far."""
        return sorted(int(n.partition("=")[2]) for n in self._names() if n.startswith("batch="))

    def _last(self, before: int | None) -> DataFrame | None:
        """The last change of each key, deletions included."""
        names = self._names()
        since = self._snapshot(names, before)
        parts = [int(n.partition("=")[2]) for n in names if n.startswith("batch=")]
        parts = [k for k in parts if (before is None or k < before) and (since is None or k > since)]
        found = [self.spark.read.option("basePath", self.path).parquet(*[f"{self.path}/batch={k}" for k in parts])] if parts else []
        found += [self.spark.read.parquet(f"{self.path}/_snapshot={since}")] if since is not None else []
        if not found:
            return None
        rows = reduce(lambda a, b: a.unionByName(b.select(a.columns)), found)
        kept = [c for c in rows.columns if c != "batch"]
        last = rows.groupBy(self.key).agg(F.max_by(F.struct(*kept, "batch"), F.struct("__order", "batch")).alias("__row"))
        return last.select(*[F.col("__row")[c].alias(c) for c in (*kept, "batch")])

    def read(self, before: int | None = None) -> DataFrame | None:
        """The rows at hand, or those before a batch; None if nothing was ever written."""
        last = self._last(before)
        return None if last is None else last.where("not __deleted").drop("__deleted", "__order", "batch")

    def merge(self, rows: DataFrame, batch: int, order: list[Column], deleted: Column | None = None) -> None:
        """Take in the last row of each key; rows for which ``deleted`` holds remove their key."""
        last = latest_by(rows, [self.key], order)
        marks = F.coalesce(deleted, F.lit(False)) if deleted is not None else F.lit(False)
        last = last.withColumns({"__deleted": marks, "__order": F.struct(*[c.alias(f"o{k}") for k, c in enumerate(order)])})
        last.write.mode("overwrite").parquet(f"{self.path}/batch={batch}")
        if batch >= 0 and batch % self.snapshot_every == self.snapshot_every - 1:
            self._last(batch + 1).write.mode("overwrite").parquet(f"{self.path}/_snapshot={batch}")

    def rewrite(self, path: str) -> KeyedTable:
        """The rows at hand as a new table without history, for readers to move to."""
        rows = self.read()
        out = KeyedTable(self.spark, path, self.key)
        if rows is not None:
            out.merge(rows, -1, [F.lit(0)])
        return out


def compact_stream(events: DataFrame, table: KeyedTable, sequence: str, checkpoint: str, deleted: Column | None = None) -> StreamingQuery:
    """Keep the latest event of each key in ``table`` until the input at hand is used up."""
    return run(events, lambda rows, batch: table.merge(rows, batch, [F.col(sequence)], deleted), checkpoint)


def run(events: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, paused: Callable[[], bool] | None = None) -> StreamingQuery:
    """Give each batch to ``handle`` until the input at hand is used up. A pause flag is read before each batch: while it
    is set the batch fails and nothing is marked as read, so that a later start takes it up again."""

    def batch(rows: DataFrame, number: int) -> None:
        if paused is not None and paused():
            raise RuntimeError("the subscriber is paused")
        handle(rows, number)

    return events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def handle_groups(rows: DataFrame, keys: list[str], order: str, handler: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Run a Python handler once for each group with its events in order. A group whose handler fails gives a row with
    ``error`` set and null values, so one bad group doesn't stop a batch."""

    def call(group: pd.DataFrame) -> pd.DataFrame:
        try:
            return handler(group.sort_values(order)).assign(error=None)
        except Exception as failure:
            return pd.DataFrame([{k: group[k].iloc[0] for k in keys} | {"error": f"{type(failure).__name__}: {failure}"}]).reindex(columns=names)

    names = [part.split()[0] for part in schema.split(",")] + ["error"]
    return rows.groupBy(*keys).applyInPandas(call, f"{schema}, error string")


def with_dead_letters(results: DataFrame, good: str, dead: str, batch: int) -> None:
    """Write the results of a batch, and apart from them the groups that failed. Folders are by batch number."""
    results = results.persist()
    results.where("error is null").drop("error").write.mode("overwrite").parquet(f"{good}/batch={batch}")
    results.where("error is not null").write.mode("overwrite").parquet(f"{dead}/batch={batch}")
    results.unpersist()


def rate_windows(events: DataFrame, ts: str, width: str, limit: int, late: str = "1 day") -> DataFrame:
    """Requests of each fixed window with whether the limit is passed; a window is final once it is ``late`` past."""
    counts = events.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w")).agg(F.count("*").alias("n"))
    return counts.select(F.col("w.start").alias("window_start"), "n", (F.col("n") > limit).alias("throttled"))


def export(rows: DataFrame, batch: int, parents: KeyedTable, children: dict[str, tuple[str, KeyedTable]], sequence: str) -> None:
    """Export a batch of nested rows: parents by key, and each array column as a child table whose rows of a saved parent
    are replaced as one value, so that no stale child stays."""
    last = latest_by(rows, [parents.key], [F.col(sequence)])
    parents.merge(last.drop(*children), batch, [F.col(sequence)])
    for column, (key, table) in children.items():
        table.merge(last.select(F.col(parents.key).alias(key), sequence, column), batch, [F.col(sequence)])


def sync_graph(changed: DataFrame, batch: int, edges: KeyedTable, sequence: str, edges_of: Callable[[DataFrame], DataFrame]) -> None:
    """Keep a graph in step with changed nodes: the edges of each changed source are replaced as one value, so edges that
    a node no longer has go. ``edges_of`` gives (src, dst, type, weight) of nodes; a node without edges has an empty list."""
    last = latest_by(changed, [edges.key], [F.col(sequence)])
    listed = graph.edge_lists(edges_of(last))
    rows = last.select(edges.key, sequence).join(listed.withColumnRenamed("src", edges.key), edges.key, "left")
    edges.merge(rows.withColumn("edges", F.coalesce("edges", F.array().cast(listed.schema["edges"].dataType))), batch, [F.col(sequence)])


def run_lists(batch: DataFrame, number: int, components_of: Callable[[DataFrame], DataFrame], out: str) -> None:
    """Run the lists of a batch of requests: components to enqueue again, statuses and events, each a folder by batch."""
    roots = batch.select("root").distinct()
    for name, rows in zip(("enqueued", "statuses", "events"), lookups.run_lists(roots, components_of(roots), "root", "is_segment"), strict=True):
        rows.write.mode("overwrite").parquet(f"{out}/{name}/batch={number}")
