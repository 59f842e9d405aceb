"""Subscribers of the event log: their status, pauses that end at a time, and runs that respect both.

A subscriber's place is its checkpoint. While it is paused no batch starts, so nothing is skipped; a pause with an end is a
row with a time, and whoever asks after that time finds the subscriber running again.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cataloom.streaming.events import KeyedTable

# What a subscriber may be.
RUNNING, PAUSED = "Running", "Paused"
SCHEMA = "id string, version long, status string, resume_at timestamp_ntz"


class Subscribers:
    """The control table of subscribers, one row each."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.table = spark, KeyedTable(spark, path, "id")

    def _rows(self) -> DataFrame:
        rows = self.table.read()
        return self.spark.createDataFrame([], SCHEMA) if rows is None else rows

    def _put(self, rows: DataFrame) -> None:
        number = max(self.table.batches(), default=-1) + 1
        self.table.merge(rows.withColumn("version", F.lit(number).cast("long")), number, [F.col("version")])

    def register(self, *ids: str) -> None:
        """Add subscribers that aren't known yet, as running."""
        new = self.spark.createDataFrame([(i, 0, RUNNING, None) for i in ids], SCHEMA)
        self._put(new.join(self._rows().select("id"), "id", "left_anti"))

    def set_status(self, subscriber: str, status: str, resume_at: datetime.datetime | None = None) -> None:
        """Change the status of a subscriber; one that isn't known stays unknown."""
        known = self._rows().where(F.col("id") == subscriber)
        self._put(known.withColumns({"status": F.lit(status), "resume_at": F.lit(resume_at).cast("timestamp_ntz")}))

    def pause_until(self, subscriber: str, until: datetime.datetime) -> None:
        self.set_status(subscriber, PAUSED, until)

    def pause_for(self, subscriber: str, seconds: float, now: datetime.datetime) -> None:
        self.pause_until(subscriber, now + datetime.timedelta(seconds=seconds))

    def statuses(self, now: datetime.datetime) -> DataFrame:
        """(id, status, resume_at) at a time: a pause that has ended is none."""
        over = (F.col("status") == PAUSED) & (F.col("resume_at") <= F.lit(now).cast("timestamp_ntz"))
        rows = self._rows().select("id", F.when(over, RUNNING).otherwise(F.col("status")).alias("status"), F.when(~F.coalesce(over, F.lit(False)), F.col("resume_at")).alias("resume_at"))
        return rows.orderBy("id")

    def is_running(self, subscriber: str, now: datetime.datetime) -> bool:
        row = self.statuses(now).where(F.col("id") == subscriber).first()
        return row is not None and row["status"] == RUNNING


def run_subscriber(subscribers: Subscribers, subscriber: str, events: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, clock: Callable[[], datetime.datetime]) -> bool:
    """Give the input at hand to ``handle`` batch by batch, if the subscriber runs; returns whether all of it was handled.

    The status is asked before each batch. One that is paused meanwhile ends the run before that batch, which the next run
    takes up; an error of the handler is raised."""

    class PausedMeanwhile(Exception):  # noqa: N818
        pass

    stopped = False

    def batch(rows: DataFrame, number: int) -> None:
        nonlocal stopped
        if not subscribers.is_running(subscriber, clock()):
            stopped = True
            raise PausedMeanwhile
        handle(rows, number)

    if not subscribers.is_running(subscriber, clock()):
        return False
    query = events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    except Exception:
        if not stopped:
            raise
    return not stopped
