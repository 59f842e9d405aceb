"""Queries over a job table: what to put, claim, finish and report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def claimable(now: Column, claim_seconds: int = 600) -> Column:
    """Due, and not claimed or claimed too long ago."""
    return (F.col("next_execution") <= now) & (F.col("claimed_at").isNull() | (F.col("claimed_at") < now - F.make_dt_interval(secs=F.lit(claim_seconds))))


def next_jobs(jobs: DataFrame, name: str | None, now: Column, n: int) -> DataFrame:
    """The next ``n`` jobs to claim, by priority, due time and id."""
    rows = jobs.where(claimable(now))
    rows = rows if name is None else rows.where(F.col("name") == name)
    return rows.orderBy("priority", "next_execution", "id").limit(n)


def find(jobs: DataFrame, ids: DataFrame) -> DataFrame:
    """The jobs of the asked ids, each once."""
    return jobs.join(ids.select("id").distinct(), "id", "left_semi")


def put(existing: DataFrame, asked: DataFrame) -> DataFrame:
    """The job table after puts: claimed jobs stay, existing ones change only if ``overwrite`` is set or the interval
    differs, new ones are added."""
    old = existing.select("id", F.col("claimed_at").alias("__claimed"), F.col("interval_seconds").alias("__interval"))
    joined = asked.join(old.withColumn("__known", F.lit(True)), "id", "left")
    taken = joined.where(F.col("__known").isNull() | (F.col("__claimed").isNull() & (F.col("overwrite") | ~F.col("__interval").eqNullSafe(F.col("interval_seconds")))))
    taken = taken.select(existing.columns)
    return existing.join(taken.select("id"), "id", "left_anti").select(existing.columns).unionByName(taken)


def finish(jobs: DataFrame, done: DataFrame, now: Column) -> DataFrame:
    """The job table after jobs ended, well or not: those with an interval are due again, the others go."""
    ended = jobs.join(done.select("id").distinct().withColumn("__done", F.lit(True)), "id", "left")
    ended = ended.where(F.col("__done").isNull() | F.col("interval_seconds").isNotNull())
    due = F.when(F.col("__done"), now + F.make_dt_interval(secs=F.col("interval_seconds"))).otherwise(F.col("next_execution"))
    return ended.withColumn("next_execution", due).withColumn("claimed_at", F.when(F.col("__done").isNull(), F.col("claimed_at"))).select(jobs.columns)


def monitor(jobs: DataFrame, processors: DataFrame) -> DataFrame:
    """Jobs and claimed jobs of every known job name; 0 where there are none."""
    counts = jobs.groupBy("name").agg(F.count("*").alias("jobs"), F.count("claimed_at").alias("claimed"))
    return processors.join(counts, "name", "left").na.fill(0, ["jobs", "claimed"])


def claim_time_left(now: Column, claim_seconds: int = 600) -> Column:
    """Seconds until a claim ends; 0 if it has."""
    spent = F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(F.col("claimed_at").cast("timestamp"))
    return F.when(F.col("claimed_at").isNotNull(), F.greatest(F.lit(claim_seconds) - spent, F.lit(0)))
