"""Read models that follow changed rows by signed deltas: what a row said before goes out, what it says now comes in.

Counts and weighted sums take deltas as they are. A least or greatest value takes new rows as they come, and only for groups
whose extreme row left is it worked out again, from the rows of those groups alone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cataloom.operators.catalog import latest_by
from cataloom.streaming.events import KeyedTable


def records(rows: DataFrame, group: str) -> DataFrame:
    """(group, albums, weight, weighted, low, high) of rows (group, weight, value, year): how many there are, the sum of
    weights and of weight times value, the least and greatest year."""
    return rows.groupBy(group).agg(
        F.count("*").alias("albums"), F.sum("weight").alias("weight"), F.sum(F.col("weight") * F.col("value")).alias("weighted"), F.min("year").alias("low"), F.max("year").alias("high"),
    )


def mean_rating() -> Column:
    """The weighted mean of a record; null without weights."""
    return F.try_divide(F.col("weighted"), F.col("weight"))


@dataclass
class GroupRecords:
    """Records of the groups that keyed rows belong to (the artists of albums), kept in two tables: the rows at hand
    (``rows``: key, groups, weight, value, year) and the records. A batch that runs again gives the same tables."""

    rows: KeyedTable
    records: KeyedTable

    @staticmethod
    def at(spark: SparkSession, path: str, key: str, group: str, snapshot_every: int = 50) -> GroupRecords:
        return GroupRecords(KeyedTable(spark, f"{path}/rows", key, snapshot_every), KeyedTable(spark, f"{path}/records", group, snapshot_every))

    def _listed(self, rows: DataFrame, sign: int) -> DataFrame:
        """A row for each distinct group of each row; weights count as long integers, missing ones as none."""
        weight = F.coalesce(F.col("weight").cast("long"), F.lit(0))
        return rows.select(F.explode(F.array_distinct("groups")).alias(self.records.key), weight.alias("weight"), F.coalesce("value", F.lit(0)).alias("value"), "year", F.lit(sign).alias("sign")).where(F.col(self.records.key).isNotNull())

    def update(self, changes: DataFrame, batch: int, sequence: str, deleted: Column | None = None) -> DataFrame:
        """Take in a batch of changed rows (key, sequence, groups, weight, value, year), of a key the last one by
        ``sequence``. Returns (group, again): the groups that changed, and whether their extremes were worked out again."""
        group, key = self.records.key, self.rows.key
        gone = F.coalesce(deleted, F.lit(False)) if deleted is not None else F.lit(False)
        last = latest_by(changes.withColumn("gone", gone), [key], [F.col(sequence)])
        before = self.rows.read(before=batch)
        self.rows.merge(last.select(key, sequence, "groups", F.col("weight").cast("long").alias("weight"), "value", "year", "gone"), batch, [F.col(sequence)], F.col("gone"))
        after = self.rows.read(before=batch + 1)
        keys = last.select(key)
        signed = self._listed(after.join(keys, key, "left_semi"), 1)
        if before is not None:
            signed = signed.unionByName(self._listed(before.join(keys, key, "left_semi"), -1))
        sign, into = F.col("sign"), lambda what: F.when(F.col("sign") > 0, F.col(what))
        out_of = lambda what: F.when(F.col("sign") < 0, F.col(what))
        deltas = signed.groupBy(group).agg(
            F.sum(sign).alias("d_albums"), F.sum(sign * F.col("weight")).alias("d_weight"), F.sum(sign * F.col("weight") * F.col("value")).alias("d_weighted"),
            F.min(into("year")).alias("in_low"), F.max(into("year")).alias("in_high"), F.min(out_of("year")).alias("out_low"), F.max(out_of("year")).alias("out_high"),
        )
        known = self.records.read(before=batch)
        known = None if known is None else known.drop("as_of")
        if known is None:
            known = deltas.select(group, F.lit(0).cast("long").alias("albums"), F.lit(0).cast("long").alias("weight"), (F.col("d_weighted") * 0).alias("weighted"), F.col("in_low").alias("low"), F.col("in_high").alias("high")).limit(0)
        met = deltas.join(known, group, "left").fillna(0, ["albums", "weight", "weighted"])
        albums = F.col("albums") + F.col("d_albums")
        # An extreme has left if a row with it went out and none with it or beyond came in.
        lost = (F.col("out_low") <= F.col("low")) & (F.col("in_low").isNull() | (F.col("in_low") > F.col("low"))) | (F.col("out_high") >= F.col("high")) & (F.col("in_high").isNull() | (F.col("in_high") < F.col("high")))
        met = met.select(group, albums.alias("albums"), (F.col("weight") + F.col("d_weight")).alias("weight"), (F.col("weighted") + F.col("d_weighted")).alias("weighted"), F.least("low", "in_low").alias("low"), F.greatest("high", "in_high").alias("high"), ((albums > 0) & F.coalesce(lost, F.lit(False))).alias("again"))
        wanted = met.where("again").select(group)
        fresh = self._listed(after, 1).join(wanted, group, "left_semi").groupBy(group).agg(F.min("year").alias("f_low"), F.max("year").alias("f_high"))
        out = met.join(fresh, group, "left").select(group, "albums", "weight", "weighted", F.when(F.col("again"), F.col("f_low")).otherwise(F.col("low")).alias("low"), F.when(F.col("again"), F.col("f_high")).otherwise(F.col("high")).alias("high"), "again")
        self.records.merge(out.drop("again").withColumn("as_of", F.lit(batch)), batch, [F.col("as_of")], F.col("albums") <= 0)
        return met.select(group, "again")

    def read(self) -> DataFrame | None:
        """The records of all groups."""
        rows = self.records.read()
        return None if rows is None else rows.drop("as_of")
