"""Tables laid out for lookups by key: hash buckets, sorted inside, with Bloom filters in the files.

A lookup of some keys reads the buckets of those keys, and of them the row groups whose statistics and Bloom filters don't
rule them out. A lookup of many keys moves the keys to the buckets and leaves the table where it is.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows of a bucket, in expectation; most buckets; bytes of a row group.
BUCKET_ROWS, MAX_BUCKETS, GROUP_BYTES = 4_000_000, 4096, 16 << 20


class KeyedScan:
    """A table of rows by key, at a path of its own."""

    def __init__(self, spark: SparkSession, name: str, key: str) -> None:
        self.spark, self.name, self.key = spark, name, key

    @staticmethod
    def save(rows: DataFrame, key: str, path: str, buckets: int | None = None, group_bytes: int = GROUP_BYTES) -> KeyedScan:
        """Write ``rows`` by key. Rows of a key stay together, in its bucket; there may be several. Without a number of
        buckets the rows are counted first."""
        spark = rows.sparkSession
        buckets = buckets or min(MAX_BUCKETS, max(1, -(-rows.count() // BUCKET_ROWS)))
        name = f"keyed_{uuid.uuid4().hex}"
        # One task a bucket, so one file a bucket.
        writer = rows.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key)
        writer.option(f"parquet.bloom.filter.enabled#{key}", "true").option("parquet.block.size", group_bytes).option("path", path).format("parquet").saveAsTable(name)
        return KeyedScan(spark, name, key)

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def get(self, keys: list) -> DataFrame:
        """The rows of some keys. The keys are literals, so buckets and row groups without them are left out."""
        rows = self.rows()
        return rows.where(rows[self.key].isin(keys))

    def get_many(self, keys: DataFrame, key: str | None = None) -> DataFrame:
        """The rows of many keys; keys may repeat, and of those without a row there is none. The table isn't shuffled: the
        keys are, to its buckets, or are broadcast where Spark measures them as small."""
        wanted = keys.select(keys[key or self.key].alias("__key")).distinct()
        rows = self.rows()
        return rows.join(wanted, rows[self.key] == wanted["__key"], "left_semi")

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
