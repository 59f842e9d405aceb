"""Approximate nearest neighbours: inverted cells of int8 codes, pre-filters kept, exact rerank.

Vectors are placed in the cells of a k-means (Spark's own, with cosine distance, fitted on a bounded sample) and written as
Parquet by cell, with a code of one byte a component beside the vector. A search takes its nearest cells until those hold
enough rows that pass its filter, ranks their codes, and compares only the best by the vectors themselves. Cells are pruned
as partitions, filters are pushed into the scan, and of the cells read only codes are unless a row is a candidate.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cataloom.functions.vectors import cosine_similarity, unit

#: Most cells, and vectors for each of them that k-means is fitted on, in expectation.
MAX_CELLS, FIT_PER_CELL = 4096, 64
#: Cells that a search reads at least, and candidates that are compared exactly for each row asked for.
PROBES, REFINE = 8, 10
#: Rows of a cell and queries that a task holds at a time, in expectation.
BLOCK, QUERIES = 8192, 4096


def _unit_rows(column: pd.Series | pa.Array) -> np.ndarray:
    x = np.stack(column.to_numpy(zero_copy_only=False) if isinstance(column, pa.Array) else column.to_numpy()).astype(np.float64)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def _codes(column: pa.Array) -> np.ndarray:
    """Codes as rows of small integers."""
    data = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.frombuffer(b"".join(data.to_pylist()), np.int8).reshape(len(data), -1)


def nearest_cells(x: np.ndarray, centres: np.ndarray, rows: np.ndarray, k: int, probes: int) -> list[list[int]]:
    """For each unit row of ``x`` its nearest cells: ``probes`` of those with any of ``rows`` (how many a cell has), and
    more until they have ``k`` in all."""
    out = []
    some = np.flatnonzero(rows)
    for order in np.argsort(-(x @ centres[some].T), axis=1, kind="stable"):
        cells = some[order]
        enough = int(np.searchsorted(np.cumsum(rows[cells]), k)) + 1
        out.append(cells[: max(probes, enough)].tolist())
    return out


class VectorIndex:
    """An index in a folder. Vectors that are null, zero or of another length than the index's aren't in it."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        cells = spark.read.parquet(f"{self.path}/cells").orderBy("cell").collect()  # at most MAX_CELLS
        self.centres = np.array([r["centre"] for r in cells])
        self.sizes = np.array([r["rows"] for r in cells], np.int64)

    @staticmethod
    def build(rows: DataFrame, key: str, vector: str, path: str, filters: list[str] | None = None, dims: int | None = None, cells: int | None = None) -> VectorIndex:
        """Index ``rows``, one a key; ``filters`` are columns that searches may restrict. The number of cells grows with
        the square root of the rows."""
        spark, filters = rows.sparkSession, filters or []
        dims = dims or (rows.where(F.col(vector).isNotNull()).select(F.size(vector)).first() or [1])[0]
        finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
        given = rows.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("vector"), *filters).where((F.size("vector") == dims) & finite & F.exists("vector", lambda x: x != 0))
        n = given.count()
        k = min(n, cells or min(MAX_CELLS, int(np.ceil(np.sqrt(n))) if n else 0))
        if k > 1:
            sample = given.select(array_to_vector(unit(F.col("vector"))).alias("features")).sample(min(1.0, FIT_PER_CELL * k / n), seed=5)
            model = KMeans(k=k, distanceMeasure="cosine", initMode="random", maxIter=10, seed=5).fit(sample)
            centres = _unit_rows(pd.Series(model.clusterCenters()))
        else:
            centres = np.ones((1, dims)) / np.sqrt(dims)
        known = spark.sparkContext.broadcast(centres)

        def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = _unit_rows(batch.column("vector"))
                scale = np.abs(x).max(axis=1)
                codes = np.rint(x / scale[:, None] * 127).astype(np.int8)
                added = [pa.array((x @ known.value.T).argmax(axis=1).astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array((scale / 127).astype(np.float32))]
                yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*batch.schema.names, "cell", "code", "scale"])

        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema.fields)
        placed = given.mapInArrow(encode, f"{kinds}, cell int, code binary, scale float")
        # A cell is as many blocks as its share of the rows needs at least; blocks follow a hash of the key.
        block = F.pmod(F.xxhash64("key"), F.lit(max(1, n // (len(centres) * BLOCK) + 1))).cast("int")
        placed.withColumn("block", block).repartition("cell", "block").sortWithinPartitions("cell", "block", "key").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/rows")
        counts = {r["cell"]: r["count"] for r in spark.read.parquet(f"{path}/rows").groupBy("cell").count().collect()} if n else {}
        table = [(c, centre.tolist(), counts.get(c, 0)) for c, centre in enumerate(centres)]
        spark.createDataFrame(table, "cell int, centre array<double>, rows long").coalesce(1).write.mode("overwrite").parquet(f"{path}/cells")
        return VectorIndex(spark, path)

    def _rows(self, where: Column | None) -> DataFrame:
        if not self.sizes.sum():
            return self.spark.createDataFrame([], "key long, vector array<double>, cell int, code binary, scale float, block int")
        rows = self.spark.read.parquet(f"{self.path}/rows")
        return rows if where is None else rows.where(where)

    def cells_for(self, where: Column | None) -> np.ndarray:
        """How many rows of each cell pass a filter; without one that is known, with one only its columns are read."""
        if where is None or not self.sizes.sum():
            return self.sizes
        out = np.zeros_like(self.sizes)
        for r in self._rows(where).groupBy("cell").count().collect():
            out[r["cell"]] = r["count"]
        return out

    def cells_of(self, query: list[float], k: int, where: Column | None = None, probes: int = PROBES) -> tuple[list[int], float]:
        """The cells that a search reads, and their share of the rows that pass its filter."""
        rows = self.cells_for(where)
        cells = nearest_cells(_unit_rows(pd.Series([query])), self.centres, rows, k, probes)[0]
        return cells, float(rows[cells].sum() / max(1, rows.sum()))

    def search(self, query: list[float], k: int, where: Column | None = None, probes: int = PROBES, refine: int = REFINE) -> DataFrame:
        """(key, similarity, distance) of about the ``k`` nearest rows that pass the filter, ties by key. Similarities are
        exact; there are ``k`` rows wherever as many pass."""
        if len(query) != self.centres.shape[1] or not any(query):
            return self._rows(F.lit(False)).select("key", F.lit(0.0).alias("similarity"), F.lit(1.0).alias("distance"))
        cells, _ = self.cells_of(query, k, where, probes)
        q = _unit_rows(pd.Series([query]))[0]

        @F.pandas_udf("double")
        def estimate(code: pd.Series, scale: pd.Series) -> pd.Series:
            return pd.Series(_codes(pa.array(code, pa.binary())) @ q * scale.to_numpy())

        rows = self._rows(where).where(F.col("cell").isin(cells))
        best = rows.select("key", "cell", estimate("code", "scale").alias("estimate")).orderBy(F.desc("estimate"), "key").limit(k * refine).select("key", "cell")
        exact = rows.select("key", "cell", "vector").join(F.broadcast(best), ["cell", "key"])  # k * refine rows
        exact = exact.select("key", cosine_similarity(F.col("vector"), F.array(*[F.lit(float(x)) for x in query])).alias("similarity")).withColumn("distance", 1 - F.col("similarity"))
        return exact.orderBy("distance", "key").limit(k)

    def search_many(self, queries: DataFrame, k: int, where: Column | None = None, probes: int = PROBES, refine: int = REFINE) -> DataFrame:
        """(query_id, rank, key, similarity) for queries (query_id, vector), as ``search``. Cells, blocks of them and
        blocks of queries are cogrouped, so that a task holds one of each."""
        sizes, centres = self.cells_for(where), self.spark.sparkContext.broadcast(self.centres)

        @F.pandas_udf("array<int>")
        def cells_for(vector: pd.Series) -> pd.Series:
            return pd.Series(nearest_cells(_unit_rows(vector), centres.value, sizes, k, probes))

        asked = queries.select("query_id", F.col("vector").cast("array<double>").alias("vector")).where((F.size("vector") == self.centres.shape[1]) & F.exists("vector", lambda x: x != 0))
        rows = self._rows(where)
        chunks = max(1, -(-asked.count() // QUERIES))
        blocks = int((rows.agg(F.max("block")).first()[0] or 0)) + 1
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        ask = asked.select("query_id", "vector", F.explode(cells_for("vector")).alias("cell"), F.pmod(F.xxhash64("query_id"), F.lit(chunks)).cast("int").alias("chunk")).select("*", every(blocks).alias("block"))
        answer = rows.select("key", "cell", "block", "code", "scale", every(chunks).alias("chunk"))
        id_kind, key_kind = asked.schema["query_id"].dataType.simpleString(), rows.schema["key"].dataType.simpleString()

        def best(left: pa.Table, right: pa.Table) -> pa.Table:
            if not left.num_rows or not right.num_rows:
                return pa.table({"query_id": left["query_id"].slice(0, 0), "cell": pa.array([], pa.int32()), "key": right["key"].slice(0, 0), "estimate": pa.array([], pa.float64())})
            q, codes = _unit_rows(left["vector"].combine_chunks()), _codes(right["code"]).astype(np.float64)
            scores = q @ (codes * right["scale"].to_numpy()[:, None]).T
            take = min(k * refine, scores.shape[1])
            at = np.argpartition(-scores, take - 1, axis=1)[:, :take]
            who = pa.array(np.repeat(np.arange(len(q)), take))
            return pa.table({"query_id": left["query_id"].take(who), "cell": left["cell"].take(who), "key": right["key"].take(pa.array(at.ravel())), "estimate": np.take_along_axis(scores, at, axis=1).ravel()})

        keys = ["cell", "block", "chunk"]
        found = ask.groupBy(*keys).cogroup(answer.groupBy(*keys)).applyInArrow(best, f"query_id {id_kind}, cell int, key {key_kind}, estimate double")
        some = found.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("estimate"), "key"))).where(F.col("place") <= k * refine)
        vectors = self._rows(where).select(F.col("key").alias("key"), F.col("cell").alias("cell"), F.col("vector").alias("own"))
        exact = some.select("query_id", "cell", "key").join(vectors, ["cell", "key"]).join(asked, "query_id")
        exact = exact.select("query_id", "key", cosine_similarity(F.col("own"), F.col("vector")).alias("similarity"))
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(1 - F.col("similarity"), "key"))
        return exact.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "key", "similarity")
