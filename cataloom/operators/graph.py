"""A property graph from the catalogue, and node embeddings by fast random projection (FastRP, Chen et al. 2019)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cataloom.sources.storage import written

# Weights of the undirected projection, by edge type.
EDGE_WEIGHTS = {"ALBUM_ARTIST": 4.0, "CREDITED": 2.0, "DESCRIPTOR": 1.0, "LANGUAGE": 1.0, "PRIMARY": 3.0, "SECONDARY": 1.0}
#: Edges that a task keeps at once, and blocks of nodes to each of which a neighbour's vector goes at most once.
EDGES, BLOCKS = 400_000, 64


def nodes(parts: list[tuple[str, DataFrame, str, str]]) -> DataFrame:
    """(id, label, name) from (label, rows, key, name): one node a key, with the least of its names."""
    frames = [rows.select(F.concat(F.lit(f"{label}:"), F.col(key).cast("string")).alias("id"), F.lit(label).alias("label"), F.col(name).cast("string").alias("name")) for label, rows, key, name in parts]
    return reduce(lambda a, b: a.union(b), frames).groupBy("id", "label").agg(F.min("name").alias("name"))


def edges(parts: list[tuple[str, DataFrame, Column, Column]]) -> DataFrame:
    """(src, dst, type, weight) without repeats. The rows are counted first, so that a task keeps as many whatever the size."""
    frames = [rows.select(src.alias("src"), dst.alias("dst"), F.lit(kind).alias("type"), F.lit(EDGE_WEIGHTS[kind]).alias("weight")) for kind, rows, src, dst in parts]
    found = reduce(lambda a, b: a.union(b), frames)
    return found.repartition(tasks(found), "src", "dst").distinct()


def tasks(edges: DataFrame) -> int:
    """How many partitions hold the edges with ``EDGES`` in each."""
    return edges.count() // EDGES + 1


def edge_lists(edges: DataFrame) -> DataFrame:
    """(src, edges): the edges of each source in order."""
    return edges.groupBy("src").agg(F.sort_array(F.collect_set(F.struct("dst", "type", "weight"))).alias("edges"))


def undirected(directed: DataFrame) -> DataFrame:
    """Each edge in both directions; parallel edges add up. The edges of a source end in one partition."""
    directed = written(directed, "directed")
    both = directed.select("src", "dst", "weight").union(directed.select("dst", "src", "weight"))
    return both.repartition(tasks(both), "src").groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def random_projection(id_: Column, dims: int, seed: int) -> Column:
    """A sparse random vector of a node: +sqrt(3), 0 or -sqrt(3) with chances 1/6, 2/3, 1/6, by hash of node and place."""

    def component(k: Column) -> Column:
        u = F.pmod(F.xxhash64(id_, k, F.lit(seed)), F.lit(6))
        return F.when(u == 0, 3**0.5).when(u == 1, -(3**0.5)).otherwise(0.0)

    return F.array(*[component(F.lit(k)) for k in range(dims)])


def scaled(v: str | Column, weight: float) -> Column:
    return F.transform(v, lambda x: x * weight)


def fast_rp(graph: DataFrame, dims: int = 64, weights: tuple[float, ...] = (0.0, 1.0, 1.0), seed: int = 42, wanted: Column | None = None) -> DataFrame:
    """(id, embedding): the weighted sum of L2-normalised neighbour means of 1, 2, ... steps from a random projection; with
    ``wanted``, a condition on ``id``, of those nodes alone.

    ``graph`` is undirected (src, dst, weight). The random vector of a neighbour follows from its id, so the first round
    joins nothing. In later rounds sources are dealt to blocks, a vector is sent once to each block that has an edge to its
    node, and a block adds up what its sources meet: no vector is shuffled for an edge."""
    graph = written(graph, "graph")
    wanted = F.lit(True) if wanted is None else wanted
    total = graph.select(F.col("src").alias("id")).where(wanted).distinct()
    total = total.withColumn("e", scaled(random_projection(F.col("id"), dims, seed), weights[0]))
    current = None
    for step, weight in enumerate(weights[1:], 2):
        last = step == len(weights)
        rows = graph.withColumnRenamed("src", "id").where(wanted if last else F.lit(True))
        rows = rows.withColumn("block", F.pmod(F.hash("id"), F.lit(BLOCKS)))
        if current is None:
            met = rows.withColumn("v", random_projection(F.col("dst"), dims, seed))
        else:
            sent = rows.select("block", "dst").distinct().join(current.withColumnRenamed("id", "dst"), "dst")
            met = rows.repartitionById(BLOCKS, "block").join(sent.repartitionById(BLOCKS, "block"), ["block", "dst"])
        # A mean's length falls out when it is normalised, so sums do.
        sums = met.groupBy("block", "id").agg(*[F.sum(F.col("weight") * F.col("v")[k]).alias(f"v{k}") for k in range(dims)])
        moved = sums.select("id", F.array(*[f"v{k}" for k in range(dims)]).alias("v"))
        length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
        current = moved.withColumn("length", length).select("id", F.when(F.col("length") > 0, F.transform("v", lambda x: x / F.col("length"))).otherwise(F.col("v")).alias("v"))
        current = current if last else written(current, "vectors")
        total = total.join(current, "id").select("id", F.zip_with("e", scaled("v", weight), lambda a, b: a + b).alias("e"))
    return total.withColumnRenamed("e", "embedding")
