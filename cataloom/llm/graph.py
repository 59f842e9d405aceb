"""Joins with hot keys, connected components by repeated joins, and gapless numbering, for groups of any size."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cataloom.llm.storage import discard, stored

#: A key is hot if it has more than one in so many of the rows; so there are fewer hot keys than this.
HOT_SHARE = 10_000


def lookup(rows: DataFrame, found: DataFrame, keys: list[str], weight: str, total: int | Column, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``found``, which has one row a key and in ``weight`` how many of ``rows`` have it.

    Keys with more than 1/``HOT_SHARE`` of the ``total`` rows number fewer than ``HOT_SHARE``, so they are broadcast and
    their rows stay where they are; the other rows are joined by shuffle, where no key is hot. ``how`` is inner or left;
    keys compare null-safely, so a null in a key is a value like another. ``weight`` is dropped."""
    is_hot = F.col(weight) * HOT_SHARE > F.lit(total)
    given = found.select(*[F.col(k).alias(f"__{k}") for k in keys], *[c for c in found.columns if c not in keys])
    same = reduce(lambda a, b: a & b, [rows[k].eqNullSafe(given[f"__{k}"]) for k in keys])
    hot = given.where(is_hot)
    names = [f"__{k}" for k in keys]
    warm = rows.join(F.broadcast(hot), same, "inner").drop(*names, weight)
    cold = rows.join(F.broadcast(hot.select(*names)), same, "left_anti").join(given.where(~is_hot), same, how).drop(*names, weight)
    return warm.unionByName(cold)


def components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node that can be reached over ``edges`` (undirected), for nodes that have an edge.

    Alternating large-star and small-star rounds (Kiveris et al., 2014): each round points neighbours at the least
    node known so far and stops when no edge changes. A round is two aggregations and two joins; the least neighbour is
    a partial aggregate and hubs are joined by ``lookup``, so a hub loads no single task. Self-loops and null ends are
    ignored.
    """
    pairs = edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).where(F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col("u") != F.col("v")))
    pairs = stored(pairs.distinct(), "edges")
    size = F.count("*").alias("size"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("check")
    signature = tuple(pairs.agg(*size).first())
    for _ in range(max_rounds):
        both = pairs.select("u", "v").union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.sum((F.col("v") > F.col("u")).cast("int")).alias("w")).where("w > 0")
        large = lookup(both.where("v > u"), least, ["u"], "w", signature[0]).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stored(large.where("u != v").distinct(), "edges")
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("w"))
        small = lookup(large, least, ["u"], "w", large.count()).select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        after = stored(small.where("u > v").distinct(), "edges")
        discard(pairs, large)
        pairs, before, signature = after, signature, tuple(after.agg(*size).first())
        if before == signature:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = pairs.select(F.col("v").alias("node")).distinct()
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots.select("node", F.col("node").alias("component")))


def numbered(df: DataFrame, keys: list[str], order: list[Column], name: str, buckets: int = 64) -> DataFrame:
    """``df`` with ``name``: 0, 1, 2, ... without gaps inside each combination of ``keys``.

    Rows are numbered inside ``buckets`` buckets of a key, by a hash of the first column of ``order``, and each bucket
    starts where the earlier ones end, so no window holds a whole key. Rows that agree in that column stay side by side.
    ``order`` fixes the order inside a bucket; buckets follow their number.
    """
    df = df.withColumn("__bucket", F.pmod(F.xxhash64(order[0]), F.lit(buckets)).cast("int"))
    counts = df.groupBy(*keys, "__bucket").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*keys, "__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    inside = Window.partitionBy(*keys, "__bucket").orderBy(*order)
    out = df.withColumn("__rank", F.row_number().over(inside)).join(starts, [*keys, "__bucket"])
    return out.withColumn(name, (F.col("__start") + F.col("__rank") - 1).cast("long")).drop("__bucket", "__start", "__rank")
