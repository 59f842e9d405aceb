"""Weighted means, exact nearest neighbours and reranking over vector columns."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cataloom.functions.vectors import cosine_similarity, is_zero, unit
from cataloom.operators.catalog import latest_by


def mean_vector(rows: DataFrame, vector: str, weight: Column, keys: list[str] | None = None, name: str = "mean_vector") -> DataFrame:
    """The weighted mean vector of each key (of all rows without keys), component by component."""
    keys = keys or []
    tall = rows.select(*keys, weight.cast("double").alias("__w"), F.posexplode(vector).alias("__pos", "__x"))
    sums = tall.groupBy(*keys, "__pos").agg((F.sum(F.col("__w") * F.col("__x").cast("double")) / F.sum("__w")).alias("__x"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("__pos", "__x"))), lambda e: e["__x"])
    return sums.groupBy(*keys).agg(listed.alias(name))


def nearest(rows: DataFrame, query: DataFrame, vector: str, key: str, k: int, query_vector: str = "mean_vector") -> DataFrame:
    """The ``k`` rows nearest to one query vector by cosine: similarity and distance, ties by key.

    Filters on ``rows`` apply first. The query is one row, so the cross join adds one vector to each row."""
    scored = rows.crossJoin(F.broadcast(query.select(query_vector).limit(1))).withColumn("similarity", cosine_similarity(F.col(vector), F.col(query_vector)))
    scored = scored.drop(query_vector).where("similarity is not null").withColumn("distance", 1 - F.col("similarity"))
    return scored.orderBy("distance", key).limit(k)


def similar_to(rows: DataFrame, item, vector: str, key: str, k: int = 10, exclude_self: bool = True) -> DataFrame:
    """The nearest rows of one item; none if it has no vector."""
    own = rows.where(F.col(key) == F.lit(item)).select(F.col(vector).alias("mean_vector"))
    others = rows.where(F.col(key) != F.lit(item)) if exclude_self else rows
    return nearest(others, own, vector, key, k)


def best_in_group(left: DataFrame, right: DataFrame, on: str, query: DataFrame, vector: str, key: str, query_vector: str = "mean_vector") -> DataFrame:
    """For each left row the row of ``right`` with the same ``on`` nearest to the query vector."""
    scored = right.crossJoin(F.broadcast(query.select(query_vector).limit(1))).withColumn("distance", 1 - cosine_similarity(F.col(vector), F.col(query_vector))).where("distance is not null")
    best = scored.groupBy(on).agg(F.min_by(F.struct(key, "distance"), F.struct("distance", key)).alias("__best")).select(on, F.col("__best")[key].alias(key), F.col("__best.distance").alias("distance"))
    return left.join(best, on)


def neighbour_graph(rows: DataFrame, vector: str, key: str, group: str, k: int, block: int = 2048) -> DataFrame:
    """The ``k`` nearest neighbours of every vector inside its group, exactly, ties by key.

    A group is cut into blocks and every pair of blocks is one matrix product; of it each row keeps its ``k`` best, so
    pairs of rows are never rows of a table. Zero vectors have no neighbours. Vectors of a group have one length."""
    unit_rows = rows.select(F.col(group).alias("g"), F.col(key).alias("k"), unit(F.col(vector)).alias("v")).where("v is not null and g is not null")
    sizes = unit_rows.groupBy("g").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    placed = unit_rows.join(sizes, "g").withColumn("own", F.pmod(F.xxhash64("k"), F.col("blocks")).cast("int"))
    # Each row goes once to every block as one that asks, and once to its own block as one that answers.
    asks = placed.select("g", "k", "v", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"), "own", F.lit(True).alias("asks"))
    answers = placed.select("g", "k", "v", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("asking"), F.col("own").alias("other"), F.lit(False).alias("asks"))
    both = asks.select("g", F.col("own").alias("asking"), "other", "k", "v", "asks").unionByName(answers)

    def best(part: pd.DataFrame) -> pd.DataFrame:
        left, right = part[part["asks"]], part[~part["asks"]].sort_values("k")
        if left.empty or right.empty:
            return pd.DataFrame({"src": [], "dst": [], "similarity": []})
        a, b, names = np.stack(left["v"].to_numpy()), np.stack(right["v"].to_numpy()), right["k"].to_numpy()
        out = []
        for start in range(0, len(a), 512):
            dots = a[start : start + 512] @ b.T
            own = left["k"].to_numpy()[start : start + 512]
            dots[own[:, None] == names[None]] = -np.inf
            order = np.argsort(-dots, axis=1, kind="stable")[:, :k]
            row = np.repeat(np.arange(len(own)), order.shape[1])
            out.append(pd.DataFrame({"src": own[row], "dst": names[order.ravel()], "similarity": dots[row, order.ravel()]}))
        found = pd.concat(out)
        return found[np.isfinite(found["similarity"])]

    kind = rows.schema[key].dataType.simpleString()
    some = both.groupBy("g", "asking", "other").applyInPandas(best, f"src {kind}, dst {kind}, similarity double")
    order = Window.partitionBy("src").orderBy(F.desc("similarity"), "dst")
    return some.withColumn("neighbour", F.row_number().over(order)).where(F.col("neighbour") <= k)


def rerank(candidates: DataFrame, scores: DataFrame, key: str, k: int) -> DataFrame:
    """Candidates of a vector search by another score, with their rank and similarity of the search attached."""
    order = Window.orderBy("distance", key)
    ranked = candidates.withColumn("similarity_rank", F.row_number().over(order) - 1)
    return ranked.select(key, "similarity_rank", "similarity").join(scores, key).orderBy(F.desc("score"), key).limit(k)


def candidates_to_rerank(count: int, least: int = 50) -> int:
    return max(2 * count, least)


def without_zero_vectors(rows: DataFrame, vector: str) -> DataFrame:
    return rows.where(~is_zero(F.col(vector)))


def cache_key(provider: Column, body: Column) -> Column:
    return F.concat(F.lit("embedding_cache:"), provider, F.lit(":"), F.sha2(body, 256))


# Fixed value: days for which a vector made for a text is used again.
CACHE_DAYS = 14


def uncached(bodies: DataFrame, cache: DataFrame, now: Column, key: str = "cache_key", made_at: str = "made_at") -> DataFrame:
    """Bodies to make vectors for: those whose cache key has no entry, or only entries that are too old."""
    fresh = cache.where(F.col(made_at) + F.make_dt_interval(F.lit(CACHE_DAYS)) > now).select(key)
    return bodies.join(fresh, key, "left_anti")


def embedding_body(parts: list[Column]) -> Column:
    """Fields and tags as one text; tags of an array in order."""
    return F.concat_ws(", ", *parts)


def put_embeddings(stored: DataFrame, uploaded: DataFrame, keys: list[str], vector: str, order: list[Column]) -> tuple[DataFrame, DataFrame]:
    """(embeddings, received): a bulk upload by item and kind of vector. The last of several uploads of a key is taken;
    vectors of zeros are received and not stored. ``received`` counts what came and what was stored."""
    good = latest_by(without_zero_vectors(uploaded, vector), keys, order).select(stored.columns)
    kept = stored.join(good.select(*keys), keys, "left_anti").select(stored.columns).unionByName(good)
    return kept, uploaded.agg(F.count("*").alias("received"), F.count_if(~is_zero(F.col(vector))).alias("not_zero"))


def delete_embeddings(stored: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """Embeddings without those of some keys (an item, or an item and a kind)."""
    return stored.join(gone.select(*keys).distinct(), keys, "left_anti").select(stored.columns)
