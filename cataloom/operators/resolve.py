"""Entity resolution: duplicates by folded name and shared artist, and the best fuzzy match."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cataloom.functions.scalars import ascii_fold
from cataloom.functions.similarity import jaro_winkler_similarity
from cataloom.operators.catalog import top_per_key


def folded(name: Column) -> Column:
    return F.lower(ascii_fold(name))


def duplicates(rows: DataFrame, key: str, name: str, blocking: str, weight: str) -> DataFrame:
    """(duplicate, original) for rows that share a blocking value and a folded name with a row of more weight.

    A group is (blocking value, folded name); its original is the row of most weight, ties by key. A row in several
    groups takes the least of its originals. One aggregate a group and a join back: no pairs."""
    digest = F.unhex(F.sha2(folded(F.col(name)), 256))  # names may be whole texts
    keyed = rows.select(F.col(key).alias("key"), F.col(weight).alias("weight"), F.col(blocking).alias("block"), digest.alias("folded")).where("folded is not null and block is not null")
    best = keyed.groupBy("block", "folded").agg(F.max_by("key", F.struct("weight", F.negative("key") if dict(keyed.dtypes)["key"] != "string" else F.col("key"))).alias("original"), F.count("*").alias("n")).where("n > 1")
    return keyed.join(best, ["block", "folded"]).where("key != original").groupBy(F.col("key").alias("duplicate")).agg(F.min("original").alias("original"))


def duplicate_lists(links: DataFrame) -> DataFrame:
    """The duplicates of each original, in order."""
    return links.groupBy("original").agg(F.sort_array(F.collect_set("duplicate")).alias("duplicates"))


def best_match(queries: DataFrame, rows: DataFrame, query: str, name: str, key: str, block: str, least: float = 0.8) -> DataFrame:
    """For each query the most similar name (Jaro-Winkler of folded names, at least ``least``) in the same block, ties by
    key. Names that fold alike are one, and each pair of distinct folded strings is scored once, whatever the blocks."""
    left = queries.select(query, block, folded(F.col(query)).alias("__q"))
    right = rows.select(F.col(block), F.col(key), F.col(name), folded(F.col(name)).alias("__n"))
    right = right.groupBy(block, "__n").agg(F.min_by(F.struct(name, key), key).alias("__row"))
    met = left.join(right, block)
    scores = met.select("__q", "__n").distinct().withColumn("similarity", jaro_winkler_similarity("__q", "__n")).where(F.col("similarity") >= least)
    scored = met.join(scores, ["__q", "__n"])
    best = scored.groupBy(query, block).agg(F.max_by(F.struct("__row", "similarity"), F.struct("similarity", F.negative(f"__row.{key}"))).alias("m"))
    return best.select(query, block, F.col("m.__row")[name].alias(name), F.col("m.__row")[key].alias(key), "m.similarity")


def match_candidates(queries: DataFrame, rows: DataFrame, query: str, name: str, key: str, block: str, kind: str, least: float = 0.8, k: int = 5, skip: str = "single") -> DataFrame:
    """The ``k`` best candidates of each query, ranked from 1; rows of kind ``skip`` are no candidates."""
    left = queries.select(query, block, folded(F.col(query)).alias("__q"))
    right = rows.where(~F.col(kind).eqNullSafe(F.lit(skip))).select(F.col(block), F.col(key), F.col(name), folded(F.col(name)).alias("__n"))
    met = left.join(right, block)
    scores = met.select("__q", "__n").distinct().withColumn("similarity", jaro_winkler_similarity("__q", "__n")).where(F.col("similarity") >= least)
    ranked = top_per_key(met.join(scores, ["__q", "__n"]), [query, block], [F.desc("similarity"), F.col(key)], k, "candidate")
    return ranked.select(query, block, "candidate", key, name, "similarity")
