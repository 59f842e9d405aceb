"""Profiles: weighted sets of items, as rows (profile, item, factor) or as one map a profile."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cataloom.operators.catalog import latest_by


def put_items(profiles: DataFrame, changes: DataFrame, profile: str, item: str, order: str) -> DataFrame:
    """Profiles after changes (profile, item, factor, order): the last change of an item sets its factor."""
    last = latest_by(changes, [profile, item], [F.col(order)]).select(profiles.columns)
    return profiles.join(last.select(profile, item), [profile, item], "left_anti").select(profiles.columns).unionByName(last)


def remove_items(profiles: DataFrame, gone: DataFrame, profile: str, item: str) -> DataFrame:
    return profiles.join(gone.select(profile, item), [profile, item], "left_anti").select(profiles.columns)


def as_maps(profiles: DataFrame, profile: str, item: str, factor: str) -> DataFrame:
    """One map from item to factor for each profile."""
    rows = profiles.groupBy(profile, item).agg(F.sum(factor).alias(factor))
    return rows.groupBy(profile).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(item, factor)))).alias("items"))


def from_maps(maps: DataFrame, profile: str, item: str, factor: str) -> DataFrame:
    return maps.select(profile, F.explode("items").alias(item, factor))


def on_originals(profiles: DataFrame, duplicates: DataFrame, item: str, factor: str) -> DataFrame:
    """Profiles with duplicates replaced by their originals; factors of the same original add up."""
    known = duplicates.select(F.col("duplicate").alias(item), "original")
    moved = profiles.join(known, item, "left").withColumn(item, F.coalesce("original", item)).drop("original")
    return moved.groupBy(*[c for c in profiles.columns if c != factor]).agg(F.sum(factor).cast("long").alias(factor))


def with_overviews(hits: DataFrame, artists: DataFrame, overviews: DataFrame, key: str, rank: str) -> DataFrame:
    """Search hits with artist and overview in the order of the hits; a hit without both is left out."""
    return hits.join(artists, key).join(overviews, key).orderBy(rank)


def backfill_keys(events: DataFrame, keys: DataFrame, sequence: str, topic: str, key: str) -> DataFrame:
    """Events after keys (sequence, new key) are set; an event whose new key an event of its topic has already is left out."""
    changed = events.join(keys.select(sequence, F.col(key).alias("__new")), sequence, "left")
    taken = events.where(F.col(key).isNotNull()).select(topic, F.col(key).alias("__new")).distinct().withColumn("__taken", F.lit(True))
    out = changed.join(taken, [topic, "__new"], "left").where(F.col("__new").isNull() | F.col("__taken").isNull())
    return out.withColumn(key, F.coalesce("__new", key)).select(events.columns)
