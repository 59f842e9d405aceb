"""The catalogue: hydration to nested rows, upserts, set operations by key, roll-ups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def nested(child: DataFrame, key: str, fields: list[str], name: str, order: list[str] | None = None) -> DataFrame:
    """One row a parent with its children as an array of structs, without repeats, in a fixed order."""
    fields_struct = F.struct(*fields)
    listed = F.array_sort(F.collect_set(fields_struct)) if order is None else F.transform(F.array_sort(F.collect_set(F.struct(*order, fields_struct.alias("__row")))), lambda x: x["__row"])
    return child.groupBy(key).agg(listed.alias(name))


def hydrate(parents: DataFrame, key: str, children: dict[str, DataFrame]) -> DataFrame:
    """Parents with each nested child table joined on ``key``; a parent without children has an empty array.

    Every child is aggregated to one row a key first, so each join is one to one on the same key."""
    out = parents
    for name, child in children.items():
        out = out.join(child.select(key, name), key, "left")
        out = out.withColumn(name, F.coalesce(F.col(name), F.array().cast(child.schema[name].dataType)))
    return out


def in_key_order(rows: DataFrame, keys: DataFrame, key: str, ordinal: str = "ordinal") -> DataFrame:
    """The rows of asked keys with the first ordinal of each; keys that have no row are left out."""
    wanted = keys.groupBy(key).agg(F.min(ordinal).alias(ordinal))
    return rows.join(wanted, key)


def missing_keys(keys: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    return keys.select(key).distinct().join(rows.select(key), key, "left_anti")


def exists_flags(keys: DataFrame, rows: DataFrame, key: str, name: str = "found") -> DataFrame:
    """Every key with whether a row exists."""
    found = rows.select(key).distinct().withColumn(name, F.lit(True))
    return keys.join(found, key, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def upsert(base: DataFrame, changes: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """``base`` with changed rows replaced and new ones added; of several changes of a key the last by ``order`` wins."""
    latest = latest_by(changes, [key], order).select(base.columns)
    return base.join(latest.select(key), key, "left_anti").select(base.columns).unionByName(latest)


def latest_by(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key by ``order``: one aggregate with partial results, no sort of whole groups."""
    everything = F.struct(*rows.columns)
    top = rows.groupBy(*keys).agg(F.max_by(everything, F.struct(*[c.alias(f"o{k}") for k, c in enumerate(order)])).alias("__row"))
    return top.select("__row.*")


def delete(base: DataFrame, tombstones: DataFrame, key: str) -> DataFrame:
    return base.join(tombstones.select(key), key, "left_anti")


def dictionary(rows: DataFrame, columns: list[Column], name: str = "name") -> DataFrame:
    """The distinct values of several array columns."""
    return rows.select(F.explode(F.flatten(F.array(*columns))).alias(name)).where(F.col(name).isNotNull()).distinct()


def distinct_union(frames: list[DataFrame], column: str) -> DataFrame:
    return reduce(lambda a, b: a.union(b), [f.select(column) for f in frames]).distinct()


def union_by_key(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Both inputs by key; where both have a key the second wins."""
    return first.join(second.select(key), key, "left_anti").unionByName(second.dropDuplicates([key]))


def tag_rollup(tags: DataFrame, name: str, is_primary: str) -> DataFrame:
    """Primary, secondary and total occurrences of each tag."""
    primary = F.sum(F.when(F.col(is_primary), 1).otherwise(0)).cast("long")
    return tags.groupBy(name).agg(primary.alias("primary_count"), (F.count("*") - primary).alias("secondary_count"), F.count("*").alias("total_count"))


def counted(rows: DataFrame, name: str, limit: int | None = None) -> DataFrame:
    """Occurrences of each value, most frequent first (ties by value); all of them unless a limit is asked for."""
    out = rows.where(F.col(name).isNotNull()).groupBy(name).agg(F.count("*").alias("n")).orderBy(F.desc("n"), name)
    return out if limit is None else out.limit(limit)


def credited_not_main(credits: DataFrame, main: DataFrame, artist: str, album: str, role: str) -> DataFrame:
    """(artist, album, role) once each, for albums of which the artist is not a main artist."""
    return credits.select(artist, album, role).distinct().join(main.select(artist, album).distinct(), [artist, album], "left_anti")


def related_artists(albums: DataFrame, main: str, credited: str) -> DataFrame:
    """The distinct artists, main or credited, of some albums."""
    return albums.select(F.explode(F.array_union(main, credited)).alias("artist")).distinct()


def replace_children(stored: DataFrame, saved: DataFrame, key: str) -> DataFrame:
    """Child rows after an export: those of saved parents are replaced as a set, the others stay."""
    return stored.join(saved.select(key).distinct(), key, "left_anti").select(stored.columns).unionByName(saved.select(stored.columns).distinct())


def add_segments(stored: DataFrame, seen: DataFrame) -> DataFrame:
    """Children of list segments are only ever added."""
    return stored.unionByName(seen.select(stored.columns)).distinct()


def top_per_key(rows: DataFrame, keys: list[str], order: list[Column], k: int = 1, rank: str | None = None) -> DataFrame:
    """The first ``k`` rows of each key, with their ``rank`` if it has a name. Spark keeps ``k`` rows a key before the
    shuffle (window group limit)."""
    window = Window.partitionBy(*keys).orderBy(*order)
    name = rank or "__rank"
    out = rows.withColumn(name, F.row_number().over(window)).where(F.col(name) <= k)
    return out if rank else out.drop(name)
