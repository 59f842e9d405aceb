"""Summaries of weighted collections and of contributors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cataloom.functions.scalars import decade


def tagged(facets: dict[str, Column]) -> Column:
    """All values of several array columns as one array of (facet, item)."""

    def of(name: str, values: Column) -> Column:
        return F.transform(values, lambda v: F.struct(F.lit(name).alias("facet"), v.cast("string").alias("item")))

    return F.flatten(F.array(*[of(name, F.coalesce(values.cast("array<string>"), F.array().cast("array<string>"))) for name, values in facets.items()]))


def facet_factors(items: DataFrame, factor: str, facets: dict[str, Column]) -> DataFrame:
    """(facet, item, factor): the summed factor of every value of every facet (array columns, or scalars as one-element
    arrays). One pass: all facets are exploded together and aggregated once; every occurrence counts."""
    entries = tagged(facets)
    tall = items.select(F.col(factor).alias("__factor"), F.explode(entries).alias("e"))
    return tall.where("e.item is not null").groupBy(F.col("e.facet").alias("facet"), F.col("e.item").alias("item")).agg(F.sum("__factor").cast("long").alias("factor"))


def date_facets(date: Column) -> dict[str, Column]:
    """Year and decade of a date as facets."""
    return {"year": F.array(F.year(date)), "decade": F.array(decade(F.year(date)))}


def weighted_mean(value: Column, weight: Column) -> Column:
    """Null where there is no weight."""
    return F.try_divide(F.sum(value * weight), F.sum(F.when(value.isNotNull(), weight)).cast("double"))


def weighted_median_year(year: Column, factor: Column) -> Column:
    """The median of the years, each repeated ``factor`` times; 0 if there is none."""
    return F.coalesce(F.round(F.percentile(year, 0.5, factor)), F.lit(0)).cast("int")


def album_summary(rating: Column, rating_count: Column, date: Column) -> list[Column]:
    """Aggregates of a contributor's albums: number, rating mean weighted by count (0 without), years (0 without)."""
    return [
        F.count("*").alias("album_count"),
        F.coalesce(F.try_divide(F.sum(rating * rating_count), F.sum(rating_count).cast("double")), F.lit(0.0)).alias("rating"),
        F.coalesce(F.sum(rating_count), F.lit(0)).cast("long").alias("rating_count"),
        F.coalesce(F.min(F.year(date)), F.lit(0)).alias("min_year"), F.coalesce(F.max(F.year(date)), F.lit(0)).alias("max_year"),
    ]


def merged_factors(lists: list[DataFrame], item: str = "item", factor: str = "factor") -> DataFrame:
    out = lists[0]
    for more in lists[1:]:
        out = out.unionByName(more)
    return out.groupBy(item).agg(F.sum(factor).cast("long").alias(factor))


def import_factors(tracks: DataFrame, album: str, artist: str, album_type: str | None = None) -> DataFrame:
    """Tracks of each (album, first artist) in lower case; only of type album, tracks without an artist are left out."""
    rows = tracks if album_type is None else tracks.where(F.col(album_type) == "album")
    rows = rows.where(F.col(artist).isNotNull() & F.col(album).isNotNull())
    return rows.groupBy(F.lower(album).alias("album"), F.lower(artist).alias("artist")).agg(F.count("*").alias("factor"))


def completion(done: Column) -> Column:
    """Share of done rows in whole per cent; 0 for none."""
    return F.coalesce(F.round(100 * F.avg(done.cast("double"))), F.lit(0)).cast("int")
