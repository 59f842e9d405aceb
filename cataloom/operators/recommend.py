"""Recommendations: candidates, the three methods, and playlist drafts."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cataloom.operators import ranking, search, summary, vector_search
from cataloom.sources.storage import written


@dataclass
class Request:
    """How many (0 means 10), whether artists of the seed are left out, and further restrictions."""

    count: int = 10
    exclude_known_artists: bool = True
    least_tags: dict[str, int] = field(default_factory=lambda: {"primary": 1, "secondary": 1, "descriptor": 5})
    search: search.CatalogueSearch = field(default_factory=search.CatalogueSearch)

    @property
    def k(self) -> int:
        return self.count or 10


def effective_settings(settings: Column) -> Column:
    """(count, exclude_known_artists) of settings as they came, a struct of both: without settings 10 and true; with
    settings, a count that is 0 or unset is 10, and an unset flag is false."""
    count = F.coalesce(F.nullif(settings["count"], F.lit(0)), F.lit(10)).cast("int")
    flag = F.when(settings.isNull(), True).otherwise(F.coalesce(settings["exclude_known_artists"], F.lit(False)))
    return F.struct(count.alias("count"), flag.alias("exclude_known_artists"))


def request_of(settings: dict | None, **further) -> Request:
    """A request from settings by the rules of ``effective_settings``."""
    given = settings or {}
    flag = True if settings is None else bool(given.get("exclude_known_artists") or False)
    return Request(count=given.get("count") or 10, exclude_known_artists=flag, **further)


@dataclass
class Columns:
    """The columns of a nested catalogue."""

    key: str = "file_name"
    artists: str = "artists"
    tags: dict[str, str] = field(default_factory=lambda: {"primary": "primary_tags", "secondary": "secondary_tags", "descriptor": "descriptors", "credit": "credit_tags"})
    numbers: dict[str, str] = field(default_factory=lambda: {"rating": "rating", "rating_count": "rating_count", "descriptor_count": "descriptor_count"})


def seed_items(catalogue: DataFrame, seed: DataFrame, c: Columns) -> DataFrame:
    """Catalogue rows of the seed (key, factor); items that the catalogue does not have are skipped."""
    return catalogue.join(seed.groupBy(c.key).agg(F.sum("factor").alias("factor")), c.key)


def known_items(catalogue: DataFrame, seed: DataFrame, c: Columns) -> DataFrame:
    """``seed_items`` worked out once for all that reads them: as rows at hand where the seed is small (at most
    ``ranking.SEED_ROWS`` rows, which is checked), as a written table where it isn't."""
    items = seed_items(catalogue, seed, c).select(*dict.fromkeys([c.key, "factor", c.artists, *c.tags.values(), *c.numbers.values()]))
    some = items.limit(ranking.SEED_ROWS + 1).toArrow()
    return catalogue.sparkSession.createDataFrame(some) if some.num_rows <= ranking.SEED_ROWS else written(items, "seed-items")


def candidates(catalogue: DataFrame, seed: DataFrame, request: Request, c: Columns, predicate=None, items: DataFrame | None = None) -> DataFrame:
    """Rows that may be recommended: not in the seed, with enough tags, by the request's search, without the seed's
    artists if so asked. Anti joins, so seeds of any size work. ``items`` are the seed's rows of the catalogue, if they
    are at hand; then no more is asked of ``seed``."""
    seed = seed if items is None else items
    rows = catalogue.join(seed.select(c.key), c.key, "left_anti")
    rows = rows.where(search.all_of([F.size(c.tags[f]) >= n for f, n in request.least_tags.items() if f in c.tags]))
    if predicate is not None:
        rows = rows.where(predicate)
    if request.exclude_known_artists:
        known = (seed_items(catalogue, seed, c) if items is None else items).select(F.explode(c.artists).alias("__artist")).distinct()
        met = rows.select(c.key, F.explode(c.artists).alias("__artist")).join(known, "__artist", "left_semi").select(c.key).distinct()
        rows = rows.join(met, c.key, "left_anti")
    return rows


def quantile_scores(rows: DataFrame, catalogue: DataFrame, seed: DataFrame, settings: ranking.Settings, c: Columns, items: DataFrame | None = None) -> DataFrame:
    """Scores of ``rows`` against the seed's rows of the catalogue (``items``, if they are at hand)."""
    items = known_items(catalogue, seed, c) if items is None else items
    factors = summary.facet_factors(items, "factor", {f: F.col(column) for f, column in c.tags.items()})
    return ranking.assess(rows, c.key, c.tags, c.numbers, ranking.tag_ranks(factors), items, settings)


def recommend_by_quantile(catalogue: DataFrame, seed: DataFrame, settings: ranking.Settings, request: Request, c: Columns, predicate=None) -> DataFrame:
    items = known_items(catalogue, seed, c)
    rows = candidates(catalogue, seed, request, c, predicate, items)
    return ranking.top(quantile_scores(rows, catalogue, seed, settings, c, items), request.k, "score", c.key)


def recommend_by_embedding(vectors: DataFrame, vector: str, seed: DataFrame, key: str, k: int) -> DataFrame:
    """The rows nearest to the seed's weighted mean vector; a seed row without a factor counts once."""
    own = vectors.join(seed, key).withColumn("factor", F.coalesce("factor", F.lit(1)))
    mean = vector_search.mean_vector(own, vector, F.col("factor"))
    return vector_search.nearest(vectors.join(seed.select(key), key, "left_anti"), mean, vector, key, k)


def recommend_reranked(vectors: DataFrame, vector: str, scores_of, seed: DataFrame, key: str, k: int, least: int = 50) -> DataFrame:
    """Candidates by embedding, ordered by ``scores_of(candidates)`` (key, score). They are few by their number asked for,
    so they are taken once and given to both steps as rows at hand."""
    near = recommend_by_embedding(vectors, vector, seed, key, vector_search.candidates_to_rerank(k, least)).select(key, "similarity", "distance")
    near = vectors.sparkSession.createDataFrame(near.toArrow())
    return vector_search.rerank(near, scores_of(near), key, k)


def recommend(method: str, **arguments) -> DataFrame:
    """Dispatch by name: quantile, embedding or reranked."""
    return {"quantile": recommend_by_quantile, "embedding": recommend_by_embedding, "reranked": recommend_reranked}[method](**arguments)


def playlist_draft(recommended: DataFrame, tracks: DataFrame, seed: DataFrame, on: str, track_key: str, vector: str) -> DataFrame:
    """For each recommended album its track nearest to the mean track vector of the seed, weighted by album factor."""
    own = tracks.join(seed.select(on, "factor"), on)
    mean = vector_search.mean_vector(own, vector, F.col("factor"))
    return vector_search.best_in_group(recommended, tracks, on, mean, vector, track_key)


def seed_of_list(segments: DataFrame, root: str, c: Columns, albums: str = "albums", root_column: str = "root_file_name") -> DataFrame:
    """The items of a list's segments as a seed, each once."""
    return segments.where(F.col(root_column) == root).select(F.explode(albums).alias(c.key)).distinct().withColumn("factor", F.lit(1))


def recommend_for_list(segments: DataFrame, root: str, catalogue: DataFrame, vectors: DataFrame, vector: str, style: str, years: tuple[int, int] | None, c: Columns, year: str = "release_year", count: int = 5) -> DataFrame:
    """Recommendations from a list: ``safe`` by quantile scores, ``adventurous`` by embedding, within a range of years."""
    seed = seed_of_list(segments, root, c)
    in_years = F.lit(True) if years is None else F.col(year).between(*years)
    if style == "safe":
        request = Request(count=count, exclude_known_artists=False)
        return recommend_by_quantile(catalogue, seed, ranking.Settings(), request, c, in_years)
    if style == "adventurous":
        wanted = catalogue.where(in_years).select(c.key).unionByName(seed.select(c.key)).distinct()
        return recommend_by_embedding(vectors.join(wanted, c.key, "left_semi"), vector, seed, c.key, count)
    raise ValueError(f"unknown style {style}")
