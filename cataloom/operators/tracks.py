"""Tracks by audio features: rows with a vector of nine features, their filters, pages and nearest neighbours."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cataloom.operators import search, vector_search

#: The features in the order of the vector. They aren't scaled, so loudness and tempo weigh most.
FEATURES = ["acousticness", "danceability", "energy", "instrumentalness", "liveness", "loudness", "speechiness", "tempo", "valence"]
PAGE = 100_000


def feature_vector(features: Column) -> Column:
    """The vector of a struct of features; null if one is missing."""
    values = [features[name].cast("float") for name in FEATURES]
    return F.when(search.all_of([v.isNotNull() for v in values]), F.array(*values))


@dataclass
class TrackFilter:
    """Any of the tracks and any of the albums, both if both are given; each a list, or a table of keys of any size."""

    tracks: list | DataFrame | None = None
    albums: list | DataFrame | None = None

    def apply(self, rows: DataFrame, track: str, album: str) -> DataFrame:
        for column, wanted in ((track, self.tracks), (album, self.albums)):
            if isinstance(wanted, DataFrame):
                rows = rows.join(wanted.select(F.col(wanted.columns[0]).alias(column)).distinct(), column, "left_semi").select(rows.columns)
            elif wanted:
                rows = rows.where(F.col(column).isin(wanted))
        return rows


def find_tracks(rows: DataFrame, wanted: TrackFilter, track: str = "spotify_id", album: str = "album_file_name", offset: int = 0, limit: int = PAGE) -> DataFrame:
    """A page of the tracks that pass the filter, by id, each with how many there are in all."""
    found = wanted.apply(rows, track, album)
    total = found.agg(F.count("*").alias("total"))
    return search.page(found, [F.col(track)], offset, limit).crossJoin(F.broadcast(total))  # one row


def similar_tracks(rows: DataFrame, wanted: TrackFilter, query: DataFrame, k: int, track: str = "spotify_id", album: str = "album_file_name", vector: str = "embedding") -> DataFrame:
    """The ``k`` tracks nearest to the one vector of ``query`` by cosine, exactly, among those that pass the filter."""
    asked = query.select(F.col(query.columns[0]).alias("__query"))
    return vector_search.nearest(wanted.apply(rows, track, album), asked, vector, track, k, query_vector="__query")
