"""Approximate neighbours: recall on queries that aren't in the index, filters, sizes and what is read; track search."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from cataloom.operators import tracks
from cataloom.operators.vector_index import VectorIndex, nearest_cells

N, DIMS, K = 12_000, 32, 10


@pytest.fixture(scope="module")
def data():
    """Vectors spread around 300 directions, and queries that follow the same law but aren't among them."""
    rng = np.random.default_rng(7)
    middles = rng.normal(size=(300, DIMS))
    draw = lambda n: (middles[rng.integers(300, size=n)] + 0.6 * rng.normal(size=(n, DIMS))).astype(np.float32)
    return draw(N), draw(150)


@pytest.fixture(scope="module")
def index(spark, data, tmp_path_factory):
    rows = [(k, x.tolist(), k % 5) for k, x in enumerate(data[0])] + [(N, None, 0), (N + 1, [0.0] * DIMS, 0), (N + 2, [1.0], 0), (N + 3, [float("nan")] * DIMS, 0)]
    frame = spark.createDataFrame(rows, "id long, v array<float>, kind int")
    return VectorIndex.build(frame, "id", "v", f"file://{tmp_path_factory.mktemp('vectors')}/i", ["kind"], dims=DIMS)


def exact(x, q, rows):
    unit = lambda m: m.astype(float) / np.linalg.norm(m.astype(float), axis=-1, keepdims=True)
    scores = unit(x[rows]) @ unit(q)
    return [int(rows[j]) for j in np.argsort(-scores, kind="stable")[:K]]


def test_recall_of_queries_outside_the_index(spark, data, index):
    x, queries = data
    asked = spark.createDataFrame([(k, q.tolist()) for k, q in enumerate(queries)], "query_id int, vector array<float>")
    found = index.search_many(asked, K).collect()
    every = np.arange(N)
    hits = [len({r.key for r in found if r.query_id == k} & set(exact(x, q, every))) for k, q in enumerate(queries)]
    share = np.mean([index.cells_of(q.tolist(), K)[1] for q in queries])
    assert len(found) == K * len(queries) and np.mean(hits) / K >= 0.95 and share < 0.15, (np.mean(hits) / K, share)


def test_one_search_equals_many_and_similarities_are_exact(spark, data, index):
    x, queries = data
    q = queries[3]
    one = index.search(q.tolist(), K).collect()
    many = index.search_many(spark.createDataFrame([(0, q.tolist())], "query_id int, vector array<float>"), K).orderBy("rank").collect()
    assert [r.key for r in one] == [r.key for r in many]
    for r in one:
        a, b = x[r.key].astype(float), q.astype(float)
        assert r.similarity == pytest.approx(a @ b / np.linalg.norm(a) / np.linalg.norm(b), abs=1e-12)


def test_filters_come_before_the_search(data, index):
    """A filter that few rows pass still gives as many rows as there are, up to the number asked for."""
    x, queries = data
    few = [5, 10, 4000, 4005, 8000, 11_000]
    found = index.search(queries[0].tolist(), K, where=F.col("key").isin(few)).collect()
    assert sorted(r.key for r in found) == few
    some = index.search(queries[1].tolist(), K, where=F.col("kind") == 3).collect()
    near = exact(x, queries[1], np.arange(3, N, 5))
    assert len(some) == K and all(r.key % 5 == 3 for r in some) and len({r.key for r in some} & set(near)) >= 8


def test_a_search_reads_its_cells_and_no_vectors_for_codes(data, index):
    plan = index.search(data[1][0].tolist(), K)._jdf.queryExecution().toString()
    scans = [line for line in plan.split("== Physical Plan ==")[1].splitlines() if "FileScan parquet" in line]
    assert {("code:binary" in s, "vector:" in s) for s in scans} == {(True, False), (False, True)} and all("cell#" in s.split("PartitionFilters: [")[1].split("]")[0] for s in scans)


def test_awkward_queries_and_tiny_indexes(spark, index, tmp_path):
    assert index.search([0.0] * DIMS, 3).collect() == [] and index.search([1.0], 3).collect() == []
    asked = spark.createDataFrame([(1, None), (2, [0.0] * DIMS), (3, [1.0])], "query_id int, vector array<float>")
    assert index.search_many(asked, 3).collect() == []
    none = spark.createDataFrame([], "id long, v array<float>")
    empty = VectorIndex.build(none, "id", "v", f"file://{tmp_path}/none", dims=2)
    assert empty.search([1.0, 0.0], 3).collect() == []
    two = VectorIndex.build(spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id long, v array<float>"), "id", "v", f"file://{tmp_path}/two")
    assert [r.key for r in two.search([1.0, 0.1], 5).collect()] == [1, 2]


def test_cells_are_taken_until_enough_rows_pass():
    centres = np.eye(4)
    taken = nearest_cells(np.array([[0.9, 0.3, 0.2, 0.1]]), centres, np.array([1, 0, 2, 9]), 5, 1)[0]
    assert taken == [0, 2, 3]


def test_tracks(spark):
    features = [dict.fromkeys(tracks.FEATURES, float(k)) | {"tempo": 10.0 * k} for k in range(1, 6)] + [dict.fromkeys(tracks.FEATURES, 1.0) | {"valence": None}]
    kind = "struct<" + ",".join(f"{f}:float" for f in tracks.FEATURES) + ">"
    rows = spark.createDataFrame([(f"t{k}", f"a{k % 2}", f) for k, f in enumerate(features)], f"spotify_id string, album_file_name string, f {kind}")
    rows = rows.select("spotify_id", "album_file_name", tracks.feature_vector(F.col("f")).alias("embedding"))
    ids = lambda found: [r.spotify_id for r in found.collect()]
    page = tracks.find_tracks(rows, tracks.TrackFilter(albums=["a0"]), offset=1, limit=1).collect()
    assert [(r.spotify_id, r.total) for r in page] == [("t2", 3)]
    keys = spark.createDataFrame([("t1",), ("t1",), ("t5",), ("t9",)], "k string")
    assert ids(tracks.find_tracks(rows, tracks.TrackFilter(tracks=keys, albums=["a1"]))) == ["t1", "t5"]
    query = rows.where("spotify_id = 't4'").select("embedding")
    assert ids(tracks.similar_tracks(rows, tracks.TrackFilter(tracks=keys), query, 5)) == ["t1"]  # t5 has no vector
    assert len(ids(tracks.similar_tracks(rows, tracks.TrackFilter(), query, 3))) == 3
