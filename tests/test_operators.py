"""Contracts of the catalogue operators: hand-worked cases and properties."""

from __future__ import annotations

import math
from datetime import date, datetime

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cataloom.functions import scalars, vectors
from cataloom.functions.similarity import jaro_winkler
from cataloom.operators import catalog, eventlog, graph, jobs, lookups, ranking, recommend, resolve, search, stores, summary, vector_search
from cataloom.sources import pages


def values(frame, column):
    return [r[0] for r in frame.select(column).collect()]


# Scalars


def test_page_types_and_names(spark):
    cases = {
        "release/album/a/b/": "album", "/release/ep/a/b": "album", "charts/top/album/2020": "chart", "search?searchterm=a&searchtype=l": "album_search_result", "artist/x": "artist",
        "list/u/name": "list_segment", "list/u/name/2": "list_segment", "/list/u/name/": "list_segment", "release/single/a": None,
    }
    frame = spark.createDataFrame(list(cases.items()), "name string, kind string").withColumn("file", scalars.normal_file_name(F.col("name")))
    for r in frame.withColumn("got", scalars.page_type(F.col("file"))).collect():
        assert r.got == r.kind
    assert values(frame.where("name = '/list/u/name/'"), "file") == ["list/u/name/1"]
    assert values(frame.where("name = 'list/u/name/2'"), scalars.list_root(F.col("file"))) == ["list/u/name"]


def test_page_types_are_exact(spark):
    """The forms as they are, without trimming, and near misses of each."""
    cases = {
        "release/album/a/b": "album", "release/mixtape/x": "album", "release/single/x": None, "Release/album/x": None, "charts/2024/album/1/": "chart", "charts/top/ep/x": "chart", "charts/top/song/2020": None, "charts/top/album": None, "charts/a-b/album/1": None,
        "search?searchterm=foo&searchtype=l": "album_search_result", "search?searchterm=&searchtype=l": None, "search?searchtype=l": None, "search?searchterm=foo&x=1&searchtype=l": None, "search?searchterm=foo&searchtype=la": None, "search?searchterm=foo&searchtype=l\n": None,
        "artist/foo": "artist", "artists": "artist", "list/u1/long-name_2": "list_segment", "list/u1/long-name/": "list_segment", "list/u1/long-name/1": "list_segment", "list/u1/long-name/1/": "list_segment", "list/u-1/name": None, "list/u1/na.me": None, "list/u1/name/x": None, "list/u1": None, "list/é/ü": "list_segment", "invalid": None,
    }
    frame = spark.createDataFrame(list(cases.items()), "name string, kind string")
    assert {r.name: r.got for r in frame.withColumn("got", scalars.page_type(F.col("name"))).collect()} == cases


def test_dates_ulid_chunks_and_folding(spark):
    dates = spark.createDataFrame([("3 May 1991",), ("May 1991",), ("1991",), ("soon",), ("",), (None,)], "t string")
    assert values(dates, scalars.release_date(F.col("t"))) == [date(1991, 5, 3), date(1991, 5, 1), date(1991, 1, 1), None, None, None]
    ulid = spark.createDataFrame([("01ARZ3NDEKTSV4RRFFQ69G5FAV",), ("bad",)], "t string")
    assert values(ulid, F.unix_millis(scalars.ulid_time(F.col("t")))) == [1469922850259, None]
    text = spark.createDataFrame([("aa bb cc dddddddd e",), ("",)], "t string")
    assert values(text, scalars.chunks_of_words(F.col("t"), 5)) == [["aa bb", "cc", "dddddddd", "e"], []]
    names = spark.createDataFrame([("Björk Æon Łódź Straße",)], "t string")
    assert values(names, scalars.ascii_fold(F.col("t"))) == ["Bjork AEon Lodz Strasse"]
    assert values(spark.createDataFrame([("A &amp;",), ("B &",), ("C & D",)], "t string"), scalars.clean_artist_name(F.col("t"))) == ["A", "B", "C & D"]


def test_staleness(spark):
    now = F.lit(datetime(2024, 2, 1)).cast("timestamp_ntz")
    rows = spark.createDataFrame([("artist/a", datetime(2024, 1, 20)), ("release/album/a/b", datetime(2024, 1, 20)), ("artist/a", None)], "f string, t timestamp_ntz")
    assert values(rows, scalars.is_stale(F.col("f"), F.col("t"), now)) == [True, False, True]


def test_jaro_winkler_known_values():
    assert round(jaro_winkler("martha", "marhta"), 4) == 0.9611 and round(jaro_winkler("dixon", "dicksonx"), 4) == 0.8133
    assert jaro_winkler("", "a") == 0 and jaro_winkler("same", "same") == 1


# Catalogue


def test_hydrate_upsert_and_sets(spark):
    parents = spark.createDataFrame([(1, "a"), (2, "b")], "id int, name string")
    child = spark.createDataFrame([(1, "x", "r"), (1, "x", "r"), (1, "w", None)], "id int, who string, role string")
    out = {r.id: r.kids for r in catalog.hydrate(parents, "id", {"kids": catalog.nested(child, "id", ["who", "role"], "kids")}).collect()}
    assert [(k.who, k.role) for k in out[1]] == [("w", None), ("x", "r")] and out[2] == []
    changes = spark.createDataFrame([(2, "old", 1), (2, "new", 2), (3, "c", 1)], "id int, name string, at int")
    assert {tuple(r) for r in catalog.upsert(parents, changes, "id", [F.col("at")]).collect()} == {(1, "a"), (2, "new"), (3, "c")}
    again = catalog.upsert(catalog.upsert(parents, changes, "id", [F.col("at")]), changes, "id", [F.col("at")])
    assert {tuple(r) for r in again.collect()} == {(1, "a"), (2, "new"), (3, "c")}
    top = catalog.top_per_key(changes, ["id"], [F.desc("at")])
    assert {(r.id, r.name) for r in top.collect()} == {(2, "new"), (3, "c")}


def test_credit_without_roles_and_delete_then_save(spark):
    credits = spark.createDataFrame([("s", 1, None), ("s", 1, None), ("s", 2, "mix")], "artist string, album int, role string")
    main = spark.createDataFrame([("s", 2)], "artist string, album int")
    assert [tuple(r) for r in catalog.credited_not_main(credits, main, "artist", "album", "role").collect()] == [("s", 1, None)]
    events = spark.createDataFrame([("f", 1, 6), ("f", 2, 0), ("f", 3, 3)], "file string, id long, state int")
    assert [tuple(r) for r in eventlog.fold_states(events, "file", "id", F.col("state")).collect()] == [("f", 3)]
    assert eventlog.fold_states(events.where("id < 3"), "file", "id", F.col("state")).count() == 0


# Search


def test_document_filter_precedence(spark):
    docs = spark.createDataFrame([('{"a":1,"b":2,"tags":["x","y"]}',), ('{"a":2,"b":9}',), ('{"c":"z","a":null}',), ("{}",)], "raw string").select("raw", F.parse_json("raw").alias("j"))

    def hits(f):
        return docs.where(f.predicate(F.col("j"))).count()

    make = search.DocumentFilter
    assert hits(make().where("a", "=", 1).where("b", "=", 9).otherwise().where("c", "=", "z")) == 1
    assert hits(make().group(make().where("a", "=", 1).otherwise().where("a", "=", 2)).where("b", ">", 5)) == 1
    assert hits(make().where("tags", "CONTAINS", "y")) == 1 and hits(make().where("tags", "CONTAINS", "q")) == 0
    assert hits(make().where("a", "IN", [1, 2])) == 2 and hits(make().where("a", "NOT IN", [1])) == 1 and hits(make().where("c", "LIKE", "z%")) == 1 and hits(make()) == 4


def test_keyset_pages_reach_every_row(spark):
    rows = spark.range(23).withColumnRenamed("id", "k")
    seen, cursor = [], None
    while True:
        page = search.keyset_page(rows, "k", cursor, 5).orderBy("k").collect()
        seen += [r.k for r in page]
        cursor = page[0].next_cursor if page else None
        if cursor is None:
            break
    assert seen == list(range(23))


def test_facets_with_null_and_empty(spark):
    rows = spark.createDataFrame([("a", ["x"], 1990), ("b", [], None), ("c", None, 2000)], "name string, tags array<string>, release_year int")
    run = lambda **k: sorted(values(rows.where(search.CatalogueSearch(**k).predicate(duplicate_of=None)), "name"))
    assert run(include={"tags": ["x"]}) == ["a"] and run(exclude={"tags": ["x"]}) == ["b", "c"] and run(min_year=1980) == ["a", "c"] and run() == ["a", "b", "c"]
    assert run(text="nothing") == [] and run(exact_name="A") == ["a"] and run(at_least={"tags": 1}) == ["a"]


# Summaries and ranking


@settings(max_examples=15, deadline=None)
@given(st.lists(st.integers(0, 6), min_size=1, max_size=30))
def test_mid_ranks(spark, numbers):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(numbers)], "k int, v int").withColumn("g", F.lit(1))
    for r in ranking.mid_ranks(rows, ["g"], "v").collect():
        below, equal = sum(x < r.v for x in numbers), sum(x == r.v for x in numbers)
        assert r.rank == pytest.approx((below + equal / 2) / len(numbers)) and 0 <= r.rank <= 1


def test_number_ranks_outside_the_seed(spark):
    seed = spark.createDataFrame([(1.0,), (2.0,), (2.0,), (5.5,)], "v double")
    asked = spark.createDataFrame([(k, x) for k, x in enumerate([0.0, 1.0, 2.0, 3.0, 5.5, 9.0, None])], "k int, v double")
    got = {r.k: r.x_rank for r in ranking.number_ranks(asked, seed, "k", {"x": "v"}).collect()}
    assert got == {0: 0, 1: 0.125, 2: 0.5, 3: 0.75, 4: 0.875, 5: 1.0}


def catalogue(spark):
    rows = [("s1", ["A"], ["rock"], ["pop"], ["d1", "d2"], 3.0, 10), ("s2", ["B"], ["rock"], [], ["d1"], 4.0, 20), ("c1", ["A"], ["rock"], ["pop"], ["d1", "d2"], 3.5, 15), ("c2", ["C"], ["jazz"], [], ["d9"], 1.0, 1), ("c3", ["D"], [], [], [], 5.0, 99)]
    frame = spark.createDataFrame(rows, "file_name string, artists array<string>, primary_tags array<string>, secondary_tags array<string>, descriptors array<string>, rating double, rating_count int")
    return frame.withColumn("descriptor_count", F.size("descriptors")).withColumn("credit_tags", F.array().cast("array<string>"))


def python_score(album, seed, s, novelty=0.2):
    """The scoring contract in plain Python."""
    total = weight = 0.0
    for facet, column in recommend.Columns().tags.items():
        w = s.tag_weights[facet]
        if not w:
            continue
        factors = {}
        for item, f in seed:
            for t in item[column]:
                factors[t] = factors.get(t, 0) + f
        rank = {t: (sum(x < f for x in factors.values()) + sum(x == f for x in factors.values()) / 2) / len(factors) for t, f in factors.items()}
        tags = album[column]
        total += w * (sum(rank.get(t) or novelty for t in tags) / len(tags) if tags else novelty)
        weight += w
    for name, column in recommend.Columns().numbers.items():
        w, x, all_ = s.number_weights[name], album[column], [i[column] for i, _ in seed]
        if w:
            total += w * (sum(y < x for y in all_) + sum(y == x for y in all_) / 2) / len(all_)
            weight += w
    return total / weight


@pytest.mark.parametrize("scale", [1, 3])
def test_quantile_scores_follow_the_contract(spark, scale):
    c = catalogue(spark)
    base = ranking.Settings()
    s = ranking.Settings({k: v * scale for k, v in base.tag_weights.items()}, {k: v * scale for k, v in base.number_weights.items()})
    seed = spark.createDataFrame([("s1", 2), ("s2", 1), ("missing", 5)], "file_name string, factor int")
    got = {r.file_name: r.score for r in recommend.quantile_scores(c, c, seed, s, recommend.Columns()).collect()}
    items = {r.file_name: r for r in c.collect()}
    for name, album in items.items():
        assert got[name] == pytest.approx(python_score(album, [(items["s1"], 2), (items["s2"], 1)], s))


def test_zero_weights_empty_seed_and_known_artists(spark):
    c = catalogue(spark)
    none = ranking.Settings({k: 0 for k in ranking.Settings().tag_weights}, {k: 0 for k in ranking.Settings().number_weights})
    seed = spark.createDataFrame([("s1", 2)], "file_name string, factor int")
    assert recommend.quantile_scores(c, c, seed, none, recommend.Columns()).count() == 0
    one = ranking.Settings({"primary": 1, "secondary": 0, "descriptor": 0, "credit": 0}, none.number_weights)
    scores = {r.file_name: r.score for r in recommend.quantile_scores(c, c, seed, one, recommend.Columns()).collect()}
    assert scores["c1"] == 0.5 and scores["c2"] == scores["c3"] == 0.2
    request = recommend.Request(count=0, least_tags={"primary": 1})
    assert request.k == 10 and sorted(values(recommend.candidates(c, seed, request, recommend.Columns()), "file_name")) == ["c2", "s2"]
    empty = seed.where("false")
    assert set(values(recommend.quantile_scores(c, c, empty, one, recommend.Columns()), "score")) == {0.2}


def test_ties_at_the_cut(spark):
    rows = spark.createDataFrame([("b", 1.0), ("a", 1.0), ("c", 2.0)], "k string, score double")
    assert values(ranking.top(rows, 2, "score", "k"), "k") == ["c", "a"]


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(st.integers(1950, 2020), st.integers(1, 5)), min_size=1, max_size=12))
def test_weighted_median(spark, pairs):
    rows = spark.createDataFrame(pairs, "y int, f int")
    repeated = sorted(y for y, f in pairs for _ in range(f))
    n = len(repeated)
    middle = repeated[n // 2] if n % 2 else (repeated[n // 2 - 1] + repeated[n // 2]) / 2
    assert rows.agg(summary.weighted_median_year(F.col("y"), F.col("f"))).first()[0] == math.floor(middle + 0.5)


# Vectors, graph


def test_nearest_equals_numpy(spark):
    x = np.random.default_rng(0).normal(size=(50, 6))
    rows = spark.createDataFrame([(k, [float(a) for a in v]) for k, v in enumerate(x)] + [(99, [0.0] * 6)], "k long, v array<double>")
    got = [r.k for r in vector_search.similar_to(rows, 3, "v", "k", 7).collect()]
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert got == [k for k in np.argsort(-(unit @ unit[3])) if k != 3][:7]
    assert vector_search.similar_to(rows, 3, "v", "k", 7, exclude_self=False).first().k == 3 and vector_search.similar_to(rows, 1234, "v", "k").count() == 0
    mean = vector_search.mean_vector(rows.where("k < 3"), "v", F.col("k") + 1).first()[0]
    assert np.allclose(mean, (x[:3] * np.arange(1, 4)[:, None]).sum(axis=0) / 6)
    assert values(rows.where(vectors.is_zero(F.col("v"))), "k") == [99] and vector_search.without_zero_vectors(rows, "v").count() == 50


def test_fast_rp_is_stable_and_keeps_neighbours_close(spark):
    edges = [(f"a{i}", f"a{j}") for i in range(6) for j in range(i)] + [(f"b{i}", f"b{j}") for i in range(6) for j in range(i)] + [("a0", "b0")]
    both = graph.undirected(spark.createDataFrame([(a, b, 1.0) for a, b in edges], "src string, dst string, weight double"))
    one, two = ({r.id: np.array(r.embedding) for r in graph.fast_rp(both, dims=64).collect()} for _ in range(2))
    assert all(np.allclose(one[k], two[k]) for k in one) and len(one["a1"]) == 64
    cos = lambda p, q: p @ q / np.linalg.norm(p) / np.linalg.norm(q)
    assert cos(one["a1"], one["a2"]) > cos(one["a1"], one["b2"]) + 0.2


# Resolution, lookups, jobs, stores


def test_duplicates_and_best_match(spark):
    rows = spark.createDataFrame([(1, "Café", "x", 5), (2, "cafe", "x", 9), (3, "CAFE", "y", 1), (4, "Cafe", "x", 9)], "k int, name string, artist string, n int")
    assert {tuple(r) for r in resolve.duplicates(rows, "k", "name", "artist", "n").collect()} == {(1, 2), (4, 2)}
    queries = spark.createDataFrame([("Cafes", "x"), ("zzz", "x")], "q string, artist string")
    assert [(r.q, r.k) for r in resolve.best_match(queries, rows, "q", "name", "k", "artist").collect()] == [("Cafes", 1)]


def test_match_candidates_skip_singles_and_stop_at_five(spark):
    rows = spark.createDataFrame([(k, f"song{k}", "x", "album") for k in range(8)] + [(9, "song", "x", "single")], "k int, name string, artist string, kind string")
    queries = spark.createDataFrame([("song", "x"), ("zzz", "x"), ("song", "y")], "q string, artist string")
    found = resolve.match_candidates(queries, rows, "q", "name", "k", "artist", "kind").orderBy("candidate").collect()
    assert [(r.candidate, r.k) for r in found] == [(n + 1, n) for n in range(5)]


def test_list_statuses(spark):
    cases = {"invalid": [], "started": [("s1", 1), ("i", 6)], "progress": [("s1", 4), ("s2", 1)], "failed": [("s1", 5), ("i", 5)], "completed": [("s1", 6), ("i", 5)], "open": [("s1", 6), ("i", 3)]}
    rows = spark.createDataFrame([(r, c, s) for r, some in cases.items() for c, s in some], "root string, component string, state int").withColumn("seg", F.col("component").startswith("s"))
    roots = spark.createDataFrame([(r,) for r in cases], "root string")
    got = {r.root: (r.status, r.completion) for r in lookups.list_status(roots, rows, "root", "seg").collect()}
    assert got == {"invalid": ("Invalid", 0), "started": ("Started", 50), "progress": ("InProgress", 0), "failed": ("Failed", 0), "completed": ("Completed", 50), "open": ("InProgress", 50)}


def test_jobs(spark):
    schema = "id string, name string, next_execution timestamp_ntz, claimed_at timestamp_ntz, priority int, interval_seconds int"
    t = datetime(2024, 1, 1)
    rows = spark.createDataFrame([("a", "n", t, None, 2, None), ("b", "n", t, t, 0, 60), ("c", "n", datetime(2025, 1, 1), None, 0, None), ("d", "m", t, None, 1, 60)], schema)
    now = F.lit(datetime(2024, 1, 1, 0, 5)).cast("timestamp_ntz")
    assert values(jobs.next_jobs(rows, None, now, 5), "id") == ["d", "a"] and values(jobs.next_jobs(rows, None, now + F.expr("INTERVAL 1 HOUR"), 1), "id") == ["b"]
    asked = rows.withColumn("priority", F.lit(9)).withColumn("overwrite", F.col("id") == "a").withColumn("interval_seconds", F.when(F.col("id") == "d", 61).otherwise(F.col("interval_seconds")))
    assert {r.id: r.priority for r in jobs.put(rows, asked).collect()} == {"a": 9, "b": 0, "c": 0, "d": 9}
    done = jobs.finish(rows, rows.where("id in ('a', 'b')"), now)
    assert {r.id: r.claimed_at for r in done.collect()} == {"b": None, "c": None, "d": None}


def test_stores(spark):
    now = F.lit(datetime(2024, 1, 1)).cast("timestamp_ntz")
    store = spark.createDataFrame([("a:1", 1, None), ("a:2", 2, datetime(2023, 1, 1)), ("b", 3, datetime(2025, 1, 1))], "key string, value long, expires_at timestamp_ntz").withColumn("updated_at", F.col("expires_at"))
    keys = spark.createDataFrame([("a:1",), ("a:2",), ("z",)], "key string")
    assert values(stores.get_many(store, keys, "key", now), "key") == ["a:1"] and stores.count_matching(store, "key", "a:%").first().n == 2
    assert {tuple(r) for r in stores.increment(store, spark.createDataFrame([("b", 4), ("n", 1)], "key string, value long"), "key", "value").collect()} >= {("b", 7), ("n", 1)}
    assert stores.delete_expired(store, now).count() == 2 and stores.delete_many(store, keys, "key").count() == 1


# Events


@settings(max_examples=12, deadline=None)
@given(st.lists(st.integers(0, 6), min_size=1, max_size=25))
def test_state_fold_property(spark, states):
    from cataloom.streaming.events import next_state

    now = 0
    for s in states:
        now = next_state(now, s)
    rows = spark.createDataFrame([("f", k, s) for k, s in enumerate(states)], "file string, id long, state int")
    assert [r.state for r in eventlog.fold_states(rows, "file", "id", F.col("state")).collect()] == ([now] if now else [])


@settings(max_examples=8, deadline=None)
@given(st.lists(st.lists(st.tuples(st.integers(1, 6), st.sampled_from(["a", "b", None])), min_size=1, max_size=20), min_size=1, max_size=6))
def test_lookup_fold_equals_python(spark, logs):
    wanted, rows, seq = {}, [], 0
    for k, log in enumerate(logs):
        step, by = 0, None
        for new, correlation in log:
            seq += 1
            rows.append((f"f{k}", seq, new, correlation))
            if new > step or correlation != by:
                step, by = new, correlation
        wanted[f"f{k}"] = (step, by)
    frame = spark.createDataFrame(rows, "file string, id long, step int, by string")
    assert {r.file: (r.step, r.correlation) for r in eventlog.fold_lookups(frame, "file", "id", F.col("step"), "by").collect()} == wanted


def test_chunks_of_the_log(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None), (5, None), (11, "a")], "id long, by string")
    assert {r.id: r.chunk for r in eventlog.chunked(rows, "id", 10, "by").collect()} == {1: "g:a/0", 2: "g:a/0", 3: "g:b/0", 4: "e:4", 5: "e:5", 11: "g:a/1"}
    assert {r.chunk for r in eventlog.chunked(rows, "id", 10).collect()} == {"0", "1"}


def test_compaction_is_idempotent_and_keeps_keyless(spark):
    rows = spark.createDataFrame([(1, "a", "k"), (2, "a", "k"), (3, "a", None), (4, "a", None)], "id long, topic string, key string")
    once = eventlog.compact(rows, ["topic", "key"], "id")
    assert sorted(values(once, "id")) == [2, 3, 4] == sorted(values(eventlog.compact(once, ["topic", "key"], "id"), "id"))


# Pages


def test_selectors():
    root = pages.parse('<div id="x" class="a b"><p class="a">One <b>two</b></p><img src="i"></div><p>Three &amp; four</p>')
    assert [n.text() for n in pages.select(root, "p")] == ["One two", "Three & four"]
    assert [n.text() for n in pages.select(root, "#x .a")] == ["One two"] and pages.select(root, "div.a.b img")[0].attributes["src"] == "i" and pages.select(root, "div.c") == []


def test_album_page_errors_and_streaming_id(spark):
    good = '<meta itemprop="name" content="N’s"><meta itemprop="ratingValue" content="x"><meta itemprop="ratingCount" content="7"><div id="media_link_button_container_top" data-links=\'{"spotify":{"1":{"default":false},"2":{"default":true}}}\'></div><div class="release_page"></div>'
    rows = spark.createDataFrame([("release/album/a/1", good), ("release/album/a/2", "<p>nothing"), ("release/album/a/3", None), ("other", good)], "file_name string, html string")
    found = {r.file_name: r for r in pages.albums(pages.read_pages(rows)).collect()}
    one = found["release/album/a/1"]
    assert (one.name, one.rating, one.rating_count, one.spotify_id, one.error, one.artists) == ("N's", 0.0, 7, "2", None, []) and found["release/album/a/2"].error == "missing name" and len(found) == 2
    assert {(r.file_name, r.event) for r in pages.parse_events(pages.read_pages(rows)).collect()} == {("release/album/a/1", "FileParsed"), ("release/album/a/2", "FileParseFailed")}


def test_recommendations_from_a_list(spark):
    c = catalogue(spark).withColumn("release_year", F.when(F.col("file_name") == "c1", 1990).otherwise(2000))
    c = c.withColumn("descriptors", F.array(*[F.concat(F.col("descriptors")[0], F.lit(str(k))) for k in range(5)])).withColumn("secondary_tags", F.array(F.lit("pop"))).where("file_name != 'c3'")
    vectors_ = spark.createDataFrame([("s1", [1.0, 0.0]), ("s2", [0.0, 1.0]), ("c1", [0.9, 0.1]), ("c2", [0.5, 0.5])], "file_name string, v array<double>")
    segments = spark.createDataFrame([("list/u/1/1", "list/u/1", ["s1"]), ("list/u/1/2", "list/u/1", ["s1"]), ("list/u/2/1", "list/u/2", ["s2"])], "file_name string, root_file_name string, albums array<string>")
    run = lambda style, years: values(recommend.recommend_for_list(segments, "list/u/1", c, vectors_, "v", style, years, recommend.Columns()), "file_name")
    assert run("safe", None)[0] == "c1" and "s1" not in run("safe", None) and run("safe", (1995, 2005))[0] != "c1"
    assert run("adventurous", None) == ["c1", "c2", "s2"] and run("adventurous", (1995, 2005)) == ["c2", "s2"]
    with pytest.raises(ValueError):
        run("other", None)


def test_schemas_read_rows(spark):
    from cataloom import schema

    for name in ("ALBUM", "ARTIST", "EMBEDDING", "TRACK", "EVENT", "SUBSCRIBER", "DOCUMENT", "KEY_VALUE", "JOB", "PROFILE_ITEM", "LIST_SEGMENT", "FILE_STATE", "NODE", "EDGE"):
        assert spark.createDataFrame([], getattr(schema, name)).count() == 0


def test_requests_of_settings():
    flags = [recommend.request_of(s).exclude_known_artists for s in (None, {}, {"exclude_known_artists": None}, {"exclude_known_artists": True}, {"exclude_known_artists": False})]
    assert flags == [True, False, False, True, False]
    assert [recommend.request_of(s).k for s in (None, {"count": 0}, {"count": 3})] == [10, 10, 3]


def test_numbers_by_ranges_equal_a_sort(spark):
    rows = [(k, v) for k, v in enumerate([5.0, None, 1.0, 5.0, -2.0, 1.0, 9.0, None] * 40)]
    frame = spark.createDataFrame(rows, "k int, v double")
    for descending in (False, True):
        want = sorted(rows, key=lambda r: (((r[1] is not None) if not descending else (r[1] is None)), (-1 if descending else 1) * (r[1] or 0), r[0]))
        found = {r.k: r["rank"] for r in ranking.row_numbers(frame, "v", "k", descending=descending).collect()}
        assert [found[k] for k, _ in want] == list(range(1, len(rows) + 1))


def test_large_seeds_are_ranked_by_ranges_and_give_the_same(spark, monkeypatch):
    c = spark.createDataFrame([(f"i{k}", ["a"], [f"t{k % 3}"], [f"t{k % 7}"], [f"p{k}"], [], float(k % 11), k % 5, 1) for k in range(60)], "file_name string, artists array<string>, primary_tags array<string>, secondary_tags array<string>, descriptors array<string>, credit_tags array<string>, rating double, rating_count int, descriptor_count int")
    seed = c.where("rating_count < 2").select("file_name", "rating_count").withColumnRenamed("rating_count", "factor")
    run = lambda: {r.file_name: round(r.score, 9) for r in recommend.quantile_scores(c, c, seed, ranking.Settings(), recommend.Columns()).collect()}
    small = run()
    monkeypatch.setattr(ranking, "PLAN_ROWS", 3)
    monkeypatch.setattr(ranking, "SEED_ROWS", 3)
    assert len(small) == 60 and run() == small


def test_fast_rp_equals_plain_rounds_and_sends_no_vector_for_an_edge(spark):
    """A hub of 3,000 edges and pairs of its leaves; vectors of a round are read once a block, not once an edge."""
    edges = [("hub", f"n{k}", 1.0 + k % 3) for k in range(3000)] + [(f"n{k}", f"n{k + 1}", 2.0) for k in range(0, 3000, 2)]
    both = graph.undirected(spark.createDataFrame(edges, "src string, dst string, weight double"))
    found = graph.fast_rp(both, dims=8, weights=(0.5, 1.0, 2.0))
    got = {r.id: np.array(r.embedding) for r in found.collect()}
    ids = spark.createDataFrame([(i,) for i in got], "id string")
    start = {r.id: np.array(r.v) for r in ids.withColumn("v", graph.random_projection(F.col("id"), 8, 42)).collect()}
    now, want = start, {i: 0.5 * v for i, v in start.items()}
    for weight in (1.0, 2.0):
        sums = {i: np.zeros(8) for i in got}
        for a, b, w in edges:
            sums[a] = sums[a] + w * now[b]
            sums[b] = sums[b] + w * now[a]
        now = {i: v / (np.linalg.norm(v) or 1.0) for i, v in sums.items()}
        want = {i: want[i] + weight * now[i] for i in want}
    assert len(got) == 3001 and max(np.abs(got[i] - want[i]).max() for i in got) < 1e-9
    some = {r.id: np.array(r.embedding) for r in graph.fast_rp(both, dims=8, weights=(0.5, 1.0, 2.0), wanted=F.col("id") == "hub").collect()}
    assert list(some) == ["hub"] and np.abs(some["hub"] - want["hub"]).max() < 1e-9
    assert "ObjectHashAggregate" not in found._jdf.queryExecution().toString()


def test_undirected_edges_are_dealt_by_their_number(spark, monkeypatch):
    """The more edges the more partitions, so that a task keeps as many."""
    monkeypatch.setattr(graph, "EDGES", 100)
    rows = spark.range(450).select(F.col("id").cast("string").alias("a"), (F.col("id") % 7).cast("string").alias("b"))
    directed = graph.edges([("CREDITED", rows, F.concat(F.lit("x"), F.col("a")), F.concat(F.lit("y"), F.col("b")))])
    assert directed.rdd.getNumPartitions() == 5
    both = graph.undirected(directed)
    assert both.rdd.getNumPartitions() == 10 and both.count() == 900
    at = both.select("src", F.spark_partition_id().alias("p")).groupBy("src").agg(F.count_distinct("p").alias("n"))
    assert at.where("n > 1").count() == 0


def test_pages_are_read_by_parts_in_tasks_for_all_cores(spark):
    """Parts left out change no other column and no event; the tasks of reading aren't coalesced to the bytes moved."""
    html = '<meta itemprop="name" content="N"><meta itemprop="ratingValue" content="1"><meta itemprop="ratingCount" content="2"><div class="release_page"></div><div id="media_link_button_container_top" data-links="{&quot;spotify&quot;:{&quot;i%d&quot;:{&quot;default&quot;:true}}}"></div>'
    rows = spark.createDataFrame([(f"release/album/a/{k}", html % k if k % 3 else "<p>") for k in range(60)] + [("artist/a", "<p>")], "file_name string, html string")
    whole, some = pages.read_pages(rows), pages.read_pages(rows, parts={"album": ["links"]})
    ids = lambda raw: sorted((r.file_name, r.spotify_id) for r in pages.albums(raw).collect())
    assert ids(whole) == ids(some) and sum(i is not None for _, i in ids(some)) == 40
    events = lambda raw: sorted((r.file_name, r.event, r.error) for r in pages.parse_events(raw).collect())
    assert events(whole) == events(pages.read_pages(rows, parts=pages.DECIDING))
    assert whole.rdd.getNumPartitions() == pages.TASKS_A_CORE * spark.sparkContext.defaultParallelism
    assert set(events(some)) != set(events(whole))


def test_profiles_and_lists_are_dealt_by_the_number_of_line_items(spark, monkeypatch):
    from cataloom.plans import events, ranking

    monkeypatch.setattr(ranking, "LINES", 1000)
    monkeypatch.setattr(events, "LINES", 1000)
    sf = "/root/testdata/sf0.001"
    tasks = spark.read.parquet(f"{sf}/lineitem.parquet").count() // 1000 + 1
    rows = ranking.profiles(spark, sf)
    assert rows.rdd.getNumPartitions() == tasks > 1
    places = rows.select("profile", F.spark_partition_id().alias("at")).distinct()
    assert places.count() == places.select("profile").distinct().count()
    assert "hashpartitioning(root#" in (plan := events.lookups_touched(spark, sf)._jdf.queryExecution().toString()) and f", {tasks}), REPARTITION_BY_NUM" in plan
