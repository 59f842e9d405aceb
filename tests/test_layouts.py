"""What lookups by key read and move, pages read once, and entries of JSON documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from cataloom.operators import stores
from cataloom.plans.pages import catalogue_pages
from cataloom.sources import pages
from cataloom.sources.keyed import KeyedScan

SF = "/root/testdata/sf0.001"


def plan_of(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


def rows_scanned(frame) -> int:
    """Rows that the scan of a plan of one stage gave to its filter."""
    frame._jdf.collectToPython()
    leaf = frame._jdf.queryExecution().executedPlan().collectLeaves().head()
    return leaf.metrics().apply("numOutputRows").value()


def test_lookups_read_buckets_and_row_groups_and_move_only_keys(spark, tmp_path):
    n, buckets = 200_000, 8
    rows = spark.range(n).select((F.col("id") * 3).alias("k"), F.concat(F.lit("v"), F.col("id")).alias("v"))
    store = KeyedScan.save(rows, "k", f"file://{tmp_path}/t", buckets, group_bytes=16 << 10)
    few = store.get([3, 300, 301])
    assert sorted((r.k, r.v) for r in few.collect()) == [(3, "v1"), (300, "v100")]
    assert "Exchange" not in plan_of(few) and rows_scanned(store.get([3, 300, 301])) < n / buckets
    scanned = rows_scanned(store.get([300_000]))
    assert scanned < n / buckets / 2, scanned  # other row groups of the key's bucket are skipped
    # Within the range of a bucket's keys but absent: the Bloom filters leave nothing to read.
    assert sum(rows_scanned(store.get([k])) for k in range(100_000, 100_020) if k % 3) <= n / buckets / 2
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        keys = spark.range(0, 100_000, 7).select(F.col("id").alias("k")).union(spark.range(10).select(F.lit(21).alias("k")))
        many = store.get_many(keys)
        plan = plan_of(many)
        side = plan.split("LeftSemi")[1]
        assert many.count() == len({k for k in range(0, 100_000, 7) if k % 3 == 0} | {21})
        assert side[: side.index("Exchange")].count("FileScan") == 1  # the table's scan comes before any exchange
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert store.get([]).count() == 0
    store.drop()


def test_pages_are_read_once_and_only_of_the_types_asked_for(spark):
    found = catalogue_pages(spark, SF)
    plan = plan_of(pages.parse_events(pages.read_pages(found)))
    assert plan.count("ArrowEvalPython") == 1 and "Join" not in plan and "Union" not in plan
    seen = pages.read_pages(found, ["artist"]).groupBy("page_type").count().collect()
    assert [r.page_type for r in seen] == ["artist"]


def test_events_tell_what_the_extractors_tell(spark):
    """A page without each required part."""
    album = '<meta itemprop="name" content="N"><meta itemprop="ratingValue" content="1"><meta itemprop="ratingCount" content="2"><div class="release_page"><span itemprop="byArtist"><a href="/artist/x">x</a></span></div>'
    bodies = [album, album.replace('"name"', '"n"'), album.replace("ratingValue", "r"), album.replace("ratingCount", "r"), album.replace("release_page", "r"), album.replace("/artist/x", "/nowhere"), ""]
    rows = [(f"release/album/a/{k}", b) for k, b in enumerate(bodies)]
    rows += [("artist/a", "<p>"), ("artist/b", '<meta itemprop="name" content="A">'), ("list/u/1/1", "<h1>L</h1>"), ("list/u/2/1", ""), ("charts/top/album/1", ""), ("search?searchterm=1&searchtype=l", '<div class="infobox"><a class="searchpage" href="/release/single/a/1">s</a></div>'), ("search?searchterm=2&searchtype=l", ""), ("release/album/a/none", None)]
    raw = pages.read_pages(spark.createDataFrame(rows, "file_name string, html string"))
    events = {r.file_name: r.error for r in pages.parse_events(raw).collect()}
    apart = {}
    for read, name in ((pages.albums, "file_name"), (pages.artists, "file_name"), (pages.search_results, "search"), (pages.list_segments, "file_name")):
        apart |= {r[name]: r.error for r in read(raw).select(name, "error").collect()}
    assert {k: v for k, v in events.items() if not k.startswith("charts")} == apart and events["charts/top/album/1"] is None
    assert len({e for e in events.values() if e}) >= 6


def test_entries_of_json_documents(spark):
    rows = [(1, '{"a": 1, "b": [2, "x"], "c": null}'), (2, "[5, {}]"), (3, "7"), (4, "{}"), (5, None), (6, '{"b": ["x", "x"]}')]
    docs = spark.createDataFrame(rows, "id int, text string").select("id", F.try_parse_json("text").alias("json"))
    found = stores.json_entries(docs, "json").select("id", "key", F.to_json("value").alias("v")).collect()
    assert sorted((r.id, r.key, r.v) for r in found if r.id != 2) == [(1, "a", "1"), (1, "b", '[2,"x"]'), (1, "c", "null"), (6, "b", '["x","x"]')]
    assert sorted(r.v for r in found if r.id == 2) == ["5", "{}"]
    ids = docs.select("id", F.col("json"))
    assert sorted(r.id for r in stores.entries_containing(ids, "json", "b", "x").select("id").collect()) == [1, 6]
    assert [r.id for r in stores.entries_containing(ids, "json", "", 5).select("id").collect()] == [2]
