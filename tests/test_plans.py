"""Plans: pruned scans, pushed filters, partial aggregates, no unwanted cross joins, no Python where none is needed."""

from __future__ import annotations

import re

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
PYTHON = {"jaro_winkler_best", "knn_graph", "page_outline", "parse_album_pages", "parse_chart_pages", "parse_artist_pages", "parse_list_pages", "parse_events", "parse_search_pages", "parse_streaming_ids", "fuzzy_candidates", "knn_approximate"}
ONE_ROW_CROSS = {"catalogue_monitor", "keyset_page", "knn_filtered", "similar_excluding_self", "embedding_recommend", "reranked_recommend", "best_track_per_item", "playlist_draft", "similar_including_self", "list_recommend_adventurous", "track_knn_filtered", "track_page_with_total"}


def plan(frame) -> str:
    return frame._jdf.queryExecution().explainString(frame.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


@pytest.mark.parametrize("name", sorted(n for f in entry.FAMILIES for n in f.queries))
def test_no_cross_join_and_no_needless_python(spark, name):
    text = plan(next(f.queries[name] for f in entry.FAMILIES if name in f.queries)(spark, SF))
    assert "CartesianProduct" not in text
    if name not in ONE_ROW_CROSS:
        assert "BroadcastNestedLoopJoin" not in text
    if name not in PYTHON:
        assert not re.search("EvalPython|InPandas|InArrow", text)


def test_filters_and_columns_reach_the_scan(spark):
    queries = entry.queries()
    text = plan(queries["total_hits"](spark, SF))
    assert "GreaterThan(p_size,10)" in text and "ReadSchema: struct<p_size:int>" in text
    text = plan(queries["tail_after_cursor"](spark, SF))
    assert "In(event_type, [click,view])" in text and "GreaterThan(event_id,500)" in text and "TakeOrderedAndProject" in text
    assert "ReadSchema: struct<p_brand:string>" in plan(queries["embedding_keys"](spark, SF)) or "struct<label:int>" in plan(queries["embedding_keys"](spark, SF))
    text = plan(queries["compact_latest"](spark, SF))
    assert "partial_max_by" in text and "Window" not in text


def test_url_filter_runs_no_python(spark):
    if "op10_url_filter" in entry.queries():
        text = plan(entry.queries()["op10_url_filter"](spark, SF))
        assert not re.search("EvalPython|InPandas|InArrow", text) and "CartesianProduct" not in text
