"""Every query with SQL against DuckDB on the small tables."""

from __future__ import annotations

import glob
import importlib
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
QUERIES = {n: q for n, q in entry.queries().items() if not n.startswith("op") and n != "pipeline"} | {n: q for n, q in entry.queries().items() if n.startswith("op") and n in entry.oracle_sql()}


#: Queries that SQL can't express, and the test that compares them with something else.
ELSEWHERE = {
    "fastrp_embeddings": "test_operators.test_fast_rp_is_stable_and_keeps_neighbours_close",
    "knn_approximate": "test_vector_index.test_recall_of_queries_outside_the_index",
}


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return f"{v:.6g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    frame = QUERIES[name](spark, SF)
    columns = sorted(frame.columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in frame.collect()), key=str)
    sql = entry.oracle_sql().get(name)
    if sql is None:
        module, _, test = ELSEWHERE[name].partition(".")
        assert rows and hasattr(importlib.import_module(f"tests.{module}"), test)
        return
    result = duck.execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert rows == sorted((tuple(plain(r[k]) for k in order) for r in result.fetchall()), key=str)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
