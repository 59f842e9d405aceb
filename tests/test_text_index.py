"""Ranked search and near terms against plain versions, and what a search reads."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest

from cataloom.operators import text_index
from cataloom.operators.text_index import TextIndex

STEMS = {
    "caresses": "caress", "ponies": "poni", "cats": "cat", "caress": "caress", "is": "is", "gas": "ga", "agreed": "agree", "feed": "feed", "plastered": "plaster", "bled": "bled",
    "motoring": "motor", "sing": "sing", "conflated": "conflate", "troubled": "trouble", "sized": "size", "hopping": "hop", "falling": "fall", "hissing": "hiss", "filing": "file",
    "happy": "happi", "sky": "sky", "a": "a", "1990s": "1990",
}


def test_stems(spark):
    rows = spark.createDataFrame([(k,) for k in STEMS], "word string")
    assert {r.word: r.term for r in text_index.stemmed(rows, "word", "term").collect()} == STEMS


def edits(a: str, b: str) -> int:
    line = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        line, before = [i], line
        for j, y in enumerate(b, 1):
            line.append(min(before[j] + 1, line[j - 1] + 1, before[j - 1] + (x != y)))
    return line[-1]


def test_near_terms_equal_all_pairs(spark):
    rng = random.Random(4)
    words = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 11))) for _ in range(400)} | {"x" * 5000, "aaaaaaaa", "aaaaaaa", "ab" * 9, "ba" * 9}
    asked = sorted(words)[::7] + ["aaaaaa", "x" * 4999, "zz"]
    dictionary = spark.createDataFrame([(w,) for w in sorted(words)] + [("",), (None,), ("aaaaaaaa",)], "term string")
    found = text_index.near_terms(spark.createDataFrame([(w,) for w in asked] + [(None,), ("",)], "asked string"), text_index.neighbourhoods(dictionary))
    allowed = lambda w: 0 if len(w) <= 2 else 1 if len(w) <= 5 else 2
    short = [w for w in words if len(w) < 50]
    want = {(a, w, edits(a, w)) for a in asked for w in short if abs(len(a) - len(w)) <= 2 and edits(a, w) <= allowed(a)}
    want |= {(a, "x" * 5000, 5000 - len(a)) for a in asked if len(a) > 50}
    rows = [(r.asked, r.term, r.edits) for r in found.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want


TEXTS = [(1, "Red Rings", "the Hoppers"), (2, "Red ring ring", None), (3, None, "red"), (4, "", ""), (5, "Bläue Ringe", "Ring-Hopping!"), (6, "Red", "ringed red ring")]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    rows = spark.createDataFrame(TEXTS, "id long, name string, artists string")
    return TextIndex.build(rows, "id", {"name": 2.0, "artists": 1.0}, f"file://{tmp_path_factory.mktemp('index')}/i")


def plain_scores(query: list[str]) -> dict[int, float]:
    stem = lambda w: STEMS.get(w, {"rings": "ring", "ringed": "ring", "hoppers": "hopper", "hopping": "hop"}.get(w, w))
    bags = {}
    for i, name, artists in TEXTS:
        bag = Counter()
        for text, weight in ((name, 2.0), (artists, 1.0)):
            for w in re.findall("[a-z0-9]+", (text or "").lower().replace("ä", "a")):
                bag[stem(w)] += weight
        bags[i] = bag
    mean = sum(sum(b.values()) for b in bags.values()) / len(bags)
    out = {}
    for i, bag in bags.items():
        if all(t in bag for t in query):
            out[i] = 0.0
            for t in query:
                df = sum(t in b for b in bags.values())
                out[i] += math.log(1 + (len(bags) - df + 0.5) / (df + 0.5)) * bag[t] * 2.2 / (bag[t] + 1.2 * (0.25 + 0.75 * sum(bag.values()) / mean))
    return out


def test_scores_equal_plain_bm25(index):
    for text, terms in (("RING", ["ring"]), ("the red rings", ["the", "red", "ring"]), ("red, red ring", ["red", "ring"]), ("rings hopping", ["ring", "hop"])):
        found = {r.key: r.score for r in index.search(text, 10).collect()}
        assert found == pytest.approx(plain_scores(terms)), text
    best = [r.key for r in index.search("ring red", 2).collect()]
    assert best == [k for k, _ in sorted(plain_scores(["ring", "red"]).items(), key=lambda x: (-x[1], x[0]))][:2]


def test_searches_without_terms_or_hits(index):
    assert index.search("", 5).collect() == [] and index.search("??", 5).collect() == [] and index.search("absent red", 5).collect() == []
    assert {r.key for r in index.search("absent red", 5, need_all=False).collect()} == {1, 2, 3, 6}


def test_fuzzy_search_counts_edits(index):
    found = index.search("hoppper", 5, fuzzy=True).collect()
    exact = index.search("hopper", 5).collect()
    assert [r.key for r in found] == [1] and found[0].score == pytest.approx(exact[0].score * (1 - 1 / 6))


def test_many_searches_equal_single_ones(spark, index):
    texts = {1: "red ring", 2: "hopping", 3: "", 4: None, 5: "ring"}
    many = index.search_many(spark.createDataFrame(list(texts.items()), "query_id long, text string"), 2).collect()
    for q, text in texts.items():
        assert [(r.key, r.score) for r in sorted(many, key=lambda r: r["rank"]) if r.query_id == q] == [(r.key, r.score) for r in index.search(text or "", 2).collect()]


def test_a_search_reads_the_shards_and_terms_that_it_asks_for(index):
    plan = index.search("red rings", 3)._jdf.queryExecution().toString()
    scans = [line for line in plan.splitlines() if "FileScan parquet" in line and "postings" in line]
    assert scans and all("PartitionFilters: [" in s and "shard#" in s.split("PartitionFilters: [")[1].split("]")[0] and "In(term" in s for s in scans)


def test_exact_searches_need_no_neighbourhoods_and_many_shuffle_postings_alone(spark, tmp_path, monkeypatch):
    """Several files a shard and few pairs a task give the same rows; hits are added up without a shuffle of their own."""
    rows = spark.createDataFrame(TEXTS + [(k, f"red ring {k % 7}", "hop " * (k % 4)) for k in range(10, 200)], "id long, name string, artists string")
    queries = spark.createDataFrame([(1, "red rings"), (2, "hopping 3 ring"), (3, "zzz")], "query_id long, text string")
    plain = TextIndex.build(rows, "id", {"name": 2.0, "artists": 1.0}, f"file://{tmp_path}/a")
    want = sorted(plain.search_many(queries, 5, need_all=False).collect())
    monkeypatch.setattr(text_index, "POSTINGS", 10)
    monkeypatch.setattr(text_index, "PAIRS", 50)
    spread = TextIndex.build(rows, "id", {"name": 2.0, "artists": 1.0}, f"file://{tmp_path}/b", fuzzy=False)
    found = spread.search_many(queries, 5, need_all=False)
    assert sorted(found.collect()) == want and len(want) == 10
    assert not (tmp_path / "b" / "near").exists() and (tmp_path / "a" / "near").exists()
    plan = found._jdf.queryExecution().executedPlan().toString()
    final = plan[: plan.index("Initial Plan")]
    assert final.count("hashpartitioning(key#") == 1 and "hashpartitioning(query_id#" in final and final.count("Exchange hashpartitioning") == 3


def test_compared_terms_equal_near_terms(spark):
    rng = random.Random(5)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 11))) for _ in range(400)} | {"aaaaaaaa", "aaaaaaa", "ab" * 9, "x" * 5000})
    dictionary = spark.createDataFrame([(w, 1) for w in words], "term string, df long")
    asked = spark.createDataFrame([(w,) for w in [*words[::40], "aaaaaa", "x" * 4999, "zz", "zzzzzz", "", None, "aaaaaa"]], "asked string")
    found = sorted(text_index.compared_terms(asked, dictionary).collect())
    assert found == sorted(text_index.near_terms(asked, text_index.neighbourhoods(dictionary)).collect()) and len(found) > 40


def test_a_fuzzy_search_reads_the_dictionary_and_no_neighbourhoods(spark, tmp_path, index):
    """An index without neighbourhoods gives the rows of one with them; its size comes from the postings."""
    rows = spark.createDataFrame(TEXTS + [(100, None, None), (101, "", "?")], "id long, name string, artists string")
    plain = TextIndex.build(rows, "id", {"name": 2.0, "artists": 1.0}, f"file://{tmp_path}/plain", fuzzy=False)
    full = TextIndex.build(rows, "id", {"name": 2.0, "artists": 1.0}, f"file://{tmp_path}/full")
    words = [2.0 * len(re.findall(r"\w+", n or "")) + len(re.findall(r"\w+", a or "")) for _, n, a in TEXTS]
    assert plain.stats["n"] == len(TEXTS) + 2 and plain.stats["mean"] == pytest.approx(sum(words) / (len(TEXTS) + 2))
    for text in ("hoppper", "rad rngs, hoping", "zzzzzz", ""):
        found = plain.search(text, 5, need_all=False, fuzzy=True).collect()
        assert found == full.search(text, 5, need_all=False, fuzzy=True).collect()
    assert len(plain.search("rad rngs, hoping", 5, need_all=False, fuzzy=True).collect()) == 5


def test_a_search_leaves_postings_where_they_lie(spark, index):
    """Hits are added up by text; no term's postings go to one task, however large Spark takes the tables to be."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = index.search("red rings", 3)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    lines = plan.splitlines()
    scan = next(k for k, line in enumerate(lines) if "FileScan parquet" in line and "postings" in line)
    above = next(line for line in reversed(lines[:scan]) if "Join" in line or "Exchange" in line)
    assert "BroadcastHashJoin" in above
