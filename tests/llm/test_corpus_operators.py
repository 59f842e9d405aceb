"""The corpus operators against brute force, exact round trips and held-out accuracy, and on awkward tables."""

from __future__ import annotations

import hashlib
import random
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cataloom.llm import bpe, decontaminate, embedding_dedup, html_crf, jaccard_join, language_id, sharding, storage, suffix_dedup, toxicity, url_filter
from cataloom.llm.graph import components, numbered
from cataloom.llm.queries import URL_RULES, tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng: random.Random, n: int, size: int = 400) -> str:
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


def corpus() -> list[tuple]:
    """Copies, near copies, shared passages, empty, short and long texts, nulls, repeated rows."""
    rng = random.Random(3)
    base = [words(rng, rng.randint(30, 160)) for _ in range(30)]
    passage = words(rng, 40)
    texts = list(base)
    texts += [base[k] for k in (0, 0, 1)]
    for k in range(12):
        some = base[2].split()
        some[k * 2 % len(some)] = f"changed{k}"
        texts.append(" ".join(some))
    texts += [base[k] + " " + passage for k in range(5, 12)]
    texts += ["", None, "one two three", "one two three", "ein Wort", "x" * 3000, "ab" * 700, "é" * 300, words(rng, 6000), " \n\t "]
    return [(k, t, random.Random(k).choice(["en", "fr", None]), f"s{k % 3}", len(t or "")) for k, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS)


@pytest.fixture(scope="module")
def odd_docs(spark):
    """Null ids, repeated ids and rows, and extra columns whose names the operators use inside."""
    rows = corpus()[:12] + corpus()[:3] + [(4, "another text with the same id as an earlier one", None, None, None), (None, "a text without an id, but with words", "en", "s", 1), (None, None, None, None, None)]
    extra = spark.createDataFrame(rows, DOCS)
    return extra.withColumns({c: F.lit(7) for c in ("id", "row", "n", "path", "given", "carried", "label", "score", "rep", "__leak", "__gone", "ids", "shard")})


# n-gram Jaccard join


def shingle_sets(rows):
    out = {}
    for i, text, *_ in rows:
        tokens = "".join(c.lower() if c.isalnum() else " " for c in text or "").split()
        out[i] = {tuple(tokens[k : k + 5]) for k in range(max(1, len(tokens) - 4))} if tokens else set()
    return out


def test_jaccard_join_finds_every_link(docs):
    sets = shingle_sets(corpus())
    found = {r.id: r for r in jaccard_join.near_texts(docs).collect()}
    assert len(found) == len(sets)
    links = {i: {j for j in sets if j != i and sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])} for i in sets}
    assert {i: r.n_links for i, r in found.items()} == {i: len(x) for i, x in links.items()}
    for i in sets:
        reach, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - reach:
                reach.add(j)
                todo.append(j)
        assert found[i].component_id == min(reach) and found[i].kept == (i == min(reach))


def test_jaccard_join_large_buckets(spark, monkeypatch):
    """A group of near copies larger than a bucket and a block."""
    monkeypatch.setattr(jaccard_join, "SMALL", 8)
    monkeypatch.setattr(jaccard_join, "BLOCK", 16)
    rng = random.Random(5)
    base = words(rng, 200).split()
    rows = []
    for k in range(60):
        some = list(base)
        some[rng.randrange(200)] = f"new{k}"
        rows.append((k, " ".join(some)))
    sets = shingle_sets(rows)
    found = {r.id: r.n_links for r in jaccard_join.near_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {i: sum(j != i and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) for j in sets) for i in sets}


def test_sketches_tell_near_copies_from_texts_with_a_passage_in_common():
    rng = np.random.default_rng(3)
    base = rng.integers(1, 1 << 62, 400).astype(np.uint64)

    def sketches(own: int, copies: int) -> np.ndarray:
        sets = [np.sort(np.concatenate([base[: 400 - own], rng.integers(1, 1 << 62, own).astype(np.uint64)])) for _ in range(copies)]
        return jaccard_join.sketch(np.repeat(np.arange(copies), 400), np.concatenate(sets), copies)

    assert jaccard_join.keeps_together(sketches(20, 32), 0.8)
    assert jaccard_join.keeps_together(sketches(40, 32), 0.8)  # coefficient 0.82
    assert not jaccard_join.keeps_together(sketches(300, 32), 0.8)
    assert not jaccard_join.keeps_together(np.concatenate([sketches(20, 12), sketches(390, 20)]), 0.8)
    assert not jaccard_join.keeps_together(sketches(20, 1), 0.8)


def test_jaccard_join_loses_no_link_of_a_large_group(spark):
    """300 different near copies of one text, most pairs near the threshold: every link is counted."""
    rng = np.random.default_rng(18)
    base = [f"w{x}" for x in rng.integers(0, 5000, 400)]
    rows = []
    for k in range(300):
        some = list(base)
        for at in rng.choice(400, 4, replace=False):
            some[at] = f"new{k}x{at}"
        rows.append((k, " ".join(some)))
    sets = shingle_sets(rows)
    names = {t: i for i, t in enumerate(sorted(set().union(*sets.values())))}
    one = np.zeros((300, len(names)), np.float32)
    for k, tokens in sets.items():
        one[k, [names[t] for t in tokens]] = 1
    common, n = one @ one.T, one.sum(axis=1)
    linked = common >= 0.8 * (n[:, None] + n[None] - common) - 1e-6
    found = {r.id: r.n_links for r in jaccard_join.near_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    lost = sum(int(linked[k].sum()) - 1 - found[k] for k in range(300))
    assert lost == 0 and found == {k: int(linked[k].sum()) - 1 for k in range(300)}, lost


def test_keep_one_keeps_one_of_a_group_and_all_columns(docs, odd_docs):
    kept = jaccard_join.keep_one(docs)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert {0, 1, 2} <= ids and not ids & {30, 31, 32, *range(33, 45)}
    odd = jaccard_join.keep_one(odd_docs)
    assert odd.columns == odd_docs.columns and odd.where("doc_id = 0").count() == 1 and odd.where("doc_id is null").count() == 2


# Suffix-array dedup


def removed_brute(rows, match):
    seen, out = set(), {}
    for i, text in sorted(rows):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for k in range(len(data) - match + 1):
            part = data[k : k + match]
            if part in seen:
                gone[k : k + match] = b"\1" * match
            seen.add(part)
        kept = bytes(x for x, g in zip(data, gone) if not g)
        out[i] = (len(data), sum(gone), sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone)), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize(("match", "shard"), [(100, 32_768), (100, 1), (12, 4)])
def test_suffix_dedup_equals_brute_force(docs, monkeypatch, match, shard):
    monkeypatch.setattr(suffix_dedup, "SHARD_SEGMENTS", shard)
    rows = [r for r in corpus() if len(r[1] or "") < 4000]
    some = docs.where("length(coalesce(text, '')) < 4000")
    got = {r.id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(some, match).collect()}
    assert got == removed_brute([(r[0], r[1]) for r in rows], match)


def test_suffix_order_and_common_prefixes():
    rng = np.random.default_rng(1)
    text = rng.integers(97, 99, 400).astype(np.uint8)
    wanted = np.arange(380)
    raw = text.tobytes()
    order = suffix_dedup.suffix_order(text, 20, wanted)
    parts = [raw[k : k + 20] for k in order]
    assert parts == sorted(parts) and sorted(order.tolist()) == wanted.tolist()
    prefix = suffix_dedup.common_prefixes(text, order, np.array([0]), np.array([380]), 20)
    for k in range(1, 380):
        same = next((m for m in range(20) if parts[k][m] != parts[k - 1][m]), 20)
        assert prefix[k] == same


def test_suffix_dedup_odd_rows(odd_docs):
    got = suffix_dedup.remove_repeats(odd_docs, carry=["lang"])
    assert got.columns[-1] == "lang" and got.count() == odd_docs.count()
    twice = [r for r in got.collect() if r.id == 0]
    assert len(twice) == 2 and twice[0] == twice[1] and twice[0].n_removed == 0


def test_suffix_dedup_of_a_line_in_many_contexts(spark, monkeypatch):
    """Strings around a common line get finer anchors; hardly any of them is merged one by one."""
    monkeypatch.setattr(suffix_dedup, "SHARD_SEGMENTS", 16)
    monkeypatch.setattr(suffix_dedup, "SAMPLED", 1)
    rng = random.Random(9)
    line = "the line that stands in very many texts, of eighty bytes or so, as notices stand"
    ends = [words(rng, 6) for _ in range(5)]
    texts = [f"{words(rng, 25)} {line} {words(rng, 25)}" for _ in range(150)]
    texts += [f"{words(rng, 25)} {line} {ends[k % 5]} {words(rng, 20)}" for k in range(30)]
    texts += [f"{words(rng, 25)}{ends[k % 5]} {line} {words(rng, 25)} {ends[k % 5]} {line}{words(rng, 25)}" for k in range(20)]
    texts += [f"{words(rng, 12)} {line} {line} {line} {words(rng, 12)}" for _ in range(10)] + texts[:3]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(docs).collect()}
    assert got == removed_brute(rows, 100) and sum(r[1] for r in got.values()) > 5_000
    table = [x for x in storage._written[spark.sparkContext.applicationId] if "/suffixes-" in x][-1]
    assert spark.read.parquet(table).where("w1 is not null").count() < 2_000


def test_segments_of_crowded_anchors_hold_the_same_strings():
    rng = random.Random(5)
    for match in (100, 12, 5):
        texts = [" ".join(rng.choice(["ab", "cd", "efg", "hi"]) for _ in range(rng.randint(0, 150))).encode() for _ in range(20)]
        texts += [t[:k] + b"a line that stands everywhere, long enough for an anchor" + t[k:] for k, t in enumerate(texts)]
        data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0] + [len(t) for t in texts])
        crowded = np.unique(suffix_dedup.segments(data, offsets, match)[1].view(np.uint64))[::2]
        strings, contents, names = [], {}, {}
        for row, anchor, segment, place, first, last in zip(*(x.tolist() for x in suffix_dedup.segments(data, offsets, match, crowded))):
            strings += [(row, s) for s in range(first, last + 1)]
            content = (texts[row][first : last + match], place - first)
            assert contents.setdefault((anchor, segment), content) == content
            for s in range(first, last + 1):
                assert names.setdefault(texts[row][s : s + match], (anchor, place - s)) == (anchor, place - s)
        assert strings == [(k, s) for k, t in enumerate(texts) for s in range(len(t) - match + 1)]


def test_shards_are_merged_in_time_that_follows_the_strings():
    rng = np.random.default_rng(3)
    schema = pa.schema([("id", pa.int64()), ("from", pa.int32()), ("to", pa.int32())])

    def strings(parts: int) -> tuple[pa.Table, float]:
        own = np.concatenate([rng.choice(60_000, 60_000 // parts, replace=False) for _ in range(parts)])
        w1 = own // 3  # three strings with one first hash
        place = rng.permutation(len(own))
        return pa.table({"id": place // 100, "from": (place % 100).astype(np.int32), "to": (place % 100 + 100).astype(np.int32), "w1": w1, "w2": own % 3, "part": np.repeat(np.arange(parts), 60_000 // parts).astype(np.int32)})

    took = {}
    for parts in (2, 2, 500):
        table = strings(parts)
        began = time.perf_counter()
        got = suffix_dedup.merged(table, schema)
        took[parts] = time.perf_counter() - began
        frame = table.to_pandas()
        later = frame[frame.sort_values(["id", "from"]).duplicated(["w1", "w2"]).reindex(frame.index)]
        assert sorted(zip(got["id"].to_pylist(), got["from"].to_pylist())) == sorted(zip(later["id"], later["from"]))
    assert took[500] < 30 * took[2]


# Benchmark decontamination


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for x in a:
        last, row[0] = row[0], row[0] + 1
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(last + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]


def least_fit(item, region):
    """Least edit distance of an item to any stretch of a region, by the plain recurrence."""
    row = [0] * (len(region) + 1)
    for i, x in enumerate(item, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(region, 1):
            last, row[j] = row[j], min(last + (x != y), row[j] + 1, row[j - 1] + 1)
    return min(row)


def test_fit_distances_are_exact():
    rng = random.Random(2)
    for m in range(1, 8):
        items = [[rng.randrange(1, 5) for _ in range(m)] for _ in range(12)]
        regions = [[rng.randrange(1, 5) for _ in range(rng.randint(1, 12))] for _ in range(12)]
        padded = np.array([r + [0] * (12 - len(r)) for r in regions], np.uint64)
        for item, region, cost, a, b in zip(items, regions, *decontaminate.fit_distances(np.array(items, np.uint64), padded)):
            best = min(edit_distance(item, region[i:j]) for i in range(len(region) + 1) for j in range(i, len(region) + 1))
            assert cost == best == edit_distance(item, region[a:b]) == least_fit(item, region) and b <= len(region)


def edited(rng, item, edits, fresh):
    part = list(item)
    for _ in range(edits):
        at = rng.randrange(len(part)) if part else 0
        gone, new = rng.choice([(1, 1), (1, 0), (0, 1)])
        part[at : at + gone] = [fresh()] * new
    return part


def test_leaks_equal_a_search_of_all_places(spark):
    """Every (document, item) that a plain alignment of all documents with all items finds, with its distance: items of 1 to
    70 words, with shared stems, without spaces; passages whole, edited, trimmed, at the ends, alone, in long texts."""
    rng = random.Random(14)
    common = [f"w{x}" for x in range(120)]
    fresh = lambda: f"x{rng.randrange(10**9)}"
    stem = "what is the value of".split()
    items = [[rng.choice(common) for _ in range(rng.randint(9, 70))] for _ in range(40)]
    items += [stem + [rng.choice(common) for _ in range(rng.randint(3, 12))] for _ in range(40)] + [[fresh() for _ in range(n)] for n in (1, 2, 3, 4, 5, 6, 7, 8)]
    docs = []
    for k in range(260):
        text = [rng.choice(common) if rng.random() < 0.6 else fresh() for _ in range(rng.choice([0, 0, 20, 150, 600]))]
        item = items[k % len(items)]
        part = edited(rng, item, rng.randint(0, int(0.2 * len(item)) + 1), fresh)
        if k % 5 == 0:
            cut = rng.randint(0, int(0.2 * len(item)))
            part = item[cut : len(item) - (int(0.2 * len(item)) - cut)]
        at = rng.choice([0, len(text), rng.randint(0, len(text))])
        docs.append(text[:at] + part + text[at:])
    wanted = {}
    for d, text in enumerate(docs):
        for i, item in enumerate(items):
            if set(item) & set(text) and (cost := least_fit(item, text)) <= int(0.2 * len(item)):
                wanted[d, i] = cost
    chinese = "今天天气很好我们去公园散步然后回家吃晚饭看电视"
    rows = [(d, " ".join(t)) for d, t in enumerate(docs)] + [(900, "前言。" + chinese.replace("公园", "海边") + "。后记"), (901, None), (902, "")]
    given = [(i, " ".join(t)) for i, t in enumerate(items)] + [(900, chinese), (901, None), (902, " . "), (903, "")]
    found = decontaminate.find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(given, "item_id long, text string")).collect()
    got = {(r.id, r.item_id): r.edits for r in found}
    assert len(got) == len(found) and got.pop((900, 900)) == 2
    assert got.keys() <= wanted.keys() and all(wanted[k] == v for k, v in got.items())
    assert len(wanted) > 200 and len(got) >= 0.99 * len(wanted), set(wanted) - set(got)


def test_many_items_with_one_stem():
    """A document full of one stem against thousands of items that begin with it: memory and time stay bounded."""
    import time

    rng = random.Random(15)
    stem = [rng.randrange(1, 2**62) for _ in range(5)]
    pool = [rng.randrange(1, 2**62) for _ in range(3000)]
    items = [np.array(stem + [rng.choice(pool) for _ in range(rng.randint(10, 20))], np.uint64) for _ in range(2000)]
    text = []
    for _ in range(300):
        text += stem + [rng.choice(pool) for _ in range(15)]
    text[100:100] = items[7].tolist()
    table = decontaminate.Items(list(range(len(items))), items, 0.8)
    start = time.process_time()
    found = table.search(np.array(text, np.uint64), np.zeros(len(text), np.int64), np.array([0]), np.array([len(text)]))
    assert [(x[1], x[2]) for x in found] == [(7, 0)] and time.process_time() - start < 10


def test_leaks_exact_and_edited(spark):
    rng = random.Random(4)
    items = [(k, words(rng, rng.randint(12, 50), 2000)) for k in range(12)] + [(90, None), (91, "unseen"), (3, None)]
    rows, planted = [], set()
    for k in range(60):
        text = words(rng, 120, 2000).split()
        if k % 3 == 0:
            item = items[k % 12]
            part = item[1].split()
            for _ in range(int(0.2 * len(part)) if k % 2 else 0):
                at = rng.randrange(len(part))
                if rng.random() < 0.5:
                    part[at] = "edited"
                elif len(part) > 6:
                    del part[at]
            if edit_distance(item[1].split(), part) <= int(0.2 * len(item[1].split())):
                planted.add((k, item[0]))
                text[40:40] = part
        rows.append((k, " ".join(text)))
    rows += [(100, None), (101, ""), (102, items[0][1])]
    planted.add((102, 0))
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    leaks = decontaminate.find_leaks(docs, bench).collect()
    found = {(r.id, r.item_id) for r in leaks}
    assert found == planted
    whole = next(r for r in leaks if r.id == 102)
    assert (whole.edits, whole.from_byte, whole.to_byte) == (0, 0, len(items[0][1]))
    left = {r.doc_id for r in decontaminate.drop_contaminated(docs, bench).collect()}
    assert left == {r[0] for r in rows} - {d for d, _ in found}


def test_leaks_of_an_item_trimmed_at_both_ends():
    """The trimmed item is a whole document between two others of one block."""
    rng = random.Random(6)
    item = np.array([rng.randrange(1, 2**62) for _ in range(50)], np.uint64)
    for a, b in ((0, 50), (2, 47), (0, 45), (5, 50)):
        parts = [np.arange(1, 81, dtype=np.uint64), item[a:b], np.arange(100, 180, dtype=np.uint64)]
        edge = np.cumsum([0, *map(len, parts)])
        rows = np.repeat(np.arange(3), np.diff(edge))
        found = decontaminate.Items([7], [item], 0.8).search(np.concatenate(parts), rows, edge[:-1], edge[1:])
        assert found == [(1, 0, 50 - (b - a), int(edge[1]), int(edge[2]))]


@pytest.mark.parametrize("size", [5, 6, 8, 9, 10, 11, 14, 15, 17, 21, 25, 32, 39, 47, 59, 80, 100, 200, 400])
def test_leaks_of_all_sizes(size):
    """Items with every permitted edit, replaced, dropped and added words: the target recall holds at each size."""
    rng = random.Random(size)
    fresh = lambda: rng.randrange(1, 2**62)
    items = [[fresh() for _ in range(size)] for _ in range(200)]
    parts = [[fresh() for _ in range(50)] + edited(rng, item, decontaminate.edits_of(size, 0.8), fresh) + [fresh() for _ in range(50)] for item in items]
    edge = np.cumsum([0, *map(len, parts)])
    hashes = np.array([x for part in parts for x in part], np.uint64)
    found = decontaminate.Items(list(range(200)), [np.array(x, np.uint64) for x in items], 0.8).search(hashes, np.repeat(np.arange(200), np.diff(edge)), edge[:-1], edge[1:])
    assert all(x[0] == x[1] for x in found) and len(found) >= 197, len(found)


def test_leaks_in_passes(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "PASS_WORDS", 20)
    items = [(k, words(random.Random(k), 15)) for k in range(3)]
    found = decontaminate.find_leaks(spark.createDataFrame([(k, t) for k, t in items], "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.id, r.item_id) for r in found.collect()} == {(0, 0), (1, 1), (2, 2)}


# Language identification


def gram_counts(texts):
    """Counts of 4-grams and 3-grams of each language's texts, as ``build`` takes them."""
    out = ([], [], [])
    for lang, some in texts.items():
        for text in some:
            data = np.frombuffer(text.encode(), np.uint8)
            value, n = np.unique(language_id.grams(data, np.array([0, len(data)])), return_counts=True)
            out[0].extend([lang] * len(value))
            out[1].extend(value.tolist())
            out[2].extend(n.tolist())
    four = (out[0], np.array(out[1], np.int64), np.array(out[2]))
    return four, (four[0], four[1] & 0xFFFFFF, four[2])


class PlainPPM:
    """PPM of order 3, method C with exclusion, worked out byte by byte from dictionaries."""

    def __init__(self, texts):
        self.counts = {}
        for text in texts:
            data = b"   " + text.encode()
            for i in range(3, len(data)):
                for order in range(4):
                    seen = self.counts.setdefault(data[i - order : i], {})
                    seen[data[i]] = seen.get(data[i], 0) + 1
        self.memo = {}

    def probability(self, context, symbol):
        if (context, symbol) not in self.memo:
            self.memo[context, symbol] = self.work_out(context, symbol)
        return self.memo[context, symbol]

    def work_out(self, context, symbol):
        shorter = (lambda s: self.probability(context[1:], s)) if context else (lambda s: 1 / 256)
        seen = self.counts.get(context)
        if not seen:
            return shorter(symbol)
        total, distinct = sum(seen.values()), len(seen)
        rest = 1 - sum(map(shorter, seen))
        if symbol in seen:
            return seen[symbol] / (total + distinct if rest > 1e-9 else total)
        return distinct / (total + distinct) * shorter(symbol) / max(rest, 1e-9)

    def length(self, text):
        data = b"   " + text.encode()
        return sum(-np.log2(self.probability(data[i - 3 : i], data[i])) for i in range(3, len(data)))


def test_code_lengths_equal_plain_ppm():
    """Whole texts, every byte: sums of table entries equal the code lengths of the plain recursion."""
    rng = random.Random(2)
    alphabet = {"a": "abcde  fé,1", "b": "klmno  pß.2", "c": "abklx  中-3"}
    texts = {lang: ["".join(rng.choice(some) for _ in range(rng.randint(1, 400))) for _ in range(12)] for lang, some in alphabet.items()}
    texts["d"] = ["banana bandana"]
    model = language_id.build(*gram_counts(texts))
    probes = [x[0] for x in texts.values()] + ["".join(rng.choice("abcklm xyz é中12.") for _ in range(300)) for _ in range(5)] + ["", "Z"]
    raw = [t.encode() for t in probes]
    got = language_id.code_lengths(model, np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    for k, lang in enumerate(model.languages):
        plain = PlainPPM(texts[lang])
        for j, text in enumerate(probes):
            assert abs(got[j, k] / language_id.UNIT - plain.length(text)) <= 0.003 * len(raw[j]) + 1e-6


def test_two_hundred_languages_keep_order_three():
    rng = random.Random(3)
    texts = {f"l{k:03d}": [" ".join(f"{rng.choice('bcdfgklmnprst')}{chr(97 + k % 26)}{chr(97 + k // 26)}{rng.choice('aeiou')}" for _ in range(60))] for k in range(200)}
    model = language_id.build(*gram_counts(texts))
    assert len(model.seen[2].values) == sum(len(set(zip(b"   " + t.encode(), b"  " + t.encode(), b" " + t.encode(), t.encode()))) for (t,) in texts.values())
    names = rng.sample(sorted(texts), 40)
    raw = [texts[x][0][:80].encode() for x in names]
    lengths = language_id.code_lengths(model, np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    assert [model.languages[k] for k in lengths.argmin(axis=1)] == names


def test_large_models_keep_frequent_contexts(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    whole = language_id.train(docs)
    monkeypatch.setattr(language_id, "MOST_ENTRIES", len(whole.seen[2].values) // 2)
    half = language_id.train(docs)
    assert 0.2 * len(whole.seen[2].values) < len(half.seen[2].values) <= 0.5 * len(whole.seen[2].values)
    assert all((a.values == b.values).all() for a, b in zip(whole.seen[:2], half.seen[:2]))
    same = language_id.predict(docs, whole).join(language_id.predict(docs, half).select("id", F.col("lang_pred").alias("other")), "id")
    assert same.where("lang_pred = other").count() >= 0.97 * docs.count()


def test_language_held_out(spark, odd_docs):
    path = "/root/testdata/sf0.01/documents.parquet"
    docs = spark.read.parquet(path)
    model = language_id.train(docs.where("doc_id % 4 != 2"))
    held = docs.where("doc_id % 4 = 2")
    out = language_id.predict(held, model).join(held.select(F.col("doc_id").alias("id"), "lang"), "id")
    assert out.where("lang = lang_pred").count() >= 0.98 * out.count()
    odd = language_id.predict(odd_docs, model)
    assert odd.count() == odd_docs.count() and {r.lang_pred for r in odd.where("id is null").collect()} > {"und"}
    assert {r.lang_pred for r in language_id.predict(odd_docs, None).collect()} == {"und"}
    quiet = language_id.predict(spark.createDataFrame([(1, "123 - 456"), (2, ""), (3, None), (4, "Ж")], "doc_id long, text string"), model).collect()
    assert [r.lang_pred == "und" and r.score == 0 for r in quiet] == [True, True, True, False]


# HTML extraction


def test_extraction_on_unseen_labelled_pages():
    field = html_crf.trained_field()
    wrong = total = 0
    for page, wanted in html_crf.labelled_pages(120, seed=1234):
        blocks = html_crf.leaf_blocks(page)
        labels = html_crf.block_labels(blocks, wanted)
        assert sum(labels) == len(wanted)
        wrong += sum(a != b for a, b in zip(labels, field.decode(blocks)))
        total += len(labels)
    assert wrong <= 0.01 * total


# Pages written and labelled by hand: the article's blocks.
HAND_LABELLED = [
    ("""<!DOCTYPE html><html><head><title>T | Site</title><script>var a="<p>no</p>"</script></head><body>
<div id="page"><div class="topbar"><a href="/">Home</a> | <a href="/about">About</a> | <a href="/contact">Contact</a></div>
<div id="main-content"><h1 class="entry-title">River walks reopen after the flood</h1>
<p class="lead">The paths along the river will reopen on Saturday, the council said.</p>
<p>Repairs took <em>six weeks</em> and cost less than feared.<br>Volunteers cleared most of the debris.</p>
<div class="ad-slot"><p>Buy one, get one free at our partner shop today.</p></div>
<h2>What changes</h2><ul><li>Dogs must be kept on a lead.</li><li>Bikes use the upper path.</li></ul></div>
<div class="comments"><h3>2 comments</h3><div class="comment"><p>Great news, I missed the walk.</p></div><div class="comment"><p>About time they did this.</p></div></div>
<div id="footer"><p>&copy; 2024 The Valley Paper. All rights reserved.</p></div></div></body></html>""",
["River walks reopen after the flood","The paths along the river will reopen on Saturday, the council said.","Repairs took six weeks and cost less than feared. Volunteers cleared most of the debris.","What changes","Dogs must be kept on a lead.","Bikes use the upper path."]),
    ("""<html><body><header><nav><ul><li><a href=/a>News</a><li><a href=/b>Sport</a></ul></nav></header><main><article><header><h1>How to prune roses</h1></header>
<section><p>Prune in late winter, before buds open.</p><p>Cut just above an outward bud; sterilise the blade first.</p><blockquote><p>A sharp blade makes a clean cut.</p></blockquote></section>
<aside><h4>Related</h4><ul><li><a href=/x>Feeding roses</a></ul></aside><section><h2>After care</h2><p>Water well &amp; mulch.</p></section></article></main>
<form action=/subscribe><label>E-mail</label><input name=e><button>Join</button></form><footer>Imprint | Privacy</footer></body></html>""",
["How to prune roses","Prune in late winter, before buds open.","Cut just above an outward bud; sterilise the blade first.","A sharp blade makes a clean cut.","After care","Water well & mulch."]),
    ("""<html><body><div class="cookie-banner"><p>We use cookies to improve your visit.</p><button>Accept</button></div><table class="menu"><tr><td><a href=1>Start</a></td><td><a href=2>Archive</a></td></tr></table>
<div class="post"><h2>Notes on sourdough</h2><p>Flour, water and salt are all you need.</p><p>Let the dough rest for an hour, then fold it four times.</p><table><tr><td>Flour</td><td>500 g</td></tr></table><p>Bake at 240 degrees.</p></div>
<div class="sidebar"><h3>Popular</h3><p>Our ten most read recipes of the year.</p></div><div class="footer"><p>Contact us at the usual address.</p></div></body></html>""",
["Notes on sourdough","Flour, water and salt are all you need.","Let the dough rest for an hour, then fold it four times.","Flour","500 g","Bake at 240 degrees."]),
    ("""<html><body><p>An old page without any structure has only paragraphs.</p><p>Its second paragraph follows here, and it is plain.</p><hr><p>And a third one ends it.</p></body></html>""",
["An old page without any structure has only paragraphs.","Its second paragraph follows here, and it is plain.","And a third one ends it."]),
]


@pytest.mark.parametrize("page", range(len(HAND_LABELLED)))
def test_extraction_on_hand_labelled_pages(page):
    field = html_crf.trained_field()
    blocks = html_crf.leaf_blocks(HAND_LABELLED[page][0])
    assert [b[1] for b, y in zip(blocks, field.decode(blocks)) if y] == HAND_LABELLED[page][1]


def test_extraction_on_layouts_left_out_of_training():
    """Each kind of article element is held out once: a field trained without it still finds most of such articles."""
    pages = html_crf.labelled_pages(700, seed=21)
    for mark in ("<main", "<div class=\"comments", "<blockquote"):
        held = [p for p in pages if mark in p[0]][:80]
        field = html_crf.train([p for p in pages if mark not in p[0]][:300], rounds=120, ridge=1e-5)
        wrong = total = 0
        for page, wanted in held:
            blocks = html_crf.leaf_blocks(page)
            wrong += sum(a != b for a, b in zip(html_crf.block_labels(blocks, wanted), field.decode(blocks)))
            total += len(blocks)
        assert held and wrong <= 0.08 * total, (mark, wrong, total)


def test_parsing_takes_time_in_proportion():
    """Pages of a megabyte that nest deeply or leave tags, quotes and comments open."""
    import time

    field = html_crf.trained_field()
    pages = ["<a " * 350_000, "<div>x" * 100_000, "<div>x" * 50_000 + "</p>" * 50_000, "<b>" * 100_000 + "</i>" * 100_000 + "t", '<a "' * 200_000 + ">", "> <a '" * 200_000, "<!-- " * 200_000, "</" * 300_000, "<script>" * 100_000, "<span>x</p>" * 100_000, "<table><tr><td>" * 60_000, '<p ' + 'id="' * 200_000 + ">x"]
    for page in pages:
        start = time.process_time()
        blocks = html_crf.leaf_blocks(page)
        field.decode(blocks)
        assert time.process_time() - start < 20, page[:20]
    assert len(html_crf.leaf_blocks(pages[1])) == 100_000


def test_a_tag_cut_off_by_the_end_is_no_text():
    texts = lambda page: [b[1] for b in html_crf.leaf_blocks(page)]
    assert texts("<p>hello there</p><a hre") == ["hello there"] and texts('<p>one <b class="x') == ["one"] and texts("two</p") == ["two"] and texts("<p>z<a b </c d") == ["z"]
    assert texts("<p>1 < 2 and a <3") == ["1 < 2 and a <3"] and texts("<") == ["<"] and texts("<p>x</p>y <!-- z") == ["x", "y"]


def test_viterbi_is_the_best_path():
    field = html_crf.trained_field()
    page, _ = html_crf.labelled_pages(1, seed=8)[0]
    blocks = html_crf.leaf_blocks(page)[:9]

    def score(labels):
        total = field.ends[0][labels[0]] + field.ends[1][labels[-1]] + sum(field.unary(b) for b, y in zip(blocks, labels) if y)
        for k in range(1, len(labels)):
            total += field.edges[blocks[k][0] == blocks[k - 1][0] or blocks[k][0][:-1] == blocks[k - 1][0][:-1]][labels[k - 1]][labels[k]]
        return total

    every = [[(m >> k) & 1 for k in range(len(blocks))] for m in range(1 << len(blocks))]
    assert score(field.decode(blocks)) == pytest.approx(max(map(score, every)))


def test_pages_of_the_tables_and_awkward_pages(spark):
    article = "<nav><ul><li><a href=/>Menu</a></ul></nav><article><h1>A  title &amp; more</h1><p>First <b>bold</b> line.<br>Second.<p>Next &lt;one&gt;.</article><footer>&copy; us</footer>"
    rows = [(1, "u", article), (2, None, None), (3, "u", ""), (3, "u", ""), (None, "u", "<script>var t='</p>'"), (5, "u", "<p>" * 3000 + "deep"), (6, "u", "plain & text < 3 \x00 &am")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    out = html_crf.extract_text(pages, html_crf.trained_field()).collect()
    assert len(out) == len(rows)
    first = next(r for r in out if r.id == 1)
    assert first.text == "A title & more\nFirst bold line. Second.\nNext <one>." and first.n_chars == len(first.text)
    assert all(r.text == "" for r in out if r.id in (2, 3, None))
    real = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    texts = {r.id: r.text for r in html_crf.extract_text(real, html_crf.trained_field()).collect()}
    for r in real.collect():
        assert texts[r.page_id] and "track(" not in texts[r.page_id] and "©" not in texts[r.page_id]


# Toxicity


def test_toxicity_held_out_and_identity_terms(spark, odd_docs):
    rng = random.Random(9)
    rows, labels = [], []
    for k in range(500):
        bad = k % 4 == 0
        text = words(rng, 30, 300).split()
        if bad:
            text[rng.randrange(30)] = rng.choice(["idiot", "scum", "moron"])
        # In the labels one group is named more often in toxic texts: what the penalty is for.
        if rng.random() < (0.5 if bad else 0.1):
            text[rng.randrange(30)] = "muslims"
        rows.append((k, " ".join(text)))
        labels.append((k, int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    truth = spark.createDataFrame([*labels, (3, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.train(toxicity.labelled_sample(docs, truth.where("doc_id % 5 != 0")))
    out = {r.id: r for r in toxicity.score(docs, model).collect()}
    held = [k for k in range(500) if k % 5 == 0]
    assert sum(out[k].predicted == labels[k][1] for k in held) >= 0.95 * len(held)
    probe = spark.createDataFrame([(1, "w1 w2 women w3"), (2, "w1 w2 muslims w3"), (3, "w1 w2 w3"), (4, None), (5, "")], "doc_id long, text string")
    scores = {r.id: r.score for r in toxicity.score(probe, model).collect()}
    assert abs(scores[1] - scores[2]) < 0.1 and scores[2] < 0.5 and scores[4] == scores[5]
    kept = toxicity.keep_accepted(odd_docs, model)
    assert kept.columns == odd_docs.columns and kept.count() == odd_docs.count()
    assert toxicity.train(toxicity.labelled_sample(docs, truth.where("false"))) is None


def test_swaps_penalty_spares_neutral_mentions(spark):
    """Labels in which groups are named more often in toxic texts: with the penalty neutral mentions are not flagged."""
    rng = random.Random(19)
    rows = []
    for k in range(600):
        bad = k % 3 == 0
        text = words(rng, 12, 200).split()
        if bad and rng.random() < 0.9:
            text[rng.randrange(12)] = rng.choice(["idiot", "scum", "moron"])
        if rng.random() < (0.6 if bad else 0.05):
            text[rng.randrange(12)] = rng.choice(["muslims", "jews", "immigrants", "gay"])
        rows.append((k, " ".join(text), int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    sample = toxicity.labelled_sample(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"))
    probes = spark.createDataFrame([(k, f"w1 w{k} {t} w3 w{k + 1}") for k, t in enumerate(["muslims", "jews", "immigrants", "gay", "muslims", "jews"] * 5)], "doc_id long, text string")
    flagged = {}
    for swap, term in ((0.0, 0.0), (toxicity.SWAP_PENALTY, toxicity.TERM_PENALTY)):
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(toxicity, "SWAP_PENALTY", swap)
            patch.setattr(toxicity, "TERM_PENALTY", term)
            flagged[swap] = toxicity.score(probes, toxicity.train(sample)).where("predicted = 1").count()
    assert flagged[toxicity.SWAP_PENALTY] < flagged[0.0] and flagged[toxicity.SWAP_PENALTY] <= 3, flagged


def test_swaps_stay_in_their_language_and_kind():
    terms, swaps = toxicity.IDENTITY_TERMS, toxicity.swaps_of()
    line = {t: k for k, some in reversed(list(enumerate(toxicity.TERM_KINDS))) for t in some}
    assert all(swaps) and all(line[terms[j]] == line[t] or terms[j] in toxicity.TERM_KINDS[line[t]] for t, some in zip(terms, swaps) for j in some)
    assert all(k not in some for k, some in enumerate(swaps))


# Embedding near-dedup


def test_near_vectors_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "CELL_ROWS", 16)
    monkeypatch.setattr(embedding_dedup, "BLOCK", 12)
    rng = np.random.default_rng(6)
    base = rng.normal(size=(40, 8))
    rows = []
    for k in range(240):
        v = base[k % 40] + rng.normal(size=8) * (0.25 if k % 3 else 0)
        rows.append((k, [float(x) for x in v.astype(np.float32)], k % 2))
    rows += [(500, None, 1), (501, [0.0] * 8, 1), (502, [float("nan")] * 8, 1), (503, [None] * 8, 1), (504, rows[0][1], None), (505, [], 0), (506, [float("inf")] * 8, 0), (507, [1.0, 2.0], 0), (7, rows[7][1], 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("cell", F.lit("clash"))
    got = sorted((r.id, r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_vectors(frame).collect())
    usable = [(k, np.array(v, np.float64), label) for k, v, label in rows if v and label is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    n = len(usable)
    links = [[] for _ in range(n)]
    for i in range(n):
        for j in range(n):
            a, b = usable[i], usable[j]
            if i != j and a[2] == b[2] and len(a[1]) == len(b[1]) and (np.array_equal(a[1], b[1]) or a[1] @ b[1] / np.linalg.norm(a[1]) / np.linalg.norm(b[1]) >= 0.93):
                links[i].append(j)
    assert sum(map(len, links)) > 200
    wanted = {}
    for i in range(n):
        reach, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()]:
                if j not in reach:
                    reach.add(j)
                    todo.append(j)
        wanted.setdefault(usable[i][0], []).append((len(links[i]), min(usable[j][0] for j in reach)))
    flat = sorted((k, *x, x[1] == k) for k, some in wanted.items() for x in some)
    flat += [(k, 0, k, True) for k in (500, 501, 502, 503, 504, 505, 506)]
    assert got == sorted(flat)


@pytest.mark.parametrize(("fitted", "cells"), [(20_000, 64), (8192, 512), (8192, 1024)])
def test_near_vectors_recall_in_many_cells(monkeypatch, fitted, cells):
    """Pairs at 0.93 and above of spread vectors, the hardest case, share a cell; none was seen in fitting, and a cell may
    have had as few as eight rows there."""
    rng = np.random.default_rng(3)
    monkeypatch.setattr(embedding_dedup, "CELL_ROWS", 1)
    c, taken = embedding_dedup.fit_cells(embedding_dedup.unit(rng.normal(size=(fitted + embedding_dedup.TRIAL_PAIRS, 64))), cells, 0.93)
    a = embedding_dedup.unit(rng.normal(size=(4000, 64)))
    turn = rng.normal(size=a.shape)
    turn = embedding_dedup.unit(turn - (turn * a).sum(axis=1, keepdims=True) * a)
    assert len(c) == cells and 1 < taken <= 16
    top = lambda x: np.argpartition(-(x @ c.T), taken - 1, axis=1)[:, :taken]
    for cosine in (0.93, 0.95, 0.97):
        b = cosine * a + np.sqrt(1 - cosine**2) * turn
        share = np.mean([bool(set(x) & set(y)) for x, y in zip(top(a).tolist(), top(b).tolist())])
        assert share >= 0.99, (taken, cosine, share)


# Sharding


def test_shards_are_even_gapless_and_keep_groups_together(spark):
    rng = random.Random(1)
    texts = [words(rng, 5) for _ in range(300)]
    rows = [(k, rng.choice(texts[:40]) if k % 2 else f"{words(rng, 5)} {k}") for k in range(1003)] + [(None, None), (5, "ü"), (5, "ü"), (2000, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("shard", F.lit("clash"))
    out = sharding.shard_documents(docs).toPandas()
    assert len(out) == len(rows)
    counts = out.groupby("shard").size()
    assert counts.max() - counts.min() <= 1 and len(counts) == 40
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in out.groupby("shard"))
    assert set(out[out.id == 2000]["size"]) == {16} and (out["size"] - 16).sum() == sum(len((t or "").encode()) for _, t in rows)
    def cut_share(shard):
        """Share of links between rows of a group that are cut."""
        whole = kept = 0
        for _, some in shard[out.group_rows > 1].groupby(out.group_id):
            whole += len(some) * (len(some) - 1)
            kept += sum(n * (n - 1) for n in some.value_counts())
        return 1 - kept / whole

    # Against the start, where rows lie by hash and nearly all links are cut.
    by_hash = out.id.fillna(-1).astype("int64").map(lambda k: (k * 2654435761 % 2**32) % 40)
    assert cut_share(by_hash) > 0.9 and cut_share(out.shard) < 0.35, (cut_share(by_hash), cut_share(out.shard))


def test_one_large_group_fills_shards(spark):
    docs = spark.createDataFrame([(k, "same" if k % 3 == 0 else f"text {k}") for k in range(600)], "doc_id long, text string")
    out = sharding.shard_documents(docs, shards=8).toPandas()
    counts = out.groupby("shard").size()
    assert counts.max() - counts.min() <= 1
    assert out[out.group_rows > 1].shard.value_counts().head(4).sum() >= 0.7 * 200


# BPE


def test_bpe_equals_the_library(docs, spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path())
    texts = [r[1] for r in corpus()] + ["don't <|endoftext|>x <|startoftext|> É́ ΑΣ ﬁ", "中文" * 200, "a\x1cb\x85c\x00d", "İI ß 12345 !!! 's 'll", "é ́x"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("ids", F.lit("clash"))
    for r in bpe.encode_texts(frame, tokenizer_path(), with_ids=True, with_decoded=True).collect():
        ids = library.encode(texts[r.id] or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert (r.ids, r.n_tokens, r.decoded) == (ids, len(ids), decoded)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest() and r.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()


def library_ids(encoder, texts):
    return [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def encoded_ids(encoder, texts):
    raw = [t.encode() for t in texts]
    ids, counts = encoder.encode(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    return [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]


def test_bpe_joins_are_repaired(monkeypatch):
    """Short chunks, texts without gaps, and a memory that starts anew: always the library's ids."""
    monkeypatch.setattr(bpe, "EVERY", 24)
    monkeypatch.setattr(bpe, "LEAST", 16)
    monkeypatch.setattr(bpe, "KEPT_BYTES", 2000)
    encoder = bpe.Encoder(tokenizer_path())
    rng = random.Random(8)
    pool = "a b é e\u0301 中 文 x1 !? 's don't \n \t \x85 ﬁ İ <|endoftext|> ß 12 ЖЩ".split(" ")
    texts = [words(rng, 300), "x" * 3000, "中文" * 900, "é" * 700, ""] + ["".join(rng.choice([*pool, " ", " "]) for _ in range(rng.randint(1, 900))) for _ in range(60)]
    assert encoder.separable
    for whole in (False, True):
        encoder.separable = not whole
        encoder.kept = {}
        assert encoded_ids(encoder, texts) == library_ids(encoder, texts)
    one, two = (f(["ab c'd é中 <|endoftext|>e " * 9, " x", ""]) for f in (encoder.from_pieces, encoder.by_library))
    assert all(a.ids.tolist() == b.ids.tolist() and a[1:] == b[1:] for a, b in zip(one, two))
    assert encoder.held <= 2000 + sum(len(t.encode()) for t in texts)


def test_bpe_chunks_are_shared(spark, monkeypatch):
    """A passage that stands at other places in other texts gives the same chunks; each is encoded once for all."""
    rng = random.Random(12)
    passage = words(rng, 4000, 100_000)
    texts = [words(rng, rng.randint(1, 300), 100_000) + " " + passage + " " + words(rng, 50, 100_000) for _ in range(6)]
    raw = [t.encode() for t in texts]
    chunks = bpe.cut(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    assert [b"".join(c) for c in chunks] == raw and sum(map(len, raw)) / sum(map(len, chunks)) > 256
    common = set.intersection(*map(set, chunks))
    assert sum(map(len, common)) > 0.8 * len(passage)
    frame = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    shared = bpe.shared_chunks(frame, tokenizer_path())
    assert common <= set(shared)
    encoder = bpe.Encoder(tokenizer_path())
    encoder.shared = shared
    assert encoded_ids(encoder, texts) == library_ids(encoder, texts) and not common & set(encoder.kept)
    monkeypatch.setattr(bpe, "TABLE_BYTES", 100)
    assert bpe.shared_chunks(frame, tokenizer_path()) == {}


# URL filter


def test_url_verdicts(spark):
    urls = ["http://a.com/x", "https://WWW.Example.com/en/1", "http://m.example.com/en/2?q", "http://x.net/es/1", "net/es/", "http://net", "http://bad.org/p/1.html", "http://www.bad.org/p/1/#f", "http://good.org/p/1", None, "", "://", "http://evilexample.com/en/", "http://example.net/fr/", "http://xn.org?/en", "http://bad.org/p/1.html"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id int, url string").withColumn("host", F.lit("clash"))
    listed = spark.createDataFrame([("bad.org/p/1",), (None,), ("bad.org/p/1",)], "canonical string")
    out = {r.page_id: r for r in url_filter.judge_urls(pages, listed, URL_RULES).collect()}
    assert len(out) == len(urls)
    assert [out[k].rule for k in range(len(urls))] == ["com/", "www.example.com/en/", "example.com/en/", "net/es/", None, None, None, None, None, None, None, None, "com/", "net/fr/", None, None]
    assert sorted(k for k in out if out[k].verdict == "block") == [2, 3, 6, 7, 13, 15]
    assert (out[1].host, out[1].path, out[14].host, out[14].path, out[9].host) == ("www.example.com", "/en/1", "xn.org", "", "")
    tiny = url_filter.judge_urls(pages, listed, URL_RULES, n_words=1)
    assert {r.page_id: r.verdict for r in tiny.collect()} == {k: r.verdict for k, r in out.items()}
    assert url_filter.judge_urls(pages, listed.where("false"), []).where("verdict = 'block'").count() == 0


# Shared parts, empty tables


def test_components_and_numbers(spark):
    rng = random.Random(0)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(k, k + 1) for k in range(1000, 1060)] + [(2000, k) for k in range(2001, 2050)] + [(5, 5), (None, 3)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            parent[max(find(a), find(b))] = min(find(a), find(b))
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert found == {x: find(x) for x in parent}
    rows = numbered(spark.range(500).withColumn("k", F.col("id") % 3), ["k"], [F.xxhash64("id"), F.col("id")], "at", buckets=7).collect()
    for k in range(3):
        assert sorted(r["at"] for r in rows if r.k == k) == list(range(sum(r.k == k for r in rows)))


def test_stored_tables_and_clear(spark):
    from pathlib import Path

    from cataloom.llm import storage

    one = storage.stored(spark.range(5).withColumn("n", F.lit(None).cast("int")), "test")
    folder = Path(storage.shared_dir(spark).removeprefix("file://")) / "cataloom"
    assert one.count() == 5 and list(folder.glob("test-*"))
    assert storage.clear(spark) >= 1 and not list(folder.glob("test-*"))


def test_empty_tables(spark):
    docs = spark.createDataFrame([], DOCS)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert jaccard_join.near_texts(docs).count() == 0
    assert suffix_dedup.remove_repeats(docs).count() == 0
    assert decontaminate.find_leaks(docs, spark.createDataFrame([], "item_id long, text string")).count() == 0
    assert language_id.train(docs) is None and language_id.predict(docs, None).count() == 0
    assert toxicity.train(toxicity.labelled_sample(docs, labels)) is None
    assert sharding.shard_documents(docs).count() == 0
    assert bpe.encode_texts(docs, tokenizer_path()).count() == 0
    assert embedding_dedup.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
    assert html_crf.extract_text(spark.createDataFrame([], "page_id long, url string, html string"), html_crf.trained_field()).count() == 0
    assert url_filter.judge_urls(spark.createDataFrame([], "page_id long, url string"), spark.createDataFrame([], "canonical string"), URL_RULES).count() == 0


def test_odd_documents_everywhere(spark, odd_docs):
    n = odd_docs.count()
    assert jaccard_join.near_texts(odd_docs).count() == n
    assert sharding.shard_documents(odd_docs).count() == n
    assert bpe.encode_texts(odd_docs, tokenizer_path()).count() == n
    items = spark.createDataFrame([(1, corpus()[0][1]), (1, corpus()[0][1]), (None, corpus()[1][1])], "item_id long, text string")
    assert {(r.id, r.item_id) for r in decontaminate.find_leaks(odd_docs, items).collect()} == {(0, 1), (1, None)}


# The pipeline


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(11)
    clean = [words(rng, 60, 3000) for _ in range(60)]
    bench = [(0, words(rng, 30, 3000)), (1, words(rng, 30, 3000))]
    passage = words(rng, 70, 3000)
    rows = [(k, t) for k, t in enumerate(clean)]
    rows += [(100 + k, clean[k]) for k in range(5)] + [(110, clean[7] + " tail")]
    rows += [(120 + k, words(rng, 40, 3000) + " idiot " + words(rng, 5, 3000)) for k in range(20)]
    rows += [(150, words(rng, 30, 3000) + " " + bench[0][1]), (160, words(rng, 20, 3000) + " " + passage), (161, passage + " " + words(rng, 90, 3000)), (170, None), (171, "")]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in rows], DOCS)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 1, int(120 <= k < 140)) for k, _ in rows], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    state, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, state, str(tmp_path))
        if k < 4:
            assert out.columns == corpus_pipeline.COLUMNS
        out.write.parquet(f"{tmp_path}/out{k}")
        state = spark.read.parquet(f"{tmp_path}/out{k}")
        seen[name] = {r.doc_id for r in state.collect()}
    assert seen["toxicity"] == {k for k, _ in rows} - set(range(120, 140))
    assert seen["near_copies"] == seen["toxicity"] - {100, 101, 102, 103, 104, 110}
    assert seen["repeats"] == seen["near_copies"]
    cut = {r.doc_id: r for r in spark.read.parquet(f"{tmp_path}/out2").collect()}
    assert passage not in cut[161].text and passage in cut[160].text and cut[161].n_chars == len(cut[161].text)
    assert seen["benchmark"] == seen["repeats"] - {150} and seen["tokens"] == seen["benchmark"]
    whole = {r.doc_id: r.ids_sha256 for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert whole == {r.doc_id: r.ids_sha256 for r in state.collect()}
