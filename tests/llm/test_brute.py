"""Whole queries, and the pipeline, against plain versions on small tables."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest

from cataloom.llm import html_crf, language_id, queries, toxicity
from tests.llm.test_corpus_operators import HAND_LABELLED, PlainPPM, least_fit, shingle_sets, words

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[0-9a-z\x80-\U0010ffff]+")


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Documents with copies, near copies, shared passages, benchmark passages, toxic words, nulls; labels; benchmark; pages."""
    rng = random.Random(31)
    folder = tmp_path_factory.mktemp("tables")
    clean = [words(rng, rng.randint(30, 120), 3000) for _ in range(60)]
    bench = [(k, words(rng, rng.randint(12, 40), 3000)) for k in range(5)]
    passage = words(rng, 60, 3000) + " é中"
    texts = [*clean, *clean[:6]]
    for k in range(6):
        some = clean[10].split()
        some[k * 3] = f"new{k}"
        texts.append(" ".join(some))
    texts += [f"{clean[20 + k]} {passage} {words(rng, 9, 3000)}" for k in range(5)]
    for k, (_, item) in enumerate(bench):
        part = item.split()
        part[len(part) // 2] = "edited"
        texts.append(f"{words(rng, 40, 3000)} {' '.join(part)} {words(rng, 20 * k, 3000)}")
    texts += [f"{words(rng, 30, 3000)} {rng.choice(['idiot', 'scum'])} {words(rng, 10, 3000)}" for _ in range(25)] + [None, "", "- 12 -", "Ж"]
    rows = [(k, t, ["en", "fr", None][k % 3], "s", len(t or "")) for k, t in enumerate(texts)]
    # Languages differ in their letters.
    rows = [(k, t.replace("w", "é") if t and lang == "fr" and k < 6 else t, lang, s, n) for k, t, lang, s, n in rows]
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    toxic = [(k, 1, int(bool(t) and bool(re.search("idiot|scum", t)))) for k, t in enumerate(texts)]
    spark.createDataFrame(toxic, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    pages = [(k, f"http://x.org/{k}", page) for k, (page, _) in enumerate(HAND_LABELLED)] + [(90, None, None), (91, "u", "")]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    return str(folder), {r[0]: r[1] for r in rows}, {r[0]: r[2] for r in rows}, dict(bench)


def crc(k) -> int:
    return zlib.crc32(str(k).encode())


def test_language_query_equals_plain_ppm(spark, tables):
    folder, texts, langs, _ = tables
    plain = {lang: PlainPPM([t for k, t in texts.items() if t is not None and langs[k] == lang and crc(k) % 4 != 2]) for lang in ("en", "fr")}
    for r in queries.op2_language_id(spark, folder).collect():
        text = texts[r.doc_id]
        assert r.held_out == (crc(r.doc_id) % 4 == 2)
        if not any(c.isalpha() for c in text or ""):
            assert (r.lang_pred, r.score) == ("und", 0)
            continue
        lengths = {lang: p.length(text) for lang, p in plain.items()}
        if abs(lengths["en"] - lengths["fr"]) > 1:
            best = min(lengths, key=lengths.get)
            assert r.lang_pred == best
            assert abs(r.score - 1 / sum(2.0 ** -min(x - lengths[best], 1000) for x in lengths.values())) < 0.05


def test_toxicity_query_equals_plain_sums(spark, tables):
    folder, texts, _, _ = tables
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(toxicity.labelled_sample(docs, labels.where(queries._bucket(5) != 0)))
    weight = dict(zip(model.features.tolist(), model.weights.tolist()))
    right = 0
    for r in queries.op5_toxicity(spark, folder).collect():
        found = {h for w in set(WORD.findall((texts[r.doc_id] or "").lower())) for h in toxicity.term_features(w).tolist()}
        z = model.intercept + sum(weight.get(h, 0.0) for h in found)
        assert abs(r.score - 1 / (1 + math.exp(-z))) < 1e-6 and r.predicted == (r.score >= 0.5) and r.held_out == (crc(r.doc_id) % 5 == 0)
        right += r.predicted == bool(re.search("idiot|scum", texts[r.doc_id] or ""))
    assert right >= 0.97 * len(texts)


def test_extraction_query_equals_the_best_of_all_labellings(spark, tables):
    folder, *_ = tables
    field = html_crf.trained_field()
    got = {r.page_id: r for r in queries.op4_html_extraction(spark, folder).collect()}
    assert got[90].text == got[91].text == "" and got[90].n_chars == 0
    for k, (page, wanted) in enumerate(HAND_LABELLED):
        blocks = html_crf.leaf_blocks(page)
        own = [field.unary(b) for b in blocks]
        same = [blocks[i][0] == blocks[i - 1][0] or blocks[i][0][:-1] == blocks[i - 1][0][:-1] for i in range(1, len(blocks))]

        def score(y):
            return field.ends[0][y[0]] + field.ends[1][y[-1]] + sum(u for u, on in zip(own, y) if on) + sum(field.edges[s][a][b] for s, a, b in zip(same, y, y[1:]))

        if len(blocks) <= 15:
            best = max(itertools.product((0, 1), repeat=len(blocks)), key=score)
            assert got[k].text == "\n".join(b[1] for b, y in zip(blocks, best) if y)
        assert got[k].text == "\n".join(wanted) and got[k].n_chars == len(got[k].text)


def test_sharding_query_keeps_its_law(spark, tables):
    folder, texts, *_ = tables
    rows = queries.op8_sharding(spark, folder).collect()
    assert {r.doc_id for r in rows} == set(texts) and len(rows) == len(texts)
    counts = np.bincount([r.shard for r in rows], minlength=40)
    assert counts.max() - counts.min() <= 1 and len(counts) == 40
    for shard in range(40):
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(counts[shard]))
    for r in rows:
        data = (texts[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(data) + 16, zlib.crc32(data), "rows", None)


def cut_repeats(texts: dict[int, str], match: int = 100) -> dict[int, str]:
    """Texts without the bytes that strings seen earlier cover; a character stays if any of its bytes does."""
    seen, out = set(), {}
    for k in sorted(texts):
        data = (texts[k] or "").encode()
        gone = bytearray(len(data))
        for at in range(len(data) - match + 1):
            part = data[at : at + match]
            if part in seen:
                gone[at : at + match] = b"\1" * match
            seen.add(part)
        left, at = "", 0
        for c in texts[k] or "":
            size = len(c.encode())
            left += "" if all(gone[at : at + size]) else c
            at += size
        out[k] = left
    return out


def test_pipeline_equals_plain_stages(spark, tables):
    """Every stage by a plain version on what the one before kept."""
    import corpus_pipeline
    from tokenizers import Tokenizer

    folder, texts, _, bench = tables
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(toxicity.labelled_sample(docs, labels))
    toxic = {r.id for r in toxicity.score(docs, model).where("predicted = 1").collect()}
    kept = {k: t for k, t in texts.items() if k not in toxic}
    sets = shingle_sets([(k, t) for k, t in kept.items()])
    for k in sorted(kept):
        reach, todo = {k}, [k]
        while todo:
            i = todo.pop()
            for j in sets:
                if j not in reach and sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                    reach.add(j)
                    todo.append(j)
        if min(reach) != k:
            kept = {x: t for x, t in kept.items() if x != k}
    cut = cut_repeats(kept)
    plain = lambda t: WORD.findall(t.lower())
    left = {k: t for k, t in cut.items() if not any(least_fit(plain(item), plain(t)) <= int(0.2 * len(plain(item))) for item in bench.values())}
    assert len(texts) > len(texts) - len(toxic) > len(kept) > len(left) > 50
    library = Tokenizer.from_file(queries.tokenizer_path())
    wanted = {k: hashlib.sha256(" ".join(map(str, library.encode(t, add_special_tokens=False).ids)).encode()).hexdigest() for k, t in left.items()}
    assert {r.doc_id: r.ids_sha256 for r in corpus_pipeline.run(spark, folder).collect()} == wanted


def test_models_of_languages_are_frozen(spark, tables):
    """The same rows in other partitions give the same model."""
    docs = spark.read.parquet(f"{tables[0]}/documents.parquet")
    one, two = language_id.train(docs), language_id.train(docs.repartition(7))
    assert one.languages == two.languages and (one.order0 == two.order0).all() and all((a.values == b.values).all() for a, b in zip(one.seen + one.escapes, two.seen + two.escapes))
