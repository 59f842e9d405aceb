"""Hard negatives, whitening and SentencePiece encoding against brute force and the library, and on awkward tables."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cataloom.llm import hard_negatives, piece_bpe, whitening
from cataloom.llm.queries import piece_path

VECTORS = "vec_id long, embedding array<float>, label int"


def unusable(dims: int) -> list[tuple]:
    """Rows that take no part."""
    return [(900, None, 1), (901, [None] + [0.0] * (dims - 1), 1), (902, [float("nan")] * dims, 1), (903, [float("inf")] + [0.0] * (dims - 1), 2)]


# Hard negatives


def brute_negatives(rows, anchors, positives=5, negatives=3):
    rows = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v], y) for i, v, y in rows]
    out = []
    for i, v, y in rows:
        if i not in anchors:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, z == y) for j, w, z in rows if j != i)
        for p, pid, _ in [s for s in scored if s[2]][:positives]:
            fits = [s for s in scored if not s[2] and 50 * -p <= 100 * -s[0] <= 95 * -p][:negatives]
            out += [(i, pid, k + 1, s[1], -p, -s[0]) for k, s in enumerate(fits)]
    return sorted(out)


def some_vectors(n: int, dims: int = 8, labels: int = 4, seed: int = 5) -> list[tuple]:
    """Random vectors with coarse components, so that many scores tie."""
    rng = np.random.default_rng(seed)
    return [(k, (rng.integers(-3, 6, dims) / 4).tolist(), int(rng.integers(labels))) for k in range(n)]


def mined(frame, anchors):
    out = hard_negatives.mine_negatives(frame, F.col("vec_id").isin(*anchors))
    return sorted(tuple(r) for r in out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


@pytest.mark.parametrize(("row_block", "anchor_block", "tile"), [(16_384, 8192, 1 << 20), (40, 5, 64)])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, row_block, anchor_block, tile):
    monkeypatch.setattr(hard_negatives, "ROW_BLOCK", row_block)
    monkeypatch.setattr(hard_negatives, "ANCHOR_BLOCK", anchor_block)
    monkeypatch.setattr(hard_negatives, "TILE", tile)
    rows = some_vectors(300)
    anchors = list(range(0, 300, 11))
    found = mined(spark.createDataFrame(rows + unusable(8), VECTORS), anchors)
    assert found and found == brute_negatives(rows, anchors)


def test_hard_negatives_on_awkward_tables(spark):
    rows = some_vectors(40, labels=2)
    frame = spark.createDataFrame(rows + unusable(8) + [(None, [1.0] * 8, 0), (950, [1.0] * 8, None)], VECTORS)
    extra = frame.withColumns({c: F.lit(7) for c in ("id", "row", "v", "place", "is_anchor", "row_block", "p")})
    anchors = [0, 5, 10]
    assert mined(extra, anchors) == brute_negatives(rows, anchors)
    assert mined(frame.limit(0), anchors) == [] and mined(frame, [77]) == []
    # Fewer positives and negatives than asked, labels without others, a shorter vector.
    few = [(0, [1.0, 1.0], 0), (1, [1.0, 0.5], 0), (2, [0.75, 0.25], 1), (3, [0.5], 1), (4, [1.0, 1.0], 2)]
    assert mined(spark.createDataFrame(few, VECTORS), [0, 4]) == brute_negatives([(i, (v + [0.0])[:2], y) for i, v, y in few], [0, 4])
    # Repeated rows: not compared with their like, each a row of its own elsewhere.
    twice = mined(spark.createDataFrame(few + few[2:3], VECTORS), [0])
    assert [x[3] for x in twice if x[1] == 1][:2] == [2, 2]


def test_scores_are_exact_for_large_components():
    a = np.array([[3 << 30, 1]], np.int64)
    assert hard_negatives.products(a, a)[0, 0] == (1 << 63) - 1 and hard_negatives.products(a // 4, a // 4)[0, 0] == ((3 << 28) ** 2)
    b = np.array([[(1 << 26) + 1, 1]], np.int64)
    assert hard_negatives.products(b, b)[0, 0] == ((1 << 26) + 1) ** 2 + 1


# Whitening


def test_jacobi_keeps_small_eigenvalues():
    rng = np.random.default_rng(2)
    q, _ = np.linalg.qr(rng.normal(size=(20, 20)))
    scale = 10.0 ** -np.arange(20)
    values, axes = whitening.cyclic_jacobi(np.diag(scale) + 1e-3 * np.sqrt(np.outer(scale, scale)) * (q + q.T))
    assert np.allclose(axes.T @ axes, np.eye(20), atol=1e-12) and (np.diff(values) <= 0).all()
    assert values[-1] == pytest.approx(1e-19, rel=0.1)
    other, _ = whitening.cyclic_jacobi(q @ np.diag(np.arange(1.0, 21)) @ q.T)
    assert np.allclose(other, np.arange(20.0, 0, -1), rtol=1e-12)
    assert whitening.cyclic_jacobi(np.zeros((3, 3)))[0].tolist() == [0, 0, 0]


def test_whitening_equals_numpy(spark):
    rng = np.random.default_rng(4)
    mix = rng.normal(size=(12, 12))
    rows = [(k, (mix @ rng.normal(size=12) + 3).astype(np.float32).tolist(), 0) for k in range(400)]
    frame = spark.createDataFrame(rows + unusable(12) + [(960, [1.0], 0)], VECTORS).withColumns({c: F.lit(7) for c in ("id", "v", "i", "n", "component")})
    out = whitening.whiten(frame, 5).toPandas()
    x = np.floor(64 * np.array([v for _, v, _ in rows], np.float32).astype(float)).astype(np.int64) + 1_000_000
    n, sums = len(x), x.sum(axis=0)
    y = x - sums / n
    values, axes = np.linalg.eigh(y.T @ y / n)
    wanted = y @ axes[:, ::-1][:, :5] / np.sqrt(values[::-1][:5])
    given = out.pivot(index="id", columns="component", values="whitened").sort_index().to_numpy()
    assert len(out) == 5 * n and (out.n == n).all() and out.identity_error.max() < 1e-9
    assert np.allclose(given * np.sign((given * wanted).sum(axis=0)), wanted, atol=1e-8)
    exact = [sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, sums)) for row in x]
    assert out[out.component == 3].sort_values("id").deviation.tolist() == exact
    assert np.allclose(out[out.id == 7].sort_values("component").explained, values[::-1][:5] / values.sum())


def test_whitening_on_awkward_tables(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert whitening.whiten(empty).collect() == [] and whitening.whiten(spark.createDataFrame(unusable(3), VECTORS)).collect() == []
    one = whitening.whiten(spark.createDataFrame([(None, [1.0, 2.0], 0)], VECTORS)).collect()
    assert [(r.id, r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(None, c, 1, 0, None, None, 0.0) for c in (1, 2)]
    # Three rows in four dimensions, one of them constant, one row repeated: two components are real.
    rows = [(1, [0.0, 1.0, 5.0, 2.0], 0), (1, [0.0, 1.0, 5.0, 2.0], 0), (2, [4.0, 1.0, 2.0, 2.0], 0), (3, [1.0, 7.0, 2.0, 2.0], 0)]
    out = whitening.whiten(spark.createDataFrame(rows, VECTORS)).collect()
    assert len(out) == 16 and {r.component for r in out if r.whitened is not None} == {1, 2} and all(r.identity_error < 1e-9 for r in out)
    # Entries that long integers can't hold.
    far = whitening.whiten(spark.createDataFrame([(1, [1e30], 0), (2, [-1e30], 0)], VECTORS)).collect()
    assert [r.deviation for r in far] == [None, None] and sorted(round(r.whitened) for r in far) == [-1, 1]


# SentencePiece


@pytest.fixture(scope="module")
def encoder():
    return piece_bpe.PieceEncoder(piece_path())


def test_pieces_equal_the_library(encoder):
    rng = random.Random(6)
    parts = ["a", "b", "e", "t", "th", " ", "  ", "\n", "\t", "é", "日", "本", "😀", "ing", "the", "▁", "\x00", "<s>", "</s>", "<0x41>", "0", "tion", "aaaa", "________", "====", "́", "　", "​"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 40)))
        assert encoder.encode(text) == encoder.library.encode(text), text
    for text in ("", " ", "   ", "=" * 30_000, " " * 30_000, "ab" * 20_000, "日本語" * 5000, "x y " * 400_000, "".join(rng.choice("abcdefghij") for _ in range(30_000))):
        assert encoder.encode(text) == encoder.library.encode(text), text[:20]


def test_pieces_step_back_and_forget(encoder, monkeypatch):
    """With tiny stores of pairs and units, and over all prefixes of a text, where backtracking happens most."""
    monkeypatch.setattr(piece_bpe, "PAIRS", 50)
    monkeypatch.setattr(piece_bpe, "UNITS", 5)
    text = "Unglaubwürdigkeitshypothesen internationalization antidisestablishmentarianism\n\n    return    x"
    for k in range(len(text)):
        assert encoder.encode(text[:k]) == encoder.library.encode(text[:k])


def test_merging_and_backtracking_agree_for_any_vocabulary(encoder):
    """Small random vocabularies with equal scores: the tokens of each string are those of merging it."""
    rng = random.Random(8)
    import ahocorasick

    for _ in range(30):
        small = object.__new__(piece_bpe.PieceEncoder)
        texts = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 5))) for _ in range(25)}
        small.ids = {t: k for k, t in enumerate(sorted(texts))}
        small.scores = {t: float(rng.randrange(6)) for t in texts}
        small.bytes, small.unknown, small.lone, small.pairs = {}, 0, {}, 0
        small.known = {t: piece_bpe.Token(t, (k,)) for t, k in small.ids.items() if small.merged(t) == [t]}
        small.matches = ahocorasick.Automaton()
        for t, token in small.known.items():
            token.shorter = next((small.known[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in small.known), None) or (small.single(t[0]) if len(t) > 1 else None)
            small.matches.add_word(t, token)
        small.matches.make_automaton()
        for _ in range(60):
            text = "".join(rng.choice("abcd") for _ in range(rng.randint(1, 14)))
            assert [t.text for t in small.tokens(text)] == small.merged(text)


def test_pieces_of_awkward_tables(spark, encoder):
    rows = [(1, "one text"), (1, "one text"), (2, None), (None, ""), (3, "\x00 \n"), (4, "long " * 300_000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(7) for c in ("id", "ids", "n_tokens")})
    out = piece_bpe.encode_texts(frame, piece_path(), with_ids=True, with_decoded=True).collect()
    assert len(out) == len(rows)
    for r, (i, text) in zip(sorted(out, key=lambda r: (r.id or 0, r.n_tokens)), sorted(rows, key=lambda x: (x[0] or 0, len(x[1] or ""))), strict=True):
        ids = encoder.library.encode(text or "")
        assert (r.id, r.ids, r.n_tokens) == (i, ids, len(ids)) and r.decoded == encoder.library.decode(ids)
        assert r.decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest()
    assert piece_bpe.encode_texts(frame.limit(0), piece_path()).count() == 0
