"""Language identification by prediction by partial matching (PPM).

Each language has a byte context tree of variable order (up to three bytes). A byte's probability in a context follows
method C: seen bytes share n / (t + d), the escape gets d / (t + d) and leads to the shorter context, where the bytes
already seen are excluded. The statistics are frozen after training, so every code length is a sum of table entries: one
for each escape and one for the byte where it was seen. The language of a text is the one whose tree gives it the shortest
code length over all its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cataloom.llm.storage import discard, light_batches, stored
from cataloom.llm.text import blocks

#: Most (language, 4-gram) pairs of a model, some ten bytes each. Beyond that every language keeps its share of them for its
#: most frequent contexts of three bytes; contexts of two bytes and less are always whole.
MOST_ENTRIES = 4_000_000
#: Code lengths are in 1/1024 bit.
UNIT = 1024
#: What stands before a text.
BEFORE = 32


@dataclass
class Sparse:
    """A number for each pair of key and language that has one: rows of ``keys``, each a run of languages and values."""

    keys: np.ndarray
    ends: np.ndarray
    languages: np.ndarray
    values: np.ndarray

    @classmethod
    def of(cls, keys: np.ndarray, languages: np.ndarray, values: np.ndarray) -> Sparse:
        order = np.lexsort((languages, keys))
        keys = keys[order]
        head = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        return cls(keys[head].astype(np.uint32), np.concatenate([head, [len(keys)]]), languages[order].astype(np.uint16), values[order].astype(np.int32))

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in ``keys``, language, value) of every pair whose key is asked for."""
        if not len(self.keys):
            return np.zeros(0, np.int64), self.languages, self.values
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        hit = np.flatnonzero(self.keys[at] == keys)
        low = self.ends[at[hit]]
        n = self.ends[at[hit] + 1] - low
        which = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return np.repeat(hit, n), self.languages[which], self.values[which]


@dataclass
class Model:
    """Frozen statistics: code lengths of all bytes without context, by byte and language; for each order the lengths of the
    bytes seen in a context (key: context and byte) and those of its escape (key: context)."""

    languages: list[str]
    order0: np.ndarray
    seen: list[Sparse]
    escapes: list[Sparse]


def grams(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The bytes three, two and one before each byte of its text and the byte itself, as one number."""
    place = np.arange(len(data)) - np.repeat(offsets[:-1], np.diff(offsets))
    out = data.astype(np.uint32)
    for back in (1, 2, 3):
        shifted = np.empty_like(data)
        shifted[:back] = BEFORE
        shifted[back:] = data[:-back] if len(data) > back else data[:0]
        shifted[place < back] = BEFORE
        out |= shifted.astype(np.uint32) << np.uint32(8 * back)
    return out


def count_grams(labelled: DataFrame, text_column: str, label_column: str) -> DataFrame:
    """(lang, gram, n): how often each language has each run of four bytes, the first three of them the context."""
    schema = pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in blocks(batches, "text", 1 << 20):
            if not len(data):
                continue
            code = rows.column("lang").dictionary_encode()
            key = (np.repeat(code.indices.to_numpy().astype(np.uint64), np.diff(offsets)) << np.uint64(32)) | grams(data, offsets)
            key.sort()
            head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            n = np.diff(np.concatenate([head, [len(key)]]))
            key = key[head]
            yield pa.RecordBatch.from_arrays([code.dictionary.take(pa.array((key >> np.uint64(32)).astype(np.int64))), pa.array((key & np.uint64(0xFFFFFFFF)).astype(np.int64)), pa.array(n)], schema=schema)

    light_batches(labelled.sparkSession)
    texts = labelled.select(F.col(text_column).alias("text"), F.col(label_column).cast("string").alias("lang")).where("lang is not null and text is not null")
    return texts.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def train(labelled: DataFrame, text_column: str = "text", label_column: str = "lang") -> Model | None:
    """Fit the context trees on every labelled row; None if there is none. Rows without text or label are skipped."""
    counts = stored(count_grams(labelled, text_column, label_column), "grams")
    kept = counts
    total = counts.count()
    if total > MOST_ENTRIES:
        # Whole contexts, the most frequent of each language: frequencies by power of two are few, so the cut is a join.
        contexts = counts.groupBy("lang", F.shiftright("gram", 8).alias("context")).agg(F.sum("n").alias("t"), F.count("*").alias("d")).withColumn("level", F.floor(F.log2("t")))
        levels = contexts.groupBy("lang", "level").agg(F.sum("d").alias("d")).toPandas()
        room = MOST_ENTRIES / levels["lang"].nunique()
        levels = levels.sort_values(["lang", "level"], ascending=[True, False])
        levels = levels[levels.groupby("lang")["d"].cumsum() <= room][["lang", "level"]]
        fits = contexts.join(F.broadcast(labelled.sparkSession.createDataFrame(levels, "lang string, level long")), ["lang", "level"]).select("lang", "context")
        kept = counts.withColumn("context", F.shiftright("gram", 8)).join(fits, ["lang", "context"])
    four = kept.select("lang", "gram", "n").toArrow()
    three = counts.groupBy("lang", F.col("gram").bitwiseAND(F.lit(0xFFFFFF)).alias("gram")).agg(F.sum("n").alias("n")).toArrow()
    discard(counts)
    return build(*((t["lang"].to_pylist(), t["gram"].to_numpy(), t["n"].to_numpy()) for t in (four, three))) if len(three) else None


def build(four: tuple, three: tuple) -> Model:
    """The model from counts (language, gram, n) of 4-grams, and of 3-grams, which are whole."""
    languages = sorted(set(three[0]))
    number = {name: k for k, name in enumerate(languages)}
    k = len(languages)

    def summed(lang: np.ndarray, gram: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
        pair, at = np.unique((gram.astype(np.int64) << 16) | lang, return_inverse=True)
        return pair & 0xFFFF, pair >> 16, np.bincount(at, n, len(pair))

    orders = [None, None, summed(np.array([number[x] for x in three[0]]), three[1], three[2]), summed(np.array([number[x] for x in four[0]], np.int64), four[1], four[2])]
    orders[1] = summed(orders[2][0], orders[2][1] & 0xFFFF, orders[2][2])
    lang, symbol, n = summed(orders[1][0], orders[1][1] & 0xFF, orders[1][2])
    total, distinct = np.bincount(lang, n, k), np.bincount(lang, minlength=k)
    base = np.tile(np.where(distinct < 256, distinct / (total + distinct) / np.maximum(256 - distinct, 1), 0.0), (256, 1))
    base[symbol, lang] = n / np.where(distinct < 256, total + distinct, total)[lang]
    lengths = lambda p: np.round(-np.log2(p) * UNIT)
    model = Model(languages, lengths(np.maximum(base, 1e-300)).astype(np.int32), [], [])
    shorter_key, shorter = (symbol.astype(np.int64) << 16) | lang, base[symbol, lang]
    order = np.argsort(shorter_key)
    shorter_key, shorter = shorter_key[order], shorter[order]
    for order in (1, 2, 3):
        lang, gram, n = orders[order]
        context, at = np.unique((gram >> 8 << 16) | lang, return_inverse=True)
        total, distinct = np.bincount(at, n, len(context)), np.bincount(at, minlength=len(context))
        # What the shorter context gives to the bytes that are seen here as well; they were all seen there.
        below = shorter[np.searchsorted(shorter_key, ((gram & ((1 << 8 * order) - 1)) << 16) | lang)]
        rest = 1 - np.bincount(at, below, len(context))
        some = rest > 1e-9
        p = n / np.where(some, total + distinct, total)[at]
        model.seen.append(Sparse.of(gram, lang, lengths(p)))
        escape = lengths(distinct / (total + distinct) / np.where(some, rest, 1e-9))
        model.escapes.append(Sparse.of(context >> 16, context & 0xFFFF, escape))
        shorter_key, shorter = (gram << 16) | lang, p
    return model


def gram_lengths(model: Model, gram: np.ndarray) -> np.ndarray:
    """Code length in each language of the last byte of each 4-gram (distinct and in order), in its context."""
    out, given = model.order0, np.arange(256, dtype=np.uint32)
    for order, seen, escapes in zip((1, 2, 3), model.seen, model.escapes, strict=True):
        keys = gram if order == 3 else np.unique(gram & np.uint32((1 << 8 * (order + 1)) - 1))
        out = out[np.searchsorted(given, keys & np.uint32((1 << 8 * order) - 1))]
        at, lang, value = escapes.find(keys >> np.uint32(8))
        out[at, lang] += value
        at, lang, value = seen.find(keys)
        out[at, lang] = value
        given = keys
    return out


def code_lengths(model: Model, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Code length of all bytes of each text in each language, in 1/1024 bit."""
    out = np.zeros((len(offsets) - 1, len(model.languages)), np.int64)
    if not len(data):
        return out
    gram, at = np.unique(grams(data, offsets), return_inverse=True)
    full = np.flatnonzero(np.diff(offsets) > 0)
    lengths = gram_lengths(model, gram)
    # Some languages at a time, so that the entries of a block stay small.
    for k in range(0, len(model.languages), 8):
        out[full, k : k + 8] = np.add.reduceat(lengths[:, k : k + 8][at], offsets[:-1][full], axis=0, dtype=np.int64)
    return out


#: ASCII letters, as bytes.
LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123)]] = True


def predict(docs: DataFrame, model: Model | None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, lang_pred, score, bits_per_byte.

    ``score`` is the share of the best language when every language counts 2 to the power of minus its code length; ties
    go to the first language in order. Texts that are null or have no letter give ``und`` with score 0, and so does
    every text if there is no model. Rows may repeat, null ids are kept, other columns are ignored.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    light_batches(docs.sparkSession)
    kind = docs.schema[id_column].dataType
    schema = pa.schema([("id", to_arrow_type(kind)), ("lang_pred", pa.string()), ("score", pa.float64()), ("bits_per_byte", pa.float64())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        names = np.array([*(model.languages if model else []), "und"], object)
        for rows, data, offsets in blocks(batches, "text"):
            n = rows.num_rows
            reach = np.concatenate([[0], np.cumsum(LETTER[data])])
            letters = reach[offsets[1:]] > reach[offsets[:-1]]
            for k in np.flatnonzero(~letters & (np.diff(offsets) > 0)):
                letters[k] = any(x.isalpha() for x in data[offsets[k] : offsets[k + 1]].tobytes().decode())
            best, share, rate = np.full(n, len(names) - 1), np.zeros(n), np.zeros(n)
            if model:
                lengths = code_lengths(model, data, offsets)
                least = np.argmin(lengths, axis=1)
                behind = (lengths - lengths[np.arange(n), least][:, None]) / UNIT
                best = np.where(letters, least, best)
                share = np.where(letters, 1 / np.exp2(-np.minimum(behind, 1000)).sum(axis=1), 0)
                rate = lengths[np.arange(n), least] / UNIT / np.maximum(np.diff(offsets), 1)
            yield pa.RecordBatch.from_arrays([rows.column("id"), pa.array(names[best], pa.string()), pa.array(share), pa.array(rate)], schema=schema)

    return docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).mapInArrow(score, f"id {kind.simpleString()}, lang_pred string, score double, bits_per_byte double")
