"""Benchmark decontamination: passages of documents within a small edit distance of a benchmark item.

Distance is counted in words. Item-sized windows of the documents, wherever they start, are embedded by the CGK random
walk, which maps edit distance to Hamming distance; bit-sampling LSH over the embeddings, repeated until the target
recall, proposes (window, item) pairs, and an exact alignment decides. A window is only left out where no match can be:
an edit changes two pairs of neighbouring words at most, so a match holds many pairs that some item holds.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cataloom.llm.storage import light_batches, stored
from cataloom.llm.text import BASE, blocks, mix, words

SIMILARITY = 0.8
#: Window sizes: an item is sought by windows of the largest of these that it holds, at its beginning and its end.
#: Longer items are sought by parts: the least edited part has no larger share of edits than the whole.
SIZES = (5, 6, 7, 8, 10, 12, 15, 19, 24, 30, 38, 48, 60)
#: Walks of the embedding, samplings of each, and symbols of a sampling. ``test_leaks_of_all_sizes`` holds the recall of
#: passages with all permitted edits against ``TARGET_RECALL``.
WALKS, SAMPLINGS, SAMPLED, TARGET_RECALL = 6, 8, 3, 0.99
#: A window starts at every place, from twice ``STRIDE`` words on at every second, and so on.
STRIDE = 12
#: Items below this size allow no edit and are sought as exact runs of words.
EXACT = 5
#: Words of benchmark items that are searched for in one pass over the documents (they reach all tasks).
PASS_WORDS = 2_000_000
#: Windows, and cells of alignments, that are held at a time.
WINDOWS, CELLS = 1 << 16, 1 << 21


def edits_of(size: int, similarity: float) -> int:
    return int((1 - similarity) * size + 1e-9)


def least_pairs(size: int) -> int:
    """Pairs of neighbouring words that a window of a match shares with its item at least.

    A window is a fifth shorter than its item at most and may hold all its edits, a quarter of the window's words; each
    takes two of the ``size - 1`` pairs. What is asked leaves room for rounding and for windows that start off by a few."""
    return max(1, int(0.45 * size) - 1)


def runs(hashes: np.ndarray, rows: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Place and hash of every run of ``width`` words inside a row."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    value = np.zeros(n, np.uint64)
    for k in range(width):
        value = value * BASE + hashes[k : n + k]
    inside = np.flatnonzero(rows[:n] == rows[width - 1 :])
    return inside, mix(value[inside])


#: Random bits of the walks: 64 steps of a walk for each salt.
SALTS = np.random.default_rng(1).integers(1, 2**63, (WALKS, 2 * SIZES[-1] // 64 + 1)).astype(np.uint64)


def walk_bits(symbols: np.ndarray) -> list[list[np.ndarray]]:
    """For each walk and 64 of its steps, whether it moves on from a symbol: a bit a step."""
    return [[mix(symbols ^ s) for s in some] for some in SALTS]


class Embedding:
    """CGK walks for windows of one size, and the steps that are sampled.

    A walk stands at a symbol and writes it; a random bit of step and symbol says whether it moves on. Two windows that
    differ by few edits soon stand at the same symbols again."""

    def __init__(self, size: int) -> None:
        rng = np.random.default_rng(size)
        last = max(SAMPLED, int(1.7 * size))
        self.size = size
        self.samples = [[np.sort(rng.choice(last, SAMPLED, replace=False)).tolist() for _ in range(SAMPLINGS)] for _ in range(WALKS)]

    def keys(self, symbols: np.ndarray, bits: list[list[np.ndarray]], begin: np.ndarray) -> Iterator[np.ndarray]:
        """The LSH key of each window in each repetition. Walks may read on behind a window; ``symbols`` must go on so far."""
        for walk, samples in enumerate(self.samples):
            wanted = {t for some in samples for t in some}
            at, seen, bit = begin.astype(np.int64), {}, np.empty(len(begin), np.uint64)
            for t in range(max(wanted) + 1):
                if t in wanted:
                    seen[t] = symbols[at]
                np.take(bits[walk][t // 64], at, out=bit, mode="clip")
                bit >>= np.uint64(t % 64)
                bit &= np.uint64(1)
                at += bit.view(np.int64)
            for k, some in enumerate(samples):
                key = np.full(len(begin), np.uint64((self.size * WALKS + walk) * SAMPLINGS + k + 1))
                for t in some:
                    key = key * BASE + seen[t]
                yield mix(key)


class Index:
    """Sorted 64-bit keys with a value each, behind a bitmap that most other keys don't pass."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        order = np.argsort(keys, kind="stable")
        self.keys, self.values = keys[order], values[order]
        self.shift = np.uint64(64 - min(30, max(16, int(len(keys)).bit_length() + 6)))
        self.marks = np.zeros(1 << (64 - int(self.shift)), bool)
        self.marks[keys >> self.shift] = True

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in ``keys``, value) for every entry with an equal key."""
        maybe = np.flatnonzero(self.marks[keys >> self.shift])
        low = np.searchsorted(self.keys, keys[maybe], "left")
        equal = np.flatnonzero(self.keys[np.minimum(low, len(self.keys) - 1)] == keys[maybe])
        maybe, low = maybe[equal], low[equal]
        n = np.searchsorted(self.keys, keys[maybe], "right") - low
        which = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return np.repeat(maybe, n), self.values[which]


def fit_distances(items: np.ndarray, regions: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Least edit distance of each item to any stretch of its region, with the stretch's first and last-plus-one place.

    Both are matrices of one row a pair; regions end in zeros where they are shorter. Of equal distances the first end
    counts, then the latest start."""
    m, n = items.shape[1], regions.shape[1]
    place = np.arange(n + 1)
    shift = n + 2
    # Costs and starts in one number: a lower cost first, then the later start.
    state = np.tile(n - place, (len(items), 1))
    for i in range(m):
        best = state + shift
        best[:, 1:] = np.minimum(best[:, 1:], state[:, :-1] + shift * (regions != items[:, i, None]))
        state = np.minimum.accumulate(best - place * shift, axis=1) + place * shift
    cost = state // shift
    end = np.argmin(cost, axis=1)
    found = state[np.arange(len(items)), end]
    return found // shift, n - found % shift, end


class Items:
    """Word sequences of items and the LSH keys of their windows, by size."""

    def __init__(self, ids: list, sequences: list[np.ndarray], similarity: float) -> None:
        self.ids, self.sequences = ids, sequences
        self.sizes = np.array([len(s) for s in sequences], np.int64)
        self.edits = np.array([edits_of(len(s), similarity) for s in sequences], np.int64)
        self.words = np.concatenate([*sequences, np.zeros(2 * SIZES[-1], np.uint64)])
        self.starts = np.cumsum(self.sizes) - self.sizes
        pairs = np.unique(np.concatenate([np.zeros(0, np.uint64), *(runs(s, np.zeros(len(s), np.int64), 2)[1] for s in sequences)]))
        self.pairs = Index(pairs, np.zeros(len(pairs), np.int8))
        windows: dict[int, list[tuple[int, int]]] = {}  # by size: item and first word
        exact: dict[int, list[int]] = {}
        for k, s in enumerate(sequences):
            n = len(s)
            if not self.edits[k]:
                exact.setdefault(n, []).append(k)
                continue
            edge = np.linspace(0, n, math.ceil(n / SIZES[-1]) + 1).astype(np.int64).tolist()
            for a, b in zip(edge[:-1], edge[1:], strict=True):
                size = max(x for x in SIZES if x <= b - a)
                windows.setdefault(size, []).extend((k, at) for at in {a, b - size})
        self.exact = {}
        for n, some in exact.items():
            value = np.concatenate([runs(sequences[k], np.zeros(n, np.int64), n)[1] for k in some])
            self.exact[n] = Index(value, np.array(some, np.int64))
        self.windows = {}
        symbols = np.concatenate([np.concatenate([s, np.zeros(2 * SIZES[-1], np.uint64)]) for s in sequences]) if windows else self.words
        starts, bits = self.starts + 2 * SIZES[-1] * np.arange(len(sequences)), walk_bits(symbols)
        for size, some in windows.items():
            item, at = np.array(some, np.int64).T
            keys = list(Embedding(size).keys(symbols, bits, starts[item] + at))
            self.windows[size] = (Embedding(size), item, at, Index(np.concatenate(keys), np.tile(np.arange(len(item)), len(keys))))

    def candidates(self, hashes: np.ndarray, rows: np.ndarray, first: np.ndarray, last: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
        """(row, item, place where the item's first word would stand, slack of that place), some at a time."""
        for width, index in self.exact.items():
            place, value = runs(hashes, rows, width)
            at, item = index.find(value)
            yield rows[place[at]], item, place[at], 0
        if not self.windows:
            return
        # Words with a gap around each row, so that windows may begin before a text and end behind it.
        front, gap = SIZES[-1] // 5, SIZES[-1] // 4
        symbols = np.zeros(len(hashes) + gap * len(first) + 2 * SIZES[-1], np.uint64)
        moved = np.arange(len(hashes)) + gap * rows + front
        symbols[moved] = hashes
        known = np.zeros(len(symbols) + 1, np.int64)
        place, value = runs(hashes, rows, 2)
        known[moved[place[self.pairs.find(value)[0]]] + 1] = 1
        known = np.cumsum(known)
        row_of = np.repeat(np.arange(len(first)), last - first + gap)
        for start in range(0, len(symbols) - 2 * SIZES[-1], WINDOWS):
            # Reading on behind a window takes no more than its size again.
            here = symbols[start : start + WINDOWS + 2 * SIZES[-1]]
            stop = min(len(here), WINDOWS)
            familiar = known[start : start + len(here) + 1]
            bits = walk_bits(here)
            for size, (embedding, items, shifts, index) in self.windows.items():
                stride = max(1, size // STRIDE)
                begin = np.arange(-start % stride, max(0, stop), stride)
                begin = begin[begin + size < len(familiar)]
                begin = begin[familiar[begin + size - 1] - familiar[begin] >= least_pairs(size)]
                begin = begin[begin < len(symbols) - 2 * SIZES[-1] - start]
                if not len(begin):
                    continue
                pairs = []
                for key in embedding.keys(here, bits, begin):
                    at, entry = index.find(key)
                    if len(at):
                        pairs.append(begin[at] * len(items) + entry)
                if pairs:
                    pairs = np.unique(np.concatenate(pairs))
                    spot, entry = pairs // len(items) + start, pairs % len(items)
                    row = row_of[spot]
                    yield row, items[entry], spot - front - gap * row - shifts[entry], stride

    def search(self, hashes: np.ndarray, rows: np.ndarray, first: np.ndarray, last: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(row, item, edits, first word, last word + 1) of every match; first and last are the bounds of each row's words."""
        out = []
        for row, item, place, slack in self.candidates(hashes, rows, first, last):
            # One region for starts that lie close together.
            step = np.maximum(1, self.edits[item])
            place = place // step
            order = np.lexsort((place, item, row))
            row, item, place = (x[order] for x in (row, item, place))
            fresh = np.concatenate([[True], (row[1:] != row[:-1]) | (item[1:] != item[:-1]) | (place[1:] != place[:-1])]) if len(row) else np.zeros(0, bool)
            row, item, place = row[fresh], item[fresh], place[fresh]
            step = np.maximum(1, self.edits[item])
            low = np.maximum(first[row], place * step - self.edits[item] - slack)
            high = np.minimum(last[row], (place + 1) * step + self.sizes[item] + self.edits[item] + slack)
            order = np.argsort(self.sizes[item], kind="stable")
            row, item, low, high = (x[order] for x in (row, item, low, high))
            for size in np.unique(self.sizes[item]):
                a, b = np.searchsorted(self.sizes[item], [size, size + 1])
                width = int((high[a:b] - low[a:b]).max())
                step = max(1, CELLS // int(size * width + 1))
                for start in range(a, b, step):
                    s = slice(start, min(b, start + step))
                    out.append(self.aligned(hashes, row[s], item[s], low[s], high[s], int(size), width))
        if not out:
            return []
        row, item, cost, begin, end = np.concatenate(out, axis=1)
        order = np.lexsort((end, begin, cost, item, row))
        order = order[np.flatnonzero(np.diff(np.stack([row, item])[:, order], axis=1, prepend=-1).any(axis=0))]
        return list(zip(*(x[order].tolist() for x in (row, item, cost, begin, end)), strict=True))

    def aligned(self, hashes: np.ndarray, row: np.ndarray, item: np.ndarray, low: np.ndarray, high: np.ndarray, size: int, width: int) -> np.ndarray:
        """Row, item, edits, first word and last word + 1 of the pairs that match."""
        index = low[:, None] + np.arange(width)
        region = np.where(index < high[:, None], hashes[np.minimum(index, len(hashes) - 1)], np.uint64(0))
        given = self.words[self.starts[item][:, None] + np.arange(size)]
        # Item words that the region has about where they must stand.
        shared, edits = np.zeros(len(row), np.int64), int(self.edits[item].max())
        for k in range(size):
            shared += (region[:, max(0, k - edits) : k + width - size + edits + 1] == given[:, k, None]).any(axis=1)
        some = np.flatnonzero(shared >= size - self.edits[item])
        cost, begin, end = fit_distances(given[some], region[some])
        good = cost <= self.edits[item[some]]
        some, cost, begin, end = some[good], cost[good], begin[good], end[good]
        return np.stack([row[some], item[some], cost, low[some] + begin, low[some] + end])


def find_leaks(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY, id_column: str = "doc_id", text_column: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id, item_id, edits, item_words, similarity, from_byte, to_byte) for every document and item with a match.

    A match is a stretch of the document's words whose edit distance in words from the item is at most ``1 - similarity``
    of the item's words; the best one of a document and item is given, with the bytes of the UTF-8 text it covers. Words
    are those of ``text.words``, with each character of a script without spaces as a word. Items that allow no edit are
    found by their exact run of words. Null or empty texts match nothing, nor do items that are null or have no word;
    items repeated with the same id and text count once. Rows of documents may repeat and each gives its rows. Items are
    searched in passes of ``PASS_WORDS`` words over the documents, one after the other, so what driver and tasks hold is
    bounded.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    light_batches(docs.sparkSession)
    spark = docs.sparkSession
    chosen = items.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text")).where("text is not null").distinct()
    doc_kind, item_kind = docs.schema[id_column].dataType, items.schema[item_id].dataType
    schema = pa.schema([("id", to_arrow_type(doc_kind)), ("item_id", to_arrow_type(item_kind)), ("edits", pa.int32()), ("item_words", pa.int32()), ("similarity", pa.float64()), ("from_byte", pa.int64()), ("to_byte", pa.int64())])
    kinds = f"id {doc_kind.simpleString()}, item_id {item_kind.simpleString()}, edits int, item_words int, similarity double, from_byte long, to_byte long"
    texts = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))

    def one_pass(ids: list, sequences: list[np.ndarray]) -> DataFrame:
        if not ids:
            return spark.createDataFrame([], kinds)
        shared = spark.sparkContext.broadcast(Items(ids, sequences, similarity))

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = shared.value
            for rows, data, offsets in blocks(batches, "text"):
                starts, ends, hashes, row = words(data, offsets, True)
                bound = np.searchsorted(row, np.arange(rows.num_rows + 1))
                found = table.search(hashes, row, bound[:-1], bound[1:])
                if not found:
                    continue
                doc = [x[0] for x in found]
                size = [len(table.sequences[x[1]]) for x in found]
                out = [rows.column("id").take(pa.array(doc)), pa.array([table.ids[x[1]] for x in found], schema.field("item_id").type), pa.array([x[2] for x in found], pa.int32()), pa.array(size, pa.int32())]
                out += [pa.array([1 - x[2] / n for x, n in zip(found, size, strict=True)]), pa.array([int(starts[x[3]] - offsets[x[0]]) for x in found], pa.int64()), pa.array([int(ends[x[4] - 1] - offsets[x[0]]) for x in found], pa.int64())]
                yield pa.RecordBatch.from_arrays(out, schema=schema)

        return texts.mapInArrow(search, kinds)

    passes, ids, sequences, held = [], [], [], 0
    for row in chosen.orderBy("item_id", "text").toLocalIterator():
        data = np.frombuffer(row["text"].encode(), np.uint8)
        sequence = words(data, np.array([0, len(data)]), True)[2]
        if ids and held + len(sequence) > PASS_WORDS:
            passes.append(stored(one_pass(ids, sequences), "leaks"))
            ids, sequences, held = [], [], 0
        if len(sequence):
            ids.append(row["item_id"])
            sequences.append(sequence)
            held += len(sequence)
    out = one_pass(ids, sequences)
    for more in passes:
        out = out.union(more)
    return out


def drop_contaminated(docs: DataFrame, items: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` without the rows of ids that hold a benchmark passage; rows with a null id are kept."""
    leaks = find_leaks(docs, items, id_column=id_column, text_column=text_column).select(F.col("id").alias("__leak")).distinct()
    return docs.join(leaks, docs[id_column] == leaks["__leak"], "left_anti")
