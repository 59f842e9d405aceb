"""BPE encoding and decoding with content-defined chunk reuse.

Texts are cut where a rolling hash says so, wherever that stands, so passages that documents share give the same chunks.
Chunks are counted over all documents; those whose reuse saves most are encoded once and sent to all tasks as a table of
bounded size, and a worker keeps further chunks that it has met. Joins of chunks are repaired: the text around a join is
encoded anew by the library and must agree, token by token and across a gap, with the chunks on both sides; where it
doesn't, the chunks are encoded as one, up to the whole text, until all joins agree.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cataloom.llm.storage import discard, light_batches, stored
from cataloom.llm.text import BASE, BASE_INVERSE, BYTE_VALUES, blocks, mix, powers

#: Bytes that the rolling hash sees; one place in ``EVERY`` is a cut, if it is ``LEAST`` bytes behind the one before.
ROLLING, EVERY, LEAST = 16, 1024, 256
#: Bytes of the chunks that are sent to all tasks, and of those that a worker keeps besides; it then starts anew.
TABLE_BYTES, KEPT_BYTES = 16 << 20, 8 << 20
#: Characters on each side of a join that are encoded anew; gaps at a chunk's ends that are held against them.
AROUND, HELD = 32, 12
#: Strings between white space whose ids a worker keeps; it then starts anew.
KEPT_PIECES = 400_000
#: Strings that try whether a tokenizer ever looks across white space.
PROBES = ("a", "B1", "'s", "don't", "<|endoftext|>", "é", "e\u0301", "\u0301x", "中文", "!?", "12", "ΑΣ", "ﬁ", "_", "\x85x", "ß'll")


class Chunk(NamedTuple):
    """Ids of a chunk, its characters, and near its ends, by character, the numbers of tokens that stand behind a gap."""

    ids: np.ndarray
    size: int
    head: dict[int, int]
    tail: dict[int, int]


IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(b" \t\n\r\x0b\x0c")] = True


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indexes start, start + 1, ... of every range, one range after the other."""
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


class Table:
    """A byte string for each id, followed by a space."""

    def __init__(self, texts: list[bytes]) -> None:
        self.data = np.frombuffer(b"".join([t + b" " for t in texts]), np.uint8)
        self.sizes = np.array([len(t) + 1 for t in texts], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def joined(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The strings of each row's ids, joined by spaces."""
        sizes = self.sizes[ids]
        data = self.data[spread(self.starts[ids], sizes)].tobytes()
        reach = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(counts)])].tolist()
        return [data[a : max(a, b - 1)] for a, b in zip(reach[:-1], reach[1:], strict=True)]


def cut(data: np.ndarray, offsets: np.ndarray) -> list[list[bytes]]:
    """The chunks of each text of a block. Cuts stand between characters; a text is the sum of its chunks."""
    n, raw = len(data), data.tobytes()
    places = np.zeros(0, np.int64)
    if n > ROLLING:
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(BYTE_VALUES[data] * powers(n, BASE, "up"), out=total[1:])
        rolled = mix((total[ROLLING:] - total[:-ROLLING]) * powers(n + 1, BASE_INVERSE, "down")[: n - ROLLING + 1])
        places = np.flatnonzero(rolled % np.uint64(EVERY) == 0) + ROLLING
        for _ in range(3):  # a character has at most three bytes behind the first
            places = places + ((data[np.minimum(places, n - 1)] & 0xC0) == 0x80) * (places < n)
    reach = np.searchsorted(places, offsets)
    places = places.tolist()
    out = []
    for k in range(len(offsets) - 1):
        start, end = int(offsets[k]), int(offsets[k + 1])
        mine, at = [], start
        for p in places[reach[k] : reach[k + 1]]:
            # The hash must see bytes of this text only, so that equal passages are cut alike.
            if p - at >= LEAST and p - start >= ROLLING and p < end:
                mine.append(raw[at:p])
                at = p
        mine.append(raw[at:end])
        out.append(mine)
    return out


def digest(chunk: bytes) -> tuple[int, int]:
    value = hashlib.blake2b(chunk, digest_size=16).digest()
    return int.from_bytes(value[:8], "little", signed=True), int.from_bytes(value[8:], "little", signed=True)


def agreeing(chunk: Chunk, marks: dict[int, int], ids: list[int], spans: list[tuple[int, int]], shift: int, last: bool) -> tuple[int, int] | None:
    """Where a chunk and the text around a join agree: a token behind a gap at the same character, and the same ids two
    tokens before and two from there on. Gives the number of tokens before it in both. Characters of the window plus
    ``shift`` count in the chunk. The outermost such place from the join is taken: the last, or the first."""
    order = range(2, len(ids) - 1)
    for q in reversed(order) if last else order:
        if spans[q - 1][1] < spans[q][0]:
            t = marks.get(spans[q][0] + shift)
            if t is not None and t >= 2 and chunk.ids[t - 2 : t + 2].tolist() == ids[q - 2 : q + 2]:
                return t, q
    return None


class Pieces:
    """Ids of strings between white space."""

    def __init__(self) -> None:
        self.number: dict[bytes, int] = {}
        self.flat, self.used = np.zeros(1 << 16, np.int32), 0
        self.sizes = np.zeros(0, np.int64)

    def add(self, pieces: list[bytes], tokenizer) -> None:
        """Encode new pieces by the library."""
        sizes, flat = [], []
        for start in range(0, len(pieces), 8192):
            for e in tokenizer.encode_batch_fast([p.decode() for p in pieces[start : start + 8192]], add_special_tokens=False):
                ids = e.ids
                sizes.append(len(ids))
                flat += ids
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + len(flat)] = flat
        self.used += len(flat)
        self.number.update(zip(pieces, range(len(self.sizes), len(self.sizes) + len(pieces)), strict=True))
        self.sizes = np.concatenate([self.sizes, np.array(sizes, np.int64)])


class Encoder:
    """The tokenizer of a file, with chunks that are known: those of the shared table and those met in this worker.

    Where the tokenizer doesn't look across white space (tried at the start), a new chunk is put together from its pieces
    between white space, each of which a worker encodes once; else the library encodes the chunk whole."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        names = {i: t.encode() for t, i in self.tokenizer.get_vocab(with_added_tokens=True).items()}
        self.numbers = Table([b"%d" % i for i in range(max(names) + 1)])
        self.tokens = Table([names.get(i, b"") for i in range(max(names) + 1)])
        self.shared: dict[bytes, Chunk] = {}
        self.kept: dict[bytes, Chunk] = {}
        self.held = 0
        ids = lambda t: self.tokenizer.encode(t, add_special_tokens=False).ids
        self.separable = all(ids(a + space + b) == ids(a) + ids(b) for space in (" ", "  ", "\n", "\t", "\r\n", "\x0b", "\x0c") for a in PROBES for b in PROBES)
        self.pieces = Pieces()

    def encode_chunks(self, texts: list[str]) -> list[Chunk]:
        """Some chunks, encoded."""
        if self.separable:
            out = []
            for start in range(0, len(texts), 512):
                out += self.from_pieces(texts[start : start + 512])
            return out
        return self.by_library(texts)

    def from_pieces(self, texts: list[str]) -> list[Chunk]:
        if len(self.pieces.sizes) > KEPT_PIECES:
            self.pieces = Pieces()
        raw = [t.encode() for t in texts]
        joined = b" ".join(raw)
        pieces = joined.split()
        number = list(map(self.pieces.number.get, pieces))
        if new := list({p: None for p, k in zip(pieces, number, strict=True) if k is None}):
            self.pieces.add(new, self.tokenizer)
            number = list(map(self.pieces.number.get, pieces))
        entry, every = np.array(number, np.int64), self.pieces.sizes
        sizes, heads = every[entry], (np.cumsum(every) - every)[entry]
        ids = self.pieces.flat[spread(heads, sizes)]
        # Where pieces stand: their chunk, the characters and the tokens before them in it.
        data = np.frombuffer(joined, np.uint8)
        blank = IS_SPACE[data]
        starts = np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]])) if len(data) else np.zeros(0, np.int64)
        characters = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        ends = np.cumsum([len(x) + 1 for x in raw])
        owner = np.searchsorted(ends, starts, side="right")
        bound = np.searchsorted(owner, np.arange(len(texts) + 1))
        before = np.concatenate([[0], np.cumsum(sizes)])
        reach = before[bound].tolist()
        place = (characters[starts] - characters[np.concatenate([[0], ends[:-1]])][owner]).tolist()
        token = (before[:-1] - before[bound[owner]]).tolist()
        bound = bound.tolist()
        out = []
        for k, text in enumerate(texts):
            a, b = bound[k], bound[k + 1]
            head, tail = slice(a, min(b, a + HELD)), slice(max(a, b - HELD), b)
            out.append(Chunk(ids[reach[k] : reach[k + 1]], len(text), dict(zip(place[head], token[head], strict=True)), dict(zip(place[tail], token[tail], strict=True))))
        return out

    def by_library(self, texts: list[str]) -> list[Chunk]:
        out = []
        for start in range(0, len(texts), 1024):
            some = texts[start : start + 1024]
            for text, e in zip(some, self.tokenizer.encode_batch(some, add_special_tokens=False), strict=True):
                spans = e.offsets
                marks = [(spans[k][0], k) for k in range(len(spans)) if not k or spans[k - 1][1] < spans[k][0]]
                out.append(Chunk(np.array(e.ids, np.int32), len(text), dict(marks[:HELD]), dict(marks[-HELD:])))
        return out

    def known(self, chunks: list[bytes]) -> dict[bytes, Chunk]:
        """All of some chunks, encoded; each new one once."""
        if self.held > KEPT_BYTES:
            self.kept, self.held = {}, 0
        new = list({c: None for c in chunks if c not in self.shared and c not in self.kept})
        for c, e in zip(new, self.encode_chunks([c.decode() for c in new]), strict=True):
            self.kept[c] = e
            self.held += len(c)
        return {c: self.shared.get(c) or self.kept[c] for c in chunks}

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a block of texts, and the number of ids of each text."""
        texts = cut(data, offsets)
        known = self.known([c for chunks in texts for c in chunks])
        parts = [[known[c] for c in chunks] for chunks in texts]
        text = [[c.decode() for c in chunks] for chunks in texts]
        # Ranges that joins leave of each chunk, and what stands between: (tokens kept before, ids of the window, tokens dropped after).
        joins: list[dict[int, tuple[int, list[int], int]]] = [{} for _ in texts]
        todo = [(row, k) for row, some in enumerate(parts) for k in range(len(some) - 1)]
        while todo:
            windows = [text[row][k][-AROUND:] + text[row][k + 1][:AROUND] for row, k in todo]
            failed: dict[int, list[int]] = {}
            for start in range(0, len(todo), 4096):
                some = todo[start : start + 4096]
                for (row, k), e in zip(some, self.tokenizer.encode_batch(windows[start : start + 4096], add_special_tokens=False), strict=True):
                    a, b = parts[row][k], parts[row][k + 1]
                    ids, spans, left = e.ids, e.offsets, min(AROUND, a.size)
                    before = agreeing(a, a.tail, ids, spans, a.size - left, False)
                    after = agreeing(b, b.head, ids, spans, -left, True)
                    if before and after and before[1] <= after[1]:
                        joins[row][k] = (before[0], ids[before[1] : after[1]], after[0])
                    else:
                        failed.setdefault(row, []).append(k)
            # Joins on both sides of a chunk must not cross in it.
            for row in {row for row, _ in todo}:
                for k in range(1, len(parts[row]) - 1):
                    if k - 1 in joins[row] and k in joins[row] and joins[row][k - 1][2] > joins[row][k][0]:
                        failed.setdefault(row, []).append(k)
            todo = []
            for row, some in failed.items():
                self.merge(row, set(some), parts, text, joins, todo)
        ids, counts = [], []
        for some, between in zip(parts, joins, strict=True):
            n, at = 0, 0
            for k, chunk in enumerate(some):
                if k in between:
                    until, window, following = between[k]
                    ids += [chunk.ids[at:until], np.array(window, np.int32)]
                    n += until - at + len(window)
                    at = following
                else:
                    ids.append(chunk.ids[at:])
                    n += len(chunk.ids) - at
            counts.append(n)
        return np.concatenate(ids) if ids else np.zeros(0, np.int32), np.array(counts, np.int64)

    def merge(self, row: int, failed: set[int], parts: list, text: list, joins: list, todo: list) -> None:
        """Make one chunk of those on both sides of each failed join of a row, and ask for the joins around it anew."""
        new_text: list[str] = []
        changed: list[bool] = []
        for k, t in enumerate(text[row]):
            if k and k - 1 in failed:
                new_text[-1] += t
                changed[-1] = True
            else:
                new_text.append(t)
                changed.append(False)
        old = [k for k in range(len(text[row])) if not k or k - 1 not in failed]
        fresh = iter(self.encode_chunks([t for t, c in zip(new_text, changed, strict=True) if c]))
        parts[row] = [next(fresh) if c else parts[row][k] for k, c in zip(old, changed, strict=True)]
        ends = [k - 1 for k in old[1:]]  # the old join after each new chunk but the last
        kept = {}
        for k, was in enumerate(ends):
            if was in joins[row] and not changed[k] and not changed[k + 1]:
                kept[k] = joins[row][was]
            else:
                todo.append((row, k))
        text[row], joins[row] = new_text, kept


_encoders: dict[str, Encoder] = {}


def encoder_of(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def chunk_counts(texts: DataFrame) -> DataFrame:
    """(h1, h2, size, n): every chunk of ``LEAST`` bytes or more of the column text, and how often it occurs."""
    schema = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("size", pa.int32()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, data, offsets in blocks(batches, "text", 1 << 20):
            seen: dict[bytes, int] = {}
            for chunks in cut(data, offsets):
                for c in chunks:
                    if len(c) >= LEAST:
                        seen[c] = seen.get(c, 0) + 1
            marks = [digest(c) for c in seen]
            yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in marks], pa.int64()), pa.array([m[1] for m in marks], pa.int64()), pa.array(list(map(len, seen)), pa.int32()), pa.array(list(seen.values()), pa.int64())], schema=schema)

    return texts.select("text").mapInArrow(count, "h1 long, h2 long, size int, n long").groupBy("h1", "h2", "size").agg(F.sum("n").alias("n"))


def shared_chunks(texts: DataFrame, path: str) -> dict[bytes, Chunk]:
    """The chunks whose reuse saves most bytes over all ``texts``, encoded once: at most ``TABLE_BYTES`` bytes of them."""
    spark = texts.sparkSession
    counts = stored(chunk_counts(texts).where("n > 1").withColumn("level", F.floor(F.log2((F.col("n") - 1) * F.col("size"))).cast("int")), "chunks")
    levels = counts.groupBy("level").agg(F.sum("size").alias("bytes")).orderBy(F.desc("level")).collect()  # 64 rows at most
    least, held = None, 0
    for row in levels:
        if held + row["bytes"] > TABLE_BYTES:
            break
        least, held = row["level"], held + row["bytes"]
    if least is None:
        discard(counts)
        return {}
    chosen = counts.where(F.col("level") >= least).select("h1", "h2").toArrow()  # TABLE_BYTES / LEAST rows at most
    marks = np.unique(chosen["h1"].to_numpy())
    wanted = spark.sparkContext.broadcast(marks)
    discard(counts)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given: set[bytes] = set()
        for _, data, offsets in blocks(batches, "text", 1 << 20):
            some = list({c: None for chunks in cut(data, offsets) for c in chunks if len(c) >= LEAST and c not in given})
            h = np.array([digest(c)[0] for c in some], np.int64)
            at = np.minimum(np.searchsorted(wanted.value, h), len(wanted.value) - 1)
            some = [some[k] for k in np.flatnonzero(wanted.value[at] == h)]
            given.update(some)
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.binary())], names=["chunk"])

    schema = pa.schema([("chunk", pa.binary()), ("ids", pa.binary()), ("size", pa.int32()), ("head", pa.list_(pa.int32())), ("tail", pa.list_(pa.int32()))])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chunks = batch.column("chunk").to_pylist()
            found = encoder_of(path).encode_chunks([c.decode() for c in chunks])
            yield pa.RecordBatch.from_arrays([batch.column("chunk"), pa.array([e.ids.tobytes() for e in found], pa.binary()), pa.array([e.size for e in found], pa.int32()), *(pa.array([[x for pair in marks.items() for x in pair] for marks in some], pa.list_(pa.int32())) for some in ([e.head for e in found], [e.tail for e in found]))], schema=schema)

    encoded = texts.select("text").mapInArrow(gather, "chunk binary").distinct().mapInArrow(encode, "chunk binary, ids binary, size int, head array<int>, tail array<int>").toArrow()
    marks = lambda x: dict(zip(x[::2], x[1::2], strict=True))
    return {row["chunk"]: Chunk(np.frombuffer(row["ids"], np.int32), row["size"], marks(row["head"]), marks(row["tail"])) for row in encoded.to_pylist()}


def encode_texts(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text", with_ids: bool = False, with_decoded: bool = False) -> DataFrame:
    """One row per row of ``docs``: id, n_tokens, ids_sha256, decoded_sha256; on request also ids and decoded.

    The ids equal those of the tokenizers library with the file at ``path`` (present on every worker) and
    add_special_tokens=False, without truncation and padding; decoded equals its decode(ids, skip_special_tokens=False)
    for a tokenizer that has no decoder of its own (tokens joined by a space). Null text counts as empty: no tokens,
    hashes of no bytes. Chunks are known by their bytes, so a hit needs no further check. Rows may repeat; null ids are
    kept; other columns are ignored; an empty table gives an empty result.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    light_batches(docs.sparkSession)
    fields = [("id", to_arrow_type(docs.schema[id_column].dataType)), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    kinds = f"id {docs.schema[id_column].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    if with_ids:
        fields, kinds = [*fields, ("ids", pa.list_(pa.int32()))], kinds + ", ids array<int>"
    if with_decoded:
        fields, kinds = [*fields, ("decoded", pa.string())], kinds + ", decoded string"
    schema = pa.schema(fields)
    texts = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(shared_chunks(texts, path))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path)
        encoder.shared = shared.value
        for rows, data, offsets in blocks(batches, "text", 1 << 20):
            ids, counts = encoder.encode(data, offsets)
            numbers, tokens = encoder.numbers.joined(ids, counts), encoder.tokens.joined(ids, counts)
            out = [rows.column("id"), pa.array(counts), pa.array([hashlib.sha256(x).hexdigest() for x in numbers]), pa.array([hashlib.sha256(x).hexdigest() for x in tokens])]
            if with_ids:
                out.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(ids)))
            if with_decoded:
                out.append(pa.array([x.decode() for x in tokens], pa.string()))
            yield pa.RecordBatch.from_arrays(out, schema=schema)

    return texts.mapInArrow(encode, kinds)
