"""Vectorised text helpers that run inside Arrow batches: byte blocks, word hashes, shingles.

A *word* is a maximal run of ASCII letters, digits and non-ASCII bytes of the UTF-8 text; case is
folded for ASCII and for the Latin-1 letters (U+00C0..U+00DE). Everything works on whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), element by element."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


#: A 64-bit value for each byte.
BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * BASE)


def powers(n: int, base: np.uint64, name: str) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept between calls."""
    found = _powers.get(name)
    if found is None or len(found) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        found = np.full(size, base, np.uint64)
        found[0] = 1
        np.multiply.accumulate(found, out=found)
        if size <= 1 << 20:
            _powers[name] = found
    return found[:n]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column end to end, and the offsets (n + 1). Null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    return raw_bytes(column.cast(pa.large_string()))


def raw_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column without nulls end to end, and the offsets (n + 1)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_binary(column.type):
        column = column.cast(pa.large_binary())
    raw = column.buffers()
    offsets = np.frombuffer(raw[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(raw[2], np.uint8) if raw[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(batches: Iterator[pa.RecordBatch], column: str, limit: int = 1 << 18) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of whole rows with at most ``limit`` bytes of text (a longer text is a slice of its own)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, offsets = utf8(batch.column(batch.schema.names.index(column)))
        start = 0
        while start < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
            end = min(max(end, start + 1), batch.num_rows)
            yield batch.slice(start, end - start), data[offsets[start] : offsets[end]], offsets[start : end + 1] - offsets[start]
            start = end
        pa.default_memory_pool().release_unused()


#: Word bytes, and ASCII case folding.
WORD_BYTE = np.zeros(256, bool)
WORD_BYTE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32


def folded(data: np.ndarray) -> np.ndarray:
    """Bytes with ASCII and Latin-1 letters in lower case."""
    out = FOLD[data]
    if len(out) > 1:
        upper = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        out[1:][upper] += 0x20
    return out


def lone_characters(data: np.ndarray) -> np.ndarray:
    """First bytes of characters of scripts without spaces: kana and Han (U+3000..U+9FFF), Thai and Lao (U+0E00..U+0EFF)."""
    out = (data >= 0xE3) & (data <= 0xE9)
    out[:-1] |= (data[:-1] == 0xE0) & (data[1:] >= 0xB8) & (data[1:] <= 0xBB)
    return out


def words(data: np.ndarray, offsets: np.ndarray, characters: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end (byte positions), 64-bit hash and row number of every word, in order.

    With ``characters`` each character of a script without spaces is a word."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, np.uint64), none
    is_word = WORD_BYTE[data]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = is_word[:-1]
    firsts = offsets[:-1][offsets[:-1] < n]
    before[firsts] = False
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = is_word[1:]
    after[firsts[firsts > 0] - 1] = False
    if characters and (lone := np.flatnonzero(lone_characters(data))).size:
        for edge in (lone, np.minimum(lone + 3, n)):
            before[edge[edge < n]] = False
            after[edge[edge > 0] - 1] = False
    starts = np.flatnonzero(is_word & ~before)
    ends = np.flatnonzero(is_word & ~after) + 1
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(BYTE_VALUES[folded(data)] * powers(n, BASE, "up"), out=total[1:])
    hashes = mix((total[ends] - total[starts]) * powers(n, BASE_INVERSE, "down")[starts] + (ends - starts).astype(np.uint64))
    return starts, ends, hashes, np.searchsorted(offsets, starts, side="right") - 1


def shingles(hashes: np.ndarray, rows: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every run of ``width`` words inside a row. Rows with fewer words give one shingle of all."""
    n = len(hashes)
    if not n:
        return hashes, rows
    counts = np.bincount(rows, minlength=int(rows[-1]) + 1)
    out, where = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if n >= width:
        value = np.zeros(n - width + 1, np.uint64)
        for k in range(width):
            value = value * BASE + mix(hashes[k : n - width + 1 + k] + np.uint64(k + 1))
        inside = rows[: n - width + 1] == rows[width - 1 :]
        out, where = mix(value[inside]), rows[: n - width + 1][inside]
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        first = np.searchsorted(rows, short)
        extra = np.zeros(len(short), np.uint64)
        for k in range(width - 1):
            has = counts[short] > k
            extra[has] = extra[has] * BASE + mix(hashes[first[has] + k] + np.uint64(k + 1))
        out, where = np.concatenate([out, mix(extra + counts[short].astype(np.uint64))]), np.concatenate([where, short])
        order = np.argsort(where, kind="stable")
        out, where = out[order], where[order]
    return out, where
