"""Exact encoding by a SentencePiece model of merge type (BPE), by backtracking instead of merging.

A row of tokens is what merging gives for a text if and only if each token merges to itself and each two neighbours,
merged anew from their joined characters, fall apart into just these two. So the encoding of a text is found from left to
right: take the longest token (all matches come from one Aho-Corasick pass) that agrees with its predecessor, fall back to
shorter ones, and step back a token where none is left. The encoding of a prefix is unique, so a position from which the
rest can't be covered fails for every way that leads there: one bit a position, and no position is left twice.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cataloom.llm.text import blocks

SPACE = "▁"
#: Units (texts between white space) of at most so many characters are kept by a worker, so many of them; so many pairs.
UNIT_CHARACTERS, UNITS, PAIRS = 48, 1_000_000, 1_000_000
#: Characters of a text that are cut into units at a time.
STRETCH = 1 << 20


class Token:
    """A token, the longest one that it starts with and that is shorter, and what is known of tokens behind it."""

    __slots__ = ("text", "size", "back", "ids", "shorter", "followers")

    def __init__(self, text: str, ids: tuple[int, ...]) -> None:
        self.text, self.size, self.back, self.ids = text, len(text), len(text) - 1, ids
        self.shorter: Token | None = None
        self.followers: dict[Token, bool] = {}


class PieceEncoder:
    """The vocabulary of a model file, and what a worker has learnt from it so far."""

    def __init__(self, path: str) -> None:
        import ahocorasick
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        kinds = model.SentencePiece
        if model.trainer_spec.model_type != model.trainer_spec.BPE or any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in model.pieces):
            raise ValueError("a model of merge type without user-defined and unused pieces is needed")
        self.library = SentencePieceProcessor(model_file=path)
        self.unknown = self.library.unk_id()
        self.bytes = {int(p.piece[3:5], 16): k for k, p in enumerate(model.pieces) if p.type == kinds.BYTE}
        self.ids = {p.piece: k for k, p in enumerate(model.pieces) if p.type == kinds.NORMAL}
        self.scores = {p.piece: p.score for p in model.pieces if p.type == kinds.NORMAL}
        # Tokens that merge to something else than themselves never come out of merging.
        self.known = {piece: Token(piece, (k,)) for piece, k in self.ids.items() if self.merged(piece) == [piece]}
        self.lone: dict[str, Token] = {}
        self.matches = ahocorasick.Automaton()
        for piece, token in self.known.items():
            starts = (self.known.get(piece[:k]) for k in range(len(piece) - 1, 0, -1))
            token.shorter = next((start for start in starts if start), None) or (self.single(piece[0]) if len(piece) > 1 else None)
            self.matches.add_word(piece, token)
        self.matches.make_automaton()
        # No piece goes on with a space after another character: then no merge does, and texts can be cut there.
        crossing = any(re.search(f"[^{SPACE}]{SPACE}", piece) for piece in self.ids)
        self.unit = re.compile(r"(?s).+" if crossing else f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
        self.border = None if crossing else re.compile(f"(?<=[^{SPACE}]){SPACE}")
        self.pairs = 0
        self.units: dict[str, tuple[int, ...]] = {}
        self.names = [str(k) for k in range(len(model.pieces))]

    def merged(self, text: str) -> list[str]:
        """What merging makes of ``text``: the best pair first, of equal ones the leftmost. For short texts."""
        parts, scores = list(text), self.scores
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                score = scores.get(parts[k] + parts[k + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, k
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def single(self, character: str) -> Token:
        """A character as a token: its id, or the ids of its bytes if it has none."""
        found = self.known.get(character) or self.lone.get(character)
        if found is None:
            found = self.lone[character] = Token(character, tuple(self.bytes[b] for b in character.encode()) if self.bytes else (self.unknown,))
        return found

    def agree(self, left: Token, right: Token) -> bool:
        """Whether the joined characters of two tokens merge to just these two; the answer is kept with the left one."""
        if self.pairs >= PAIRS:
            for token in (*self.known.values(), *self.lone.values()):
                token.followers.clear()
            self.pairs = 0
        self.pairs += 1
        found = left.followers[right] = self.merged(left.text + right.text) == [left.text, right.text]
        return found

    def tokens(self, text: str) -> list[Token]:
        """The tokens of a text that isn't empty, by backtracking. A character without a token stands for itself."""
        n = len(text)
        longest: list[Token | None] = [None] * n
        for end, match in self.matches.iter(text):  # ends rise, so that of a start the longest comes last
            longest[end - match.back] = match
        failed, any_failed = bytearray((n >> 3) + 1), False
        found: list[Token] = []
        at, last = 0, None
        token = longest[0] or self.single(text[0])
        while True:
            end = at + token.size
            fits = True
            if last is not None:
                fits = last.followers.get(token)
                if fits is None:
                    fits = self.agree(last, token)
            if fits and not (any_failed and failed[end >> 3] & 1 << (end & 7)):
                found.append(token)
                if end == n:
                    return found
                at, last = end, token
                token = longest[at] or self.single(text[at])
                continue
            token = token.shorter
            while token is None:
                # No way on from here: mark the place, and try shorter tokens at the one before.
                if not found:
                    raise ValueError("no row of tokens covers the text")
                failed[at >> 3] |= 1 << (at & 7)
                any_failed = True
                token = found.pop()
                at -= token.size
                token, last = token.shorter, found[-1] if found else None

    def encode_unit(self, unit: str) -> tuple[int, ...]:
        """The ids of a text between white space; those of a short one are kept."""
        found = tuple(k for token in self.tokens(unit) for k in token.ids)
        if len(unit) <= UNIT_CHARACTERS:
            if len(self.units) >= UNITS:
                self.units.clear()
            self.units[unit] = found
        return found

    def encode(self, text: str) -> list[int]:
        """The ids of a text, as the library's encode gives them without begin and end."""
        normal = self.library.normalize(text) if text else ""
        out: list[int] = []
        known, start = self.units, 0
        while start < len(normal):
            border = self.border.search(normal, start + STRETCH) if self.border and start + STRETCH < len(normal) else None
            end = border.start() if border else len(normal)
            for unit in self.unit.findall(normal[start:end]):
                out += known.get(unit) or self.encode_unit(unit)
            start = end
        if not self.bytes and self.unknown in out:  # without bytes, the library makes one of several unknown characters
            out = [k for j, k in enumerate(out) if k != self.unknown or not j or out[j - 1] != k]
        return out


_encoders: dict[str, PieceEncoder] = {}


def encoder_of(path: str) -> PieceEncoder:
    """The encoder of a model file, once a worker."""
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]


def encode_texts(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text", with_ids: bool = False, with_decoded: bool = False) -> DataFrame:
    """One row per row of ``docs``: id, n_tokens, ids_sha256, decoded_sha256; on request also ids and decoded.

    The ids equal those of the sentencepiece library for the model file at ``path`` (present on every worker), without
    begin and end; decoded is the library's decode of them. ids_sha256 is over the decimal ids joined by commas. Null text
    counts as empty: no tokens, hashes of no bytes. Texts are encoded whole, however long, in memory that grows with the
    text and not with its tries. Rows stay where they are and may repeat; null ids are kept; other columns are ignored,
    whatever their names; an empty table gives an empty result.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    id_type = docs.schema[id_column].dataType
    fields = [("id", to_arrow_type(id_type)), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    kinds = f"id {id_type.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    if with_ids:
        fields, kinds = [*fields, ("ids", pa.list_(pa.int32()))], kinds + ", ids array<int>"
    if with_decoded:
        fields, kinds = [*fields, ("decoded", pa.string())], kinds + ", decoded string"
    schema = pa.schema(fields)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path)
        for rows, data, offsets in blocks(batches, "text", 1 << 20):
            ids = [encoder.encode(data[a:b].tobytes().decode()) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            decoded = [encoder.library.decode(some) if some else "" for some in ids]
            out = [rows.column("id"), pa.array([len(some) for some in ids], pa.int64()), pa.array([hashlib.sha256(",".join(map(encoder.names.__getitem__, some)).encode()).hexdigest() for some in ids], pa.string())]
            out.append(pa.array([hashlib.sha256(text.encode()).hexdigest() for text in decoded], pa.string()))
            if with_ids:
                out.append(pa.array(ids, pa.list_(pa.int32())))
            if with_decoded:
                out.append(pa.array(decoded, pa.string()))
            yield pa.RecordBatch.from_arrays(out, schema=schema)

    return docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).mapInArrow(encode, kinds)
