"""Byte-level BPE encoding and decoding by ranks.

A piece (one match of the pattern) is encoded without replaying merges: its bytes, mapped to Latin-1,
run through an Aho-Corasick automaton of all tokens for the longest token from each place; the
encoder takes the longest token that may follow the last one and backtracks to shorter ones. Whether
two tokens may stand side by side is decided by splitting them back along the merges that made them,
and remembered. The result is what merging by rank gives, in time linear in the piece.

Encodings of stretches between single spaces are remembered in a bounded table, since a space before a
visible character always begins a piece.

Defined results: null and empty texts have no ids, decoded to no bytes. Long texts are encoded whole. Repeated rows, and rows without an id, are
encoded each; an empty table gives none. Extra columns are not read. Ranks must hold all 256 bytes.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tidewatch.llm.textops import bounded_slices

#: Marks that form a piece of their own after a word.
PLAIN = frozenset(".,;:!?)")
#: A space before another white space or at the end: there a space alone doesn't begin a piece.
LOOSE = re.compile(r" (?:\s|\Z)")


class RankEncoder:
    """Exact byte-level BPE over the tokens of a ranks table."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, memory: int = 100_000):
        self.pattern, self.memory = regex.compile(pattern), memory
        self.token = {i: t.decode("latin-1") for t, i in ranks.items()}
        self.bytes_of = {i: t for t, i in ranks.items()}
        self.rank = {t: i for i, t in self.token.items()}
        self.automaton = ahocorasick.Automaton()
        for text, i in self.rank.items():
            self.automaton.add_word(text, i)
        self.automaton.make_automaton()
        self.size = {i: len(t) for i, t in self.token.items()}
        self.packed = {i: i.to_bytes(4, "little") for i in self.token}
        self.sizes = np.zeros(max(self.token) + 1, dtype=np.int64)
        self.sizes[list(self.size)] = list(self.size.values())
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.flat = np.frombuffer(b"".join(self.bytes_of[i] for i in sorted(self.bytes_of)), dtype=np.uint8)
        self.split: dict[int, tuple[int, int] | None] = {}
        self.fits: dict[tuple[int, int], bool] = {}
        self.shorter: dict[int, int | None] = {}
        self.stretches: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def parts(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one, None for a byte: replaying merges within the token leaves them last."""
        if token not in self.split:
            text = self.token[token]
            parts, rank = list(text), self.rank
            while len(parts) > 2:
                best = min(range(len(parts) - 1), key=lambda i: rank.get(parts[i] + parts[i + 1], 1 << 40))
                if parts[best] + parts[best + 1] not in rank:
                    raise ValueError("a token that no merges make")
                parts[best : best + 2] = [parts[best] + parts[best + 1]]
            self.split[token] = (rank[parts[0]], rank[parts[1]]) if len(parts) == 2 else None
        return self.split[token]

    def may_follow(self, left: int, right: int) -> bool:
        """Whether encoding the two tokens' bytes together gives just these two."""
        key = (left, right)
        if (known := self.fits.get(key)) is not None:
            return known
        if len(self.fits) >= 2 * self.memory:
            self.fits.clear()
        limit, good = 1 << 40, True
        while True:
            joined = self.rank.get(self.token[left] + self.token[right], limit)
            if joined < limit:
                good = False
                break
            # the later made token is taken apart first; of equal pairs the left one merges first, hence right + 1
            turns = ("left", "right") if left > right else ("right", "left")
            for side in turns:
                parts = self.parts(left if side == "left" else right)
                if parts is not None:
                    break
            else:
                break
            if side == "left":
                limit, left = left, parts[1]
            else:
                limit, right = right + 1, parts[0]
        self.fits[key] = good
        return good

    def next_shorter(self, token: int) -> int | None:
        """The longest token that is a proper prefix of this one."""
        if token not in self.shorter:
            text = self.token[token]
            self.shorter[token] = next((self.rank[text[:n]] for n in range(len(text) - 1, 0, -1) if text[:n] in self.rank), None)
        return self.shorter[token]

    def encode_piece(self, piece: bytes) -> list[int]:
        text = piece.decode("latin-1")
        if (whole := self.rank.get(text)) is not None:
            return [whole]
        out = [token for _, token in self.automaton.iter_long(text)]
        fits = self.fits
        for i, pair in enumerate(zip(out, out[1:])):
            if not (fits[pair] if pair in fits else self.may_follow(*pair)):
                return self.backtrack(text, out[: i + 1], out[i + 1])
        return out

    def backtrack(self, text: str, out: list[int], now: int | None) -> list[int]:
        """The encoding whose first tokens are out, as far as is known, where `now` doesn't fit."""
        size, fits, shorter, longest = self.size, self.fits, self.shorter, self.automaton.iter_long
        dead, n, last = set(), len(text), out[-1]
        at = sum(map(size.__getitem__, out))
        while True:
            end = at + size[now]
            if end not in dead:
                pair = (last, now)
                if last is None or (fits[pair] if pair in fits else self.may_follow(last, now)):
                    out.append(now)
                    if end == n:
                        return out
                    at, last = end, now
                    _, now = next(longest(text, end))  # each byte is a token, so this one begins at once
                    continue
            now = shorter[now] if now in shorter else self.next_shorter(now)
            while now is None:  # no token fits here: this place is dead, go back
                dead.add(at)
                now = out.pop()
                at -= size[now]
                last = out[-1] if out else None
                now = self.next_shorter(now)

    def encode_stretch(self, text: str) -> bytes:
        """The ids of a text that stands between safe cuts, as little-endian unsigned 32-bit integers."""
        word = text[1:] if text[:1] == " " else text
        if word.isalpha():  # one piece: a run of letters, with or without its space
            return self.packed_piece(text)
        if word[-1:] in PLAIN and word[:-1].isalpha():
            return self.packed_piece(text[:-1]) + self.packed_piece(text[-1])
        return b"".join(map(self.packed_piece, self.pattern.findall(text)))

    def packed_piece(self, piece: str) -> bytes:
        if (ids := self.pieces.get(piece)) is None:
            packed = self.packed
            ids = b"".join([packed[i] for i in self.encode_piece(piece.encode())])
            if len(piece) <= 64:
                if len(self.pieces) >= self.memory:
                    self.pieces.clear()
                self.pieces[piece] = ids
        return ids

    def remembered(self, text: str) -> bytes:
        """The ids of a space and text."""
        if (ids := self.older.get(text)) is None:
            ids = self.encode_stretch(" " + text)
        if len(text) <= 64:
            if len(self.stretches) >= self.memory:
                self.older, self.stretches = self.stretches, {}
            self.stretches[text] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if LOOSE.search(text):
            cuts = [m.start() for m in SAFE.finditer(text)]
            ends = [*cuts, len(text)]
            parts = [text[: ends[0]], *(text[a + 1 : b] for a, b in zip(cuts, ends[1:], strict=True))]
        else:
            parts = text.split(" ")
        known = list(map(self.stretches.get, parts))
        known[0] = self.encode_stretch(parts[0])
        if None in known:
            for i, ids in enumerate(known):
                if ids is None:
                    known[i] = self.remembered(parts[i])
        return b"".join(known)

    def decode(self, ids: bytes) -> bytes:
        """The bytes that the ids stand for, gathered from all tokens' bytes laid end to end."""
        at = np.frombuffer(ids, dtype="<u4").astype(np.int64)
        sizes = self.sizes[at]
        ends = np.cumsum(sizes)
        where = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[at] - ends + sizes, sizes)
        return self.flat[where].tobytes()


#: Where a text with loose spaces may still be cut: a single space between visible characters.
SAFE = re.compile(r"(?<=\S) (?=\S)")


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> RankEncoder:
    """One encoder for each worker process."""
    return RankEncoder(load_ranks(path), pattern)


def encode_column(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id and ids, the text's token ids as little-endian unsigned 32-bit integers in a binary column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, pattern).encode
        for batch in batches:
            for part in bounded_slices(batch, 1, 1000):
                ids = pa.array([encode(t or "") for t in part.column(1).to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), ids], names=["id", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text).mapInArrow(run, f"id {kind}, ids binary").withColumnRenamed("id", id_col)


def decode_column(encoded: DataFrame, path: str, pattern: str, id_col: str = "doc_id") -> DataFrame:
    """id, ids and data, the bytes that the ids stand for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = encoder(path, pattern).decode
        for batch in batches:
            for part in bounded_slices(batch, 1, 1000):
                data = pa.array([decode(x) for x in part.column(1).to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), data], names=["id", "ids", "data"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(id_col, "ids").mapInArrow(run, f"id {kind}, ids binary, data binary").withColumnRenamed("id", id_col)

