"""Numpy kernels over the UTF-8 bytes of many texts, fed from Arrow string columns.

A word is a run of bytes other than space and 0x09-0x0D. Words are hashed by a polynomial over
random byte values modulo 2**64 and then mixed, so equal words have equal hashes wherever they stand.
Work is cut at word ends into pieces of bounded size, so long texts need no more memory than short ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 1 << 17
U64 = np.uint64

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


class Hasher:
    """One member of a family of 64-bit hashes of words and word sequences."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.values = rng.integers(1, 1 << 63, 256, dtype=U64) * U64(2) + U64(1)
        self.base = U64(int(rng.integers(1 << 40, 1 << 62)) * 4 + 3)
        self.step = U64(int(rng.integers(1 << 40, 1 << 62)) * 4 + 3)
        self.powers = self.inverses = np.ones(1, dtype=U64)

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            inverse = U64(pow(int(self.base), -1, 1 << 64))
            self.powers = np.cumprod(np.concatenate([[U64(1)], np.full(n, self.base)]), dtype=U64)
            self.inverses = np.cumprod(np.concatenate([[U64(1)], np.full(n, inverse)]), dtype=U64)

    def words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of the words of data at [start, end)."""
        out = np.empty(len(starts), dtype=U64)
        first = 0
        while first < len(starts):
            last = max(first + 1, int(np.searchsorted(ends, starts[first] + PIECE, side="right")))
            low, high = int(starts[first]), int(ends[last - 1])
            self._grow(high - low + 1)
            sums = np.zeros(high - low + 1, dtype=U64)
            np.cumsum(self.values[data[low:high]] * self.powers[: high - low], out=sums[1:])
            s, e = starts[first:last] - low, ends[first:last] - low
            out[first:last] = (sums[e] - sums[s]) * self.inverses[s]
            first = last
        return mix(out)

    def runs(self, words: np.ndarray, k: int) -> np.ndarray:
        """Hashes of every k consecutive words; shorter by k - 1 than words."""
        n = len(words) - k + 1
        if n <= 0:
            return np.empty(0, dtype=U64)
        total = words[:n].copy()
        for i in range(1, k):
            total *= self.step
            total += words[i : n + i]
        return mix(total)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the len + 1 offsets into them; null texts are empty."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    column = column.fill_null("") if column.null_count else column
    if not len(column):
        return np.empty(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def bounded_slices(batch: pa.RecordBatch, column: int, rows: int, size: int = 1 << 25) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of at most so many rows and about as many bytes in a text or binary column; a longer value stands alone."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(batch):
        before = int(ends[at - 1]) if at else 0
        n = max(1, min(rows, int(np.searchsorted(ends, before + size, side="right")) - at))
        yield batch.slice(at, n)
        at += n


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, none of which reaches over two texts, and len + 1 offsets of each text's words."""
    solid = ~SPACE[data]
    start, end = solid.copy(), solid.copy()
    start[1:] &= ~solid[:-1]
    end[:-1] &= ~solid[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    start[cuts] = solid[cuts]
    end[cuts - 1] = solid[cuts - 1]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offsets)


def text_chunks(offsets: np.ndarray, size: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about size bytes (what fits into caches); a longer text stands alone."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, side="right")) - 1)
        yield first, last
        first = last
