"""Best-fit packing of tokenised documents into sequences, improved by swaps.

The order of documents plays no part in how full bins get, only their lengths do. So packing runs on
the histogram of piece lengths, which has at most as many entries as a sequence has tokens, however
large the corpus: equal bins are one group with a count. Best-fit decreasing fills the bins; a local search then
moves documents, or exchanges one for one or two for one, between groups of
underfull bins as long as the sum of squared fills grows, until bins come empty. It takes from the emptiest bins first, finds
partners through an index of what stands in bins with how much free space, and ends when the sequences
are as few as the tokens allow or when no underfull bin has a trade left. Documents are then dealt to places by
their rank among the pieces of their length, which is counted in parallel over lengths salted by their count.

The search runs on the driver. STEPS bounds its trades, so its time, at any corpus size; what it would still
have saved beyond that stays as it is, and every piece is packed all the same. README has measured numbers.

Defined results: null and empty texts have one piece, the end token. Repeated rows are packed each, rows without a doc_id too.
Texts longer than a sequence are cut into whole sequences after a first piece that may be shorter.
Extra columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.llm.bpe import load_ranks
from tidewatch.llm.shelf import Shelf

CAPACITY, END_ID = 2048, 0
#: Most trades of the search, and how many pieces of one length have a salt of their own.
STEPS, SALT_ROWS = 100_000, 1_000
MARK, MARK_ID = "<|endoftext|>", 50256


@lru_cache(maxsize=2)
def token_encoder(path: str, pattern: str):
    """Ids of a text under the tokenizer whose ranks are at path; its special mark becomes one id, as the `tokenizers` library has it."""
    import tiktoken

    encode = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=load_ranks(path), special_tokens={}).encode_ordinary

    def ids(text: str) -> list[int]:
        first, *rest = text.split(MARK)
        out = encode(first)
        for part in rest:
            out.append(MARK_ID)
            out.extend(encode(part))
        return out

    return ids


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids; only the first may be shorter than the capacity if there are several."""
    first = n % capacity or capacity
    return [(0, min(n, first)), *((at, capacity) for at in range(first, n, capacity))]


def pieces(docs: DataFrame, path: str, pattern: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = token_encoder(path, pattern)
        for batch in batches:
            row, out = [], []
            for i, text in enumerate(batch.column(1)):
                ids = np.array([*encode(text.as_py() or ""), END_ID], dtype="<u4")
                for k, (start, length) in enumerate(cut(len(ids), capacity)):
                    row.append(i)
                    out.append((k, start, length, zlib.crc32(ids[start : start + length].tobytes())))
            cols = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), pa.array(cols[0], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[1:])], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


class Index:
    """Bins by a number (a length in them, or the sum of two) and by what is free in them."""

    def __init__(self) -> None:
        self.bins: dict[int, dict[int, set[tuple[int, ...]]]] = {}
        self.keys: list[int] = []
        self.frees: dict[int, list[int]] = {}

    def add(self, key: int, free: int, bin_: tuple[int, ...]) -> None:
        if key not in self.bins:
            self.bins[key], self.frees[key] = {}, []
            insort(self.keys, key)
        if free not in self.bins[key]:
            self.bins[key][free] = set()
            insort(self.frees[key], free)
        self.bins[key][free].add(bin_)

    def drop(self, key: int, free: int, bin_: tuple[int, ...]) -> None:
        held = self.bins[key][free]
        held.discard(bin_)
        if not held:
            del self.bins[key][free]
            self.frees[key].pop(bisect_left(self.frees[key], free))
            if not self.bins[key]:
                del self.bins[key], self.frees[key]
                self.keys.pop(bisect_left(self.keys, key))

    def tightest(self, key: int, least: int, most: int, fit) -> tuple[int, ...] | None:
        """Of the bins with this number and between least and most free, the fullest that fits."""
        frees = self.frees.get(key, ())
        for at in range(bisect_left(frees, least), bisect_right(frees, most)):
            if found := min(filter(fit, self.bins[key][frees[at]]), default=None):
                return found
        return None


class Bins:
    """Groups of equal bins: contents (descending lengths) -> how many, ordered by what is free."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.count: dict[tuple[int, ...], int] = {}
        self.whole, self.one, self.two = Index(), Index(), Index()

    def _index(self, bin_: tuple[int, ...], put: bool) -> None:
        free = self.capacity - sum(bin_)
        for index, keys in ((self.whole, (0,)), (self.one, set(bin_)), (self.two, pair_sums(bin_))):
            if index is self.whole or free:  # a full bin takes part in no trade
                for key in keys:
                    (index.add if put else index.drop)(key, free, bin_)

    def add(self, bin_: tuple[int, ...], n: int) -> None:
        if n and bin_:
            if bin_ not in self.count:
                self._index(bin_, True)
            self.count[bin_] = self.count.get(bin_, 0) + n

    def take(self, bin_: tuple[int, ...], n: int) -> None:
        self.count[bin_] -= n
        if not self.count[bin_]:
            del self.count[bin_]
            self._index(bin_, False)


def pair_sums(bin_: tuple[int, ...]) -> dict[int, tuple[int, int]]:
    """The sums of two lengths of a bin, each with such a pair."""
    sizes = sorted(set(bin_), reverse=True)
    found = {2 * x: (x, x) for x in sizes if bin_.count(x) > 1}
    return found | {x + y: (x, y) for i, x in enumerate(sizes) for y in sizes[i + 1 :]}


def best_fit(histogram: dict[int, int], capacity: int) -> Bins:
    """Best-fit decreasing over lengths with counts."""
    bins = Bins(capacity)
    for size in sorted(histogram, reverse=True):
        left = histogram[size]
        while left:
            target = bins.whole.tightest(0, size, capacity, lambda _: True)
            if target is None:
                per = min(capacity // size, left)
                bins.add((size,) * per, left // per)
                left %= per
                continue
            fit = (capacity - sum(target)) // size  # as many of this length as one such bin takes
            if fit <= left:
                n = min(bins.count[target], left // fit)
            else:
                fit, n = left, 1
            bins.take(target, n)
            bins.add(target + (size,) * fit, n)
            left -= fit * n
    return bins


Trade = tuple[tuple[int, ...], tuple[int, ...], tuple[int, ...]]


def trade(bins: Bins, low: tuple[int, ...]) -> Trade | None:
    """A bin no emptier than low, what it gives and what it gets from low, so that it gains most: a move, one for one, or two for one."""
    free = bins.capacity - sum(low)
    fit = lambda b: b != low or bins.count[low] > 1
    best, found = 0, None
    singles = {x: (x,) for x in set(low)}
    for gets in (singles, pair_sums(low)):
        for total, mine in gets.items():
            for index in (bins.whole, bins.one, bins.two) if gets is singles else (bins.one,):
                keys = index.keys
                for at in range(bisect_left(keys, total - free), len(keys)):
                    gain = total - keys[at]
                    if gain <= best:
                        break
                    if partner := index.tightest(keys[at], gain, free, fit):
                        gives = () if index is bins.whole else (keys[at],) if index is bins.one else pair_sums(partner)[keys[at]]
                        best, found = gain, (partner, gives, mine)
                        break
    return found


def swapped(bin_: tuple[int, ...], gives: tuple[int, ...], gets: tuple[int, ...]) -> tuple[int, ...]:
    left = list(bin_)
    for x in gives:
        left.remove(x)
    return tuple(sorted([*left, *gets], reverse=True))


def fewest(histogram: dict[int, int], capacity: int) -> int:
    """The number of sequences that the tokens fill at least."""
    return -(-sum(size * n for size, n in histogram.items()) // capacity)


def local_search(bins: Bins, steps: int = STEPS) -> Bins:
    """Trades between underfull bins that raise the sum of squared fills, from the emptiest bins on, until bins can't get fewer or nothing trades."""
    capacity = bins.capacity
    least = -(-sum(sum(b) * n for b, n in bins.count.items()) // capacity)
    total, traded = sum(bins.count.values()), True
    while traded and total > least:
        traded = False
        for low in sorted((b for b in bins.count if sum(b) < capacity), key=lambda b: (sum(b), b)):
            while low in bins.count and low and steps > 0 and total > least and (found := trade(bins, low)):
                full, gives, gets = found
                n = min(bins.count[full], bins.count[low]) if full != low else bins.count[low] // 2
                bins.take(full, n)
                bins.take(low, n)
                bins.add(swapped(full, gives, gets), n)
                after = swapped(low, gets, gives)
                bins.add(after, n)
                total -= 0 if after else n
                low, traded, steps = after, True, steps - 1
            if steps <= 0 or total <= least:
                return bins
    return bins


def places(bins: Bins) -> pd.DataFrame:
    """length, first_rank, n, sequence, offset: pieces of this length with ranks from first_rank take that offset in sequences from the one given."""
    rows, sequence, used = [], 0, {}
    for contents, n in sorted(bins.count.items(), key=lambda x: x[0], reverse=True):
        offset = 0
        for size in contents:
            rows.append((size, used.get(size, 0), n, sequence, offset))
            used[size] = used.get(size, 0) + n
            offset += size
        sequence += n
    return pd.DataFrame(rows, columns=["length", "first_rank", "n", "sequence", "offset"]).sort_values(["length", "first_rank"], ignore_index=True)


def ranked(found: DataFrame, histogram: dict[int, int]) -> DataFrame:
    """found with rank, from 0 among the pieces of equal length; counted per length and salt, so a common length is no single task."""
    salts = found.sparkSession.createDataFrame([(size, -(-n // SALT_ROWS)) for size, n in histogram.items()], "length long, salts long")
    salted = found.join(F.broadcast(salts), "length").withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), "salts")).drop("salts")  # at most one row for each length
    counts = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    base = counts.select("length", "salt", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    within = salted.withColumn("k", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")))
    return within.join(base, ["length", "salt"]).withColumn("rank", F.col("base") + F.col("k") - 1).drop("salt", "base", "k")


def pack(spark: SparkSession, docs: DataFrame, path: str, pattern: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of every document."""
    found = Shelf(spark, "packing").put(pieces(docs, path, pattern, capacity))
    histogram = {r["length"]: r["n"] for r in found.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most capacity rows
    table = places(local_search(best_fit(histogram, capacity)))
    if table.empty:  # no documents
        return found.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")})
    keys = table["length"].to_numpy() * (1 << 48) + table["first_rank"].to_numpy()
    first, sequence, offset = (table[c].to_numpy() for c in ("first_rank", "sequence", "offset"))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        at = np.searchsorted(keys, length.to_numpy() * (1 << 48) + rank.to_numpy(), side="right") - 1
        return pd.DataFrame({"sequence_id": sequence[at] + rank.to_numpy() - first[at], "offset": offset[at]})

    return ranked(found, histogram).withColumn("p", place("length", "rank")).select("doc_id", "piece", "start", "length", "ids_crc32", "p.sequence_id", "p.offset")
