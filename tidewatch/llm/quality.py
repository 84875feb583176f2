"""Document quality by gradient-boosted trees over document statistics.

Statistics (sizes, character classes, repeated words and lines) are counted with numpy over whole texts. Trees
are grown on histograms of binned statistics, level by level, and flattened into arrays that numpy
walks for all documents at once. Only the fit runs on the driver, on statistics of at most `sample_rows`
labelled rows, chosen by a hash of their doc_id.

Defined results: null and empty texts have zero statistics and a score like any other. Labels that are null or for
absent documents are ignored; of several labels for a doc_id the greatest counts. Without usable
labels every score is 0.5. Repeated rows are scored each. Extra columns are carried, but for ones named score or predicted, which
the results replace. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.textops import U64, Hasher, string_buffers, text_chunks, word_spans

SAMPLE_ROWS, THRESHOLD = 20_000, 0.7
#: Character classes whose part of the bytes is a statistic.
CLASSES = {
    "upper": range(ord("A"), ord("Z") + 1),
    "lower": range(ord("a"), ord("z") + 1),
    "digit": range(ord("0"), ord("9") + 1),
    "stop": b".,;:",
    "shout": b"!?",
    "symbol": b"#$%&*@^~_=+<>",
    "bar": b"|\\/",
    "bracket": b"()[]{}\"'",
    "space": b" \t\n\r\x0b\x0c",
    "line": b"\n",
    "high": range(0x80, 0x100),
}
STATISTICS = ("bytes", "words", "lines", "word_size", "line_size", *CLASSES, "distinct_words", "distinct_lines", "longest_word", "capital_words", "stopped_words", "shouted_words")


def _lookup(chars) -> np.ndarray:
    table = np.zeros(256, dtype=np.int32)
    table[list(chars)] = 1
    return table


TABLES = {name: _lookup(chars) for name, chars in CLASSES.items()}


@lru_cache(maxsize=1)
def _hasher() -> Hasher:
    return Hasher(515)


def _distinct(hashes: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """How many different hashes each of n texts has; 44 bits of a hash are enough for a statistic."""
    keys = np.sort((of.astype(U64) << U64(44)) | (hashes >> U64(20)))
    new = np.ones(len(keys), dtype=bool)
    new[1:] = keys[1:] != keys[:-1]
    return np.bincount((keys[new] >> U64(44)).astype(np.int64), minlength=n)


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of STATISTICS for each text."""
    data, offsets = string_buffers(texts)
    out = [np.empty((0, len(STATISTICS)))]
    for first, last in text_chunks(offsets):
        ends_at = offsets[first : last + 1] - offsets[first]
        part, n = data[offsets[first] : offsets[last]], last - first
        size = np.diff(ends_at).astype(float)
        per_byte = np.bincount(np.repeat(np.arange(n) << 8, np.diff(ends_at)) + part, minlength=n << 8).reshape(n, 256)
        counts = {name: per_byte @ table for name, table in TABLES.items()}
        starts, ends, word_at = word_spans(part, ends_at)
        n_words = np.diff(word_at)
        of = np.repeat(np.arange(n), n_words)
        words = _hasher().words(part, starts, ends)
        length = ends - starts
        longest = np.zeros(n)
        np.maximum.at(longest, of, length)
        summed = lambda flags: np.bincount(of, weights=flags, minlength=n)
        breaks = np.flatnonzero(part == 0x0A)
        line_ends = np.union1d(breaks, ends_at[1:][size > 0]) if len(part) else breaks
        line_starts = np.concatenate([[0], line_ends[:-1] + (part[np.minimum(line_ends[:-1], len(part) - 1)] == 0x0A)]) if len(line_ends) else line_ends
        full = line_starts < line_ends
        line_starts, line_ends = line_starts[full], line_ends[full]
        line_of = np.searchsorted(ends_at, line_starts, side="right") - 1
        n_lines = np.bincount(line_of, minlength=n)
        lines = _hasher().words(part, line_starts, line_ends)
        some = lambda x, y: np.divide(x, y, out=np.zeros(n), where=y > 0)
        cols = [size, n_words, n_lines, some(summed(length), n_words), some(size, n_lines)]
        cols += [some(counts[name], size) for name in CLASSES]
        cols += [some(_distinct(words, of, n), n_words), some(_distinct(lines, line_of, n), n_lines), longest]
        cols += [some(summed(TABLES["upper"][part[starts]]), n_words), some(summed(TABLES["stop"][part[ends - 1]]), n_words), some(summed(TABLES["shout"][part[ends - 1]] | TABLES["symbol"][part[ends - 1]]), n_words)]
        out.append(np.stack(cols, axis=1).astype(float))
    return np.concatenate(out)


@dataclass
class Trees:
    """Binary trees of one depth, flattened: node i of a tree has the children 2i + 1 and 2i + 2."""

    depth: int
    base: float
    feature: np.ndarray  # (trees, inner nodes)
    threshold: np.ndarray  # (trees, inner nodes)
    value: np.ndarray  # (trees, leaves)

    def margin(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, threshold, value in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += value[node - (2**self.depth - 1)]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, ridge: float = 1.0, least: float = 2.0) -> Trees:
    """Trees that lower the logistic loss of y (0 or 1), grown on histograms of gradients."""
    inner, leaves = 2**depth - 1, 2**depth
    if not len(y) or y.min() == y.max():
        base = 0.0 if not len(y) else float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
        return Trees(depth, base, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)))
    n, k = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for j in range(k)]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)  # bin b holds x <= cuts[b]
    base = float(np.log(y.mean() / (1 - y.mean())))
    margin, model = np.full(n, base), Trees(depth, base, np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves)))
    place = (np.arange(k) * bins)[None, :] + binned
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = y - p, p * (1 - p)
        node = np.zeros(n, dtype=np.int64)
        for level in range(depth):
            start, width = 2**level - 1, 2**level
            at = ((node - start)[:, None] * (k * bins) + place).ravel()
            g = np.bincount(at, np.repeat(grad, k), width * k * bins).reshape(width, k, bins)
            h = np.bincount(at, np.repeat(hess, k), width * k * bins).reshape(width, k, bins)
            gl, hl = g.cumsum(axis=2), h.cumsum(axis=2)
            gt, ht = gl[:, :1, -1:], hl[:, :1, -1:]
            gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
            gain[(hl < least) | (ht - hl < least)] = 0
            best = gain.reshape(width, -1).argmax(axis=1)
            for i, b in enumerate(best.tolist()):
                j, cut = divmod(b, bins)
                if gain[i, j, cut] > 1e-6 and cut < len(cuts[j]):
                    model.feature[t, start + i], model.threshold[t, start + i] = j, cuts[j][cut]
            node = 2 * node + 1 + (x[np.arange(n), model.feature[t, node]] > model.threshold[t, node])
        leaf = node - inner
        model.value[t] = rate * np.bincount(leaf, grad, leaves) / (np.bincount(leaf, hess, leaves) + ridge)
        margin += model.value[t][leaf]
    return model


def learnable(labels: DataFrame, column: str, parts: int, held: int, sample_rows: int) -> DataFrame:
    """doc_id and label of at most sample_rows rows, none with crc32(doc_id) mod parts = held."""
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(column).isin(0, 1)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("label"))
    rows = rows.where(F.crc32(F.col("doc_id").cast("string")) % parts != held).groupBy("doc_id").agg(F.max("label").alias("label"))
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)


def held_out(parts: int, held: int):
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % parts == held, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Trees:
    """Trees fitted on the learnable labels of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = statistics(batch.column(2))
            rows = pa.array(list(x), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), rows], names=["doc_id", "label", "x"])

    chosen = F.broadcast(learnable(labels, "quality", 4, 2, sample_rows))  # at most sample_rows rows
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(chosen, "doc_id").select("doc_id", "label", "text")
    rows = sorted(known.mapInArrow(run, "doc_id long, label int, x array<double>").collect())
    x = np.array([r.x for r in rows]).reshape(len(rows), len(STATISTICS))
    return fit(x, np.array([r.label for r in rows], dtype=float))


def score(docs: DataFrame, model: Trees, threshold: float = THRESHOLD) -> DataFrame:
    """docs with score and predicted appended; columns of these names are replaced."""
    docs = docs.drop("score", "predicted")
    at, names = docs.columns.index("text"), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = model.score(statistics(batch.column(at)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=[*names, "score", "predicted"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{kinds}, score double, predicted int")
