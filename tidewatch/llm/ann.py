"""Approximate nearest neighbours by an inverted multi-index.

Both halves of a normalised vector are quantised with codebooks of their own; a vector's cell is the pair of its
centroids. A query visits centroid pairs by ascending summed distance, kept in a heap, until the cells
seen hold its fraction of all entries, and reranks these entries by exact cosine in double precision.

Queries are dealt into blocks by their own first centroid, neighbouring ones together, so that those of a block visit much
the same cells; an entry goes to the blocks that visit its cell and to no other. There both meet by the first centroid, in
blocks of bounded size, so only a query's few best entries of a block are rows of the result. Equal query vectors are searched once. Repeated rows (same id, same vector) are one
entry; of equal vectors the k + 1 with the smallest ids are kept: ties go to smaller ids, so no other copy can be in a
result. Places go to different ids: an id with several vectors has one, by its nearest.

Only a sample (at most `sample_rows` vectors, chosen by a hash of their id) and the number of entries in each cell go
through the driver. On the sample the codebooks are fitted, and the fraction of entries that a query has to see is
measured there against brute force: over half where vectors have no structure, far less where they are clustered.

Defined results: rows without an id, and vectors that are null, zero, of another length than most, or hold null or
non-finite components, take no part. An id is never its own neighbour, repeated or not. Extra columns
are not read. An empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SAMPLE_ROWS, ENTRY_BLOCK, QUERY_BLOCK = 20_000, 8_000, 2_000
#: More than rounding changes a cosine by.
SLACK = 1e-9
#: Part of the true neighbours that the fraction of visited entries is chosen for, on how many queries, and the least fraction.
TARGET, TRIALS, LEAST_FRACTION = 0.97, 300, 0.02
RESULT = "query_id long, rank int, vec_id long, score double"


def centroids(x: np.ndarray, k: int, rounds: int = 15, seed: int = 1) -> np.ndarray:
    """k-means centroids; an empty cluster keeps its centroid."""
    at = np.random.default_rng(seed).choice(len(x), min(k, len(x)), replace=False)
    c = x[at].copy()
    for _ in range(rounds):
        near = distances(x, c).argmin(axis=1)
        size = np.bincount(near, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c[size > 0] = sums[size > 0] / size[size > 0][:, None]
    return c


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances, without each x's own constant."""
    return (c**2).sum(axis=1)[None, :] - 2 * x @ c.T


def traverse(one: np.ndarray, two: np.ndarray, counts: np.ndarray, want: float) -> list[tuple[int, int]]:
    """Pairs by ascending one[i] + two[j] until their cells hold at least `want` entries."""
    by1, by2 = np.argsort(one), np.argsort(two)
    heap, seen, out, held = [(one[by1[0]] + two[by2[0]], 0, 0)], {(0, 0)}, [], 0
    while heap and held < want:
        _, a, b = heapq.heappop(heap)
        i, j = int(by1[a]), int(by2[b])
        if counts[i, j]:
            out.append((i, j))
            held += int(counts[i, j])
        for c, d in ((a + 1, b), (a, b + 1)):
            if c < len(by1) and d < len(by2) and (c, d) not in seen:
                seen.add((c, d))
                heapq.heappush(heap, (one[by1[c]] + two[by2[d]], c, d))
    return out


def needed_fraction(x: np.ndarray, books: tuple[np.ndarray, np.ndarray], half: int, k: int) -> float:
    """The fraction of entries, in the order of visiting, that holds TARGET of the k true neighbours of some rows of x."""
    d1, d2 = distances(x[:, :half], books[0]), distances(x[:, half:], books[1])
    cell = d1.argmin(axis=1) * len(books[1]) + d2.argmin(axis=1)
    counts, needs = np.bincount(cell, minlength=len(books[0]) * len(books[1])), []
    for i in np.linspace(0, len(x) - 1, min(TRIALS, len(x))).astype(int):
        near = x @ x[i]
        near[i] = -np.inf
        best = np.argsort(-near)[: min(k, len(x) - 1)]
        order = np.argsort((d1[i][:, None] + d2[i][None, :]).ravel())
        seen = np.empty(len(counts))
        seen[order] = np.cumsum(counts[order])
        needs.extend(seen[cell[best]] / len(x))
    return float(np.clip(np.quantile(needs, TARGET), LEAST_FRACTION, 1)) if needs else 1.0


def chain(c: np.ndarray) -> list[int]:
    """The centroids in an order in which neighbours are near: each time the nearest that is left."""
    order, left = [0], set(range(1, len(c)))
    while left:
        rest = sorted(left)
        order.append(rest[int(((c[rest] - c[order[-1]]) ** 2).sum(axis=1).argmin())])
        left.remove(order[-1])
    return order


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of an array column of one length."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = pa.concat_arrays(flat.chunks) if isinstance(flat, pa.ChunkedArray) else flat
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1) if len(flat) else np.empty((0, 1))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows divided by their norms, after a scaling that keeps huge and tiny values finite."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def nearest_ids(near: np.ndarray, u: np.ndarray, x: np.ndarray, ids: np.ndarray, places: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the entries x, the `places` different ids nearest to u and their cosines; near has the cosines but for rounding, or -inf."""
    top = 3 * places
    while True:
        top = min(top, len(near))
        some = np.argpartition(-near, top - 1)[:top]
        some = some[np.argsort(-near[some])]
        firsts = np.sort(np.unique(ids[some], return_index=True)[1])
        if len(firsts) >= places or top == len(near):
            break
        top *= 4
    floor = near[some[firsts[places - 1]]] if len(firsts) >= places else -np.inf
    fit = np.flatnonzero((near >= floor - SLACK) & np.isfinite(near))
    scores = (u * x[fit]).sum(axis=1)  # equal rows give equal sums, unlike a matrix product
    order = np.lexsort((ids[fit], -scores))
    firsts = np.sort(np.unique(ids[fit][order], return_index=True)[1])[:places]
    return ids[fit][order][firsts], scores[order][firsts]


def usable(vectors: DataFrame, id_col: str, vector: str) -> DataFrame:
    """vec_id and x (doubles) of the rows that take part."""
    bad = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    rows = vectors.where(F.col(id_col).isNotNull() & F.col(vector).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("x"))
    rows = rows.where(~F.exists("x", bad) & F.exists("x", lambda v: v != 0))
    common = rows.groupBy(F.size("x").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("x") == (common["n"] if common else 0))


def nearest(spark: SparkSession, vectors: DataFrame, every: int = 50, k: int = 5, id_col: str = "vec_id", vector: str = "embedding", fraction: float | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for each row whose id is divisible by `every`."""
    given = usable(vectors, id_col, vector)
    rows, n = given.distinct(), given.count()
    if not n:
        return spark.createDataFrame([], RESULT)
    sample = unit(np.array([r.x for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows).collect()]))
    half, size = (sample.shape[1] + 1) // 2, int(np.clip(np.sqrt(n / 50), 1, 256))
    books = centroids(sample[:, :half], size), centroids(sample[:, half:], size) if sample.shape[1] > 1 else np.zeros((1, 0))
    k1, k2 = len(books[0]), len(books[1])
    fraction = needed_fraction(sample, books, half, k) if fraction is None else fraction

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = unit(matrix(batch.column(1)))
            if len(batch):
                c1, c2 = distances(x[:, :half], books[0]).argmin(axis=1), distances(x[:, half:], books[1]).argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(c1.astype(np.int32)), pa.array(c2.astype(np.int32))], names=["vec_id", "x", "c1", "c2"])

    first = F.row_number().over(Window.partitionBy("x").orderBy("vec_id"))
    entries = rows.withColumn("copy", first).where(F.col("copy") <= k + 1).select("vec_id", "x").mapInArrow(assign, "vec_id long, x array<double>, c1 int, c2 int")
    counts = np.zeros((k1, k2), dtype=np.int64)
    for r in entries.groupBy("c1", "c2").count().collect():  # at most one row per cell
        counts[r.c1, r.c2] = r["count"]
    want = max(fraction * counts.sum(), 50 * (k + 1))
    blocks = -(-counts.sum(axis=1) // ENTRY_BLOCK)  # of each first centroid

    asked = given.where(F.col("vec_id") % every == 0)
    distinct = asked.groupBy("x").agg(F.min("vec_id").alias("q"))
    placed = distinct.select("q", "x").mapInArrow(assign, "vec_id long, x array<double>, c1 int, c2 int").withColumnRenamed("vec_id", "q")
    asking, start = {r.c1: r["count"] for r in placed.groupBy("c1").count().collect()}, {}  # at most one row per first centroid
    for c in chain(books[0]):
        start[c] = sum(asking.get(o, 0) for o in start)
    look = lambda table: F.get(F.array(*(F.lit(int(table.get(c, 0))).cast("long") for c in range(k1))), F.col("c1"))
    qb = F.floor((look(start) + F.pmod(F.xxhash64("q"), F.greatest(look(asking), F.lit(1)))) / QUERY_BLOCK).cast("int")

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, at, one, block, twos = matrix(batch.column(1)), [], [], [], []
            if not len(batch):
                continue
            u = unit(x)
            d1, d2 = distances(u[:, :half], books[0]), distances(u[:, half:], books[1])
            for i in range(len(batch)):
                cells: dict[int, list[int]] = {}
                for a, b in traverse(d1[i], d2[i], counts, want):
                    cells.setdefault(a, []).append(b)
                for a, bs in cells.items():
                    for e in range(blocks[a]):
                        at.append(i)
                        one.append(a)
                        block.append(e)
                        twos.append(bs)
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(at, pa.int64())) for c in (batch.column(0), batch.column(1), batch.column(2))), pa.array(one, pa.int32()), pa.array(block, pa.int32()), pa.array(twos, pa.list_(pa.int32()))], names=["q", "x", "qb", "c1", "eb", "c2s"])

    queries = placed.select("q", "x", qb.alias("qb")).mapInArrow(visit, "q long, x array<double>, qb int, c1 int, eb int, c2s array<int>")
    visited = queries.select("c1", F.explode("c2s").alias("c2"), F.col("qb").alias("to")).distinct()
    dealt = F.array(*(F.lit(int(b)) for b in blocks))
    entries = entries.withColumn("eb", F.pmod(F.xxhash64("vec_id"), F.greatest(F.get(dealt, F.col("c1")), F.lit(1))).cast("int")).join(visited, ["c1", "c2"]).select("vec_id", "x", "c1", "c2", "eb", F.col("to").alias("qb"))

    def rerank(asked: pa.Table, held: pa.Table) -> pa.Table:
        out_q, out_v, out_s = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]
        if len(asked) and len(held):
            x, ids, c2 = unit(matrix(held.column("x"))), held.column("vec_id").to_numpy(), held.column("c2").to_numpy()
            q, u = asked.column("q").to_numpy(), unit(matrix(asked.column("x")))
            c2s = asked.column("c2s").to_pylist()
            for at in range(0, len(q), 200):
                allowed = np.zeros((min(200, len(q) - at), k2), dtype=bool)
                for i, cells in enumerate(c2s[at : at + 200]):
                    allowed[i, cells] = True
                near = np.where(allowed[:, c2], u[at : at + 200] @ x.T, -np.inf)
                for i in range(len(near)):
                    best, scores = nearest_ids(near[i], u[at + i], x, ids, k + 1)
                    out_q.append(np.full(len(best), q[at + i]))
                    out_v.append(best)
                    out_s.append(scores)
        return pa.table([pa.array(np.concatenate(c)) for c in (out_q, out_v, out_s)], names=["q", "vec_id", "score"])

    keys = ("c1", "eb", "qb")
    found = queries.groupBy(*keys).cogroup(entries.groupBy(*keys)).applyInArrow(rerank, "q long, vec_id long, score double")
    order = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    found = found.groupBy("q", "vec_id").agg(F.max("score").alias("score")).withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1).drop("r")
    members = asked.join(distinct, "x").select(F.col("vec_id").alias("query_id"), "q").distinct()
    own = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    pairs = members.join(found, "q").where("query_id != vec_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= k)
    return pairs.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
