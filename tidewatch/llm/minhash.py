"""Near-duplicate documents by SetSketch registers.

Each document's shingle set is sketched by registers that hold exponentially spaced truncated minima:
every element runs a Poisson process whose points fall on random registers, a register keeps
the earliest point t as clamp(floor(1 - log_b t), 0, q + 1). Registers of unions are register-wise
maxima, so sketches are mergeable, and equal registers are the likelier the more alike two sets are.

Documents with equal sets are one node from the start; nodes are numbered in the order of their least doc_id. Nodes that
agree on all registers of a band meet in a bucket. Buckets are first linked by stars: all members against the least. A bucket may then still
hold several components. All outside its most common component are compared with that component and with each other, within
tasks and in blocks of bounded size (in rows and in bytes of text); such a task gives only links that join components, so no pairs within a group
are listed. Where more nodes than a block are outside, as in a family of texts that have much in common but not enough,
they aren't compared block by block with each other: two of them can be similar enough only if they have one of their rarest shingles in common
(those beyond the number that may differ, by how many nodes of such buckets have them), so they are put into buckets by these
and only what meets there is compared. Candidates are filtered by a joint likelihood estimate of their similarity
from both sketches and confirmed on full shingle sets.

With 40 bands of 6 registers a pair of exactly 0.8 similarity meets in no bucket with probability 5e-6.

Defined results: null, empty and blank texts have an empty set and are linked with nothing. Repeated
rows are linked with each other. Rows with one doc_id and different texts are different documents, linked only if their texts are.
Rows without a doc_id have the component of an equal set, else none, and are kept in that case. Long texts are hashed in pieces. Extra
columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.graph import components
from tidewatch.llm.shelf import Shelf
from tidewatch.llm.textops import LOWER, U64, Hasher, bounded_slices, mix, string_buffers, text_chunks, word_spans

BANDS, ROWS, BASE, RATE, Q = 40, 6, 1.001, 20.0, (1 << 16) - 2
REGISTERS = BANDS * ROWS
#: A pair is checked in full if its estimate is within this many standard errors of the threshold.
MARGIN = 5.0
#: Nodes up to which their list is broadcast, members of a block, and rows that a task of blocks gets on average.
BROADCAST_NODES, BLOCK, TASK_ROWS = 1_000_000, 512, 4_000
#: Bytes of text of a block (a longer text is a block of its own), and those that a task of blocks gets on average.
BLOCK_BYTES, TASK_BYTES = 1 << 22, 1 << 24


@lru_cache(maxsize=1)
def _hasher() -> Hasher:
    return Hasher(20240607)


def shingle_sets(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text: k words, or all words where there are fewer."""
    data, offsets = string_buffers(texts)
    for first, last in text_chunks(offsets):
        low, high = offsets[first], offsets[last]
        part = LOWER[data[low:high]]
        starts, ends, word_at = word_spans(part, offsets[first : last + 1] - low)
        words = _hasher().words(part, starts, ends)
        runs = _hasher().runs(words, k)
        for a, b in zip(word_at[:-1].tolist(), word_at[1:].tolist(), strict=True):
            if b - a >= k:
                yield np.unique(runs[a : b - k + 1])
            elif b > a:
                yield _hasher().runs(words[a:b], b - a) ^ U64(b - a)
            else:
                yield words[:0]


def sketch(sets: list[np.ndarray], m: int = REGISTERS) -> np.ndarray:
    """Registers (len(sets), m) of the sets; those of an empty set are zero."""
    sizes = np.array([len(s) for s in sets])
    least = np.full((len(sets), m), np.inf)
    flat = least.ravel()
    x = np.concatenate([*sets, np.empty(0, dtype=U64)])
    of = np.repeat(np.arange(len(sets)), sizes)
    t, j = np.zeros(len(x)), 1
    while len(x):
        n = 1 if len(x) > 20_000 else 8 if len(x) > 2_000 else 64
        steps = (np.arange(j, j + n, dtype=U64) * U64(0x9E3779B97F4A7C15))[None, :]
        r = mix(x[:, None] + steps)
        t = t[:, None] - np.log((r >> U64(32)).astype(np.float64) * 2.0**-32 + 2.0**-33).cumsum(axis=1)
        where = ((r & U64(0xFFFFFFFF)) * U64(m)) >> U64(32)
        np.minimum.at(flat, ((of * m)[:, None] + where.astype(np.int64)).ravel(), t.ravel())
        active, back = np.unique(of, return_inverse=True)
        limit = least[active].max(axis=1)
        t = t[:, -1]
        go = t < limit[back]
        x, of, t, j = x[go], of[go], t[go], j + n
    with np.errstate(divide="ignore"):
        k = np.floor(1 - np.log(least / (m * RATE)) / np.log(BASE))
    return np.clip(k, 0, Q + 1).astype("<u2")


def joint_estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """The Jaccard similarity of the greatest likelihood, given both registers and both set sizes."""
    m = a.shape[1]
    above, below = (a > b).sum(axis=1), (a < b).sum(axis=1)
    equal = m - above - below
    u, v = na / (na + nb), nb / (na + nb)
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)

    def likelihood(j: np.ndarray) -> np.ndarray:
        up, down = np.maximum(p(u - v * j), 1e-12), np.maximum(p(v - u * j), 1e-12)
        return above * np.log(up) + below * np.log(down) + equal * np.log(np.maximum(1 - up - down, 1e-12))

    low, high = np.zeros(len(a)), np.minimum(u / v, v / u)
    for _ in range(30):  # the likelihood has one peak
        one, two = low + (high - low) / 3, high - (high - low) / 3
        left = likelihood(one) > likelihood(two)
        low, high = np.where(left, low, one), np.where(left, two, high)
    return (low + high) / 2


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, text_id (a hash of the text), n_bytes, n_shingles, fingerprint (of the whole set, null if empty) and sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 512):
                part = batch.slice(at, 512)
                sets = list(shingle_sets(part.column(2), k))
                marks = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                rows = [s.tobytes() for s in sketch(sets)]
                sizes = pc.fill_null(pc.binary_length(part.column(2)), 0).cast(pa.int64())
                columns = [part.column(0), part.column(1), sizes, pa.array([len(s) for s in sets], pa.int64()), pa.array(marks, pa.binary()), pa.array(rows, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_id", "n_bytes", "n_shingles", "fingerprint", "sketch"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.xxhash64("text").alias("text_id"), "text").mapInArrow(run, f"doc_id {kind}, text_id long, n_bytes long, n_shingles long, fingerprint binary, sketch binary")


def likely(pairs: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """Those of pairs (u, v) whose joint estimate is not clearly below the threshold."""
    margin = MARGIN * np.sqrt(threshold * (1 - threshold) / REGISTERS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.array([np.frombuffer(x, dtype="<u2") for x in batch.column(i).to_pylist()]).reshape(-1, REGISTERS) for i in (4, 5))
            na, nb = (batch.column(i).to_numpy() for i in (2, 3))
            if not len(a):
                continue
            good = (joint_estimate(a, b, na, nb) >= threshold - margin) & (np.minimum(na, nb) >= threshold * np.maximum(na, nb) * (1 - 1e-9))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["u", "v"]).filter(pa.array(good))

    side = lambda name: nodes.select(F.col("node").alias(name), F.col("n_shingles").alias(f"n_{name}"), F.col("sketch").alias(f"s_{name}"))
    both = pairs.join(side("v"), "v").join(side("u"), "u").select("u", "v", "n_u", "n_v", "s_u", "s_v")
    return both.mapInArrow(run, "u long, v long")


def confirmed(pairs: DataFrame, texts: DataFrame, k: int, threshold: float) -> DataFrame:
    """Those of pairs (u, v) whose full shingle sets are similar enough. Many rows may have the same u: its set is made once per run of rows."""
    percent = round(100 * threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, kept = None, np.empty(0, dtype=U64)
        for batch in batches:
            good = []
            for u, text, theirs in zip(batch.column(0).to_pylist(), batch.column(2), shingle_sets(batch.column(3), k), strict=True):
                if (u, text.as_py()) != last:
                    last = (u, text.as_py())
                    kept = next(shingle_sets(pa.array([last[1]], pa.string()), k))
                common = len(np.intersect1d(kept, theirs, assume_unique=True))
                good.append(100 * common >= percent * (len(kept) + len(theirs) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["u", "v"]).filter(pa.array(good, pa.bool_()))

    side = lambda name: texts.select(F.col("node").alias(name), F.col("text").alias(f"t_{name}"))
    both = pairs.join(side("v"), "v").join(side("u"), "u").select("u", "v", "t_u", "t_v")
    return both.mapInArrow(run, "u long, v long")


def cross_links(sets: list[np.ndarray], sketches: np.ndarray, labels: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int, margin: float) -> list[tuple[int, int]]:
    """Links (i, j) between members of left and right that join components which weren't joined before."""
    sizes = np.array([len(s) for s in sets])
    root = {int(x): int(x) for x in labels}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    out: list[tuple[int, int]] = []
    i, j = (x.ravel() for x in np.meshgrid(left, right, indexing="ij"))
    small, large = np.minimum(sizes[i], sizes[j]), np.maximum(sizes[i], sizes[j])
    fine = (labels[i] != labels[j]) & ((i < j) | (left is not right)) & (100 * small >= percent * large)
    i, j = i[fine], j[fine]
    near = np.empty(len(i), dtype=bool)
    for at in range(0, len(i), 20_000):
        part = slice(at, at + 20_000)
        near[part] = joint_estimate(sketches[i[part]], sketches[j[part]], sizes[i[part]].astype(float), sizes[j[part]].astype(float)) >= percent / 100 - margin
    i, j = i[near], j[near]
    if not len(i):
        return out
    common = _intersections(sets, i, j)
    good = 100 * common >= percent * (sizes[i] + sizes[j] - common)
    for x, y in zip(i[good].tolist(), j[good].tolist(), strict=True):
        a, b = find(int(labels[x])), find(int(labels[y]))
        if a != b:
            root[max(a, b)] = min(a, b)
            out.append((x, y))
    return out


def _intersections(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sets i and j: pair by pair, or as a matrix product where pairs are many."""
    used = np.unique(np.concatenate([i, j]))
    if len(i) <= 4 * len(used):
        return np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i.tolist(), j.tolist(), strict=True)])
    every = np.concatenate([sets[a] for a in used])
    row = np.repeat(np.arange(len(used)), [len(sets[a]) for a in used])
    values, column, count = np.unique(every, return_inverse=True, return_counts=True)
    shared = count[column] > 1
    row, column = row[shared], (np.cumsum(count > 1) - 1)[column[shared]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    total = np.zeros((len(used), len(used)), dtype=np.float32)
    width = 4096
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, [first, first + width])
        dense = np.zeros((len(used), width), dtype=np.float32)
        dense[row[a:b], column[a:b] - first] = 1
        total += dense @ dense.T
    return total[np.searchsorted(used, i), np.searchsorted(used, j)].astype(np.int64)


def rare_shingles(shelf: Shelf, nodes: DataFrame, k: int, threshold: float) -> DataFrame:
    """Buckets (key, node) in which any two of nodes (node, text) meet that are similar enough: by their rarest shingles.

    Sets of sizes a <= b that have as many elements in common as they must have one among the first
    a - 2ta/(1 + t) + 1 and b - tb + 1 elements of both, in any order of all elements; here the rarest come first.
    """
    percent = round(100 * threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in bounded_slices(batch, 1, 64):
                sets = list(shingle_sets(part.column(1), k))
                sizes = np.array([len(s) for s in sets], dtype=np.int64)
                every = np.concatenate([*sets, np.empty(0, U64)]).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(np.repeat(np.arange(len(sets)), sizes))), pa.array(np.repeat(sizes, sizes)), pa.array(every)], names=["node", "n", "g"])

    shingles = shelf.put(nodes.select("node", "text").mapInArrow(run, "node long, n long, g long"))  # read twice
    common = shingles.groupBy("g").agg(F.count("*").alias("df")).where("df > 1")
    counted = shingles.join(common, "g", "left").select("node", "n", F.struct(F.coalesce("df", F.lit(1)).alias("df"), "g").alias("x"))
    first = lambda numerator, denominator: F.col("n") - F.ceil(F.lit(numerator) * F.col("n") / denominator) + 1
    ordered = counted.groupBy("node", "n").agg(F.sort_array(F.collect_list("x")).alias("x"))
    prefix = ordered.select("node", first(2 * percent, 100 + percent).alias("ip"), F.posexplode(F.slice("x", F.lit(1), first(percent, 100).cast("int"))).alias("at", "x")).where("x.df > 1")
    rows = prefix.select(F.col("x.g").alias("key"), "node", (F.col("at") < F.col("ip")).alias("small"))
    useful = rows.groupBy("key").agg(F.count("*").alias("m"), F.bool_or("small").alias("any")).where("m > 1 AND any").select("key")
    return rows.select("key", "node").join(useful, "key")


def joining_links(shelf: Shelf, members: DataFrame, known: DataFrame, nodes: DataFrame, k: int, threshold: float, refine: bool = True) -> DataFrame:
    """Links (u, v) within buckets (key, node) between nodes of different components, enough to join all that are linked there.

    known: node, label (of its component) and n_bytes. refine: nodes outside a bucket's most common component meet each other by rare shingles where they are more than a block.
    """
    percent, margin = round(100 * threshold), MARGIN * np.sqrt(threshold * (1 - threshold) / REGISTERS)
    marked = members.select("key", "node").join(known, "node")
    parts = marked.groupBy("key", "label").agg(F.count("*").alias("n"), F.sum("n_bytes").alias("bytes"))
    most = lambda c: F.max_by(c, F.struct("n", "label"))
    split = parts.groupBy("key").agg(most("label").alias("most"), F.max("n").alias("n_most"), most("bytes").alias("bytes_most"), F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), F.count("*").alias("parts")).where("parts > 1")
    blocks = lambda n, size: F.least(n, F.greatest(F.ceil(n / BLOCK), F.ceil(size / BLOCK_BYTES))).cast("int")
    split = split.drop("parts").withColumns({"a": blocks(F.col("n") - F.col("n_most"), F.col("bytes") - F.col("bytes_most")), "b": blocks(F.col("n_most"), F.col("bytes_most"))})
    split = shelf.put(split.withColumn("among", F.when(F.lit(refine) & (F.col("n") - F.col("n_most") > BLOCK), 0).otherwise(F.col("a"))))  # so that Spark can split the join on a common key
    total = lambda all_, most_: F.coalesce(F.sum((F.col(all_) - F.col(most_)) * (F.col("among") + F.col("b")) + F.col(most_) * F.col("a")), F.lit(0))
    dealt_rows, dealt_bytes = split.agg(total("n", "n_most"), total("bytes", "bytes_most")).first()
    tasks = max(1, dealt_rows // TASK_ROWS, dealt_bytes // TASK_BYTES)
    placed = marked.join(split.select("key", "most", "a", "b", "among"), "key")
    place = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    upto = lambda n, f: F.transform(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")), f)
    block = lambda i, j, side: F.struct(i.alias("i"), j.alias("j"), F.lit(side).alias("side"))
    mine = place(F.col("a"))  # sides: 0 and 1 the first and second of two blocks outside the most common component, 2 a block of that component
    outside = F.concat(
        upto(F.col("among"), lambda j: F.when(j < mine, block(j, mine, 1)).otherwise(block(mine, j, 0))),
        upto(F.col("b"), lambda j: F.struct(mine.alias("i"), (-1 - j).alias("j"), F.lit(0).alias("side"))),
    )
    inside = upto(F.col("a"), lambda i: F.struct(i.alias("i"), (-1 - place(F.col("b"))).alias("j"), F.lit(2).alias("side")))
    dealt = placed.select("key", "node", "label", F.explode(F.when(F.col("label") == F.col("most"), inside).otherwise(outside)).alias("p")).select("key", "p.i", "p.j", "p.side", "node", "label")
    dealt = dealt.withColumn("task", F.pmod(F.xxhash64("key", "i", "j"), F.lit(tasks)).cast("int"))

    def compare(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("key", "ascending"), ("i", "ascending"), ("j", "ascending"), ("node", "ascending")])
        where = np.stack([table.column(c).to_numpy() for c in ("key", "i", "j")])
        node, label, side = (table.column(c).to_numpy() for c in ("node", "label", "side"))
        cuts = [0, *(np.flatnonzero((where[:, 1:] != where[:, :-1]).any(axis=0)) + 1).tolist(), len(node)]
        u, v = [], []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b - a < 2 or (label[a:b] == label[a]).all():
                continue
            part = table.slice(a, b - a)
            sets = list(shingle_sets(pa.concat_arrays([c.cast(pa.large_string()) for c in part.column("text").chunks]), k))
            marks = np.array([np.frombuffer(x, dtype="<u2") for x in part.column("sketch").to_pylist()])
            sides = side[a:b]
            left = np.flatnonzero(sides == 0)
            right = np.flatnonzero(sides == 2) if (sides == 2).any() else np.flatnonzero(sides == 1) if (sides == 1).any() else left
            for x, y in cross_links(sets, marks, label[a:b], left, right, percent, margin):
                u.append(int(node[a + x]))
                v.append(int(node[a + y]))
        return pa.table([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    links = dealt.join(nodes.select("node", "sketch", "text"), "node").groupBy("task").applyInArrow(compare, "u long, v long")
    if refine and not split.where("among < a").isEmpty():
        crowd = placed.where("among < a AND label != most").select("node").distinct()
        met = shelf.put(rare_shingles(shelf, nodes.join(crowd, "node", "left_semi"), k, threshold))
        links = links.union(joining_links(shelf, met, known, nodes, k, threshold, refine=False))
    return links


def near_duplicates(spark: SparkSession, docs: DataFrame, k: int = 5, threshold: float = 0.8) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id of the document's component), kept, text_id and first, one row per document.

    first is true for one text of each component and for texts without words: what is kept where a doc_id may have several texts.
    """
    shelf = Shelf(spark, "minhash")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    marked = shelf.put(signatures(docs, k))
    least = marked.where("fingerprint IS NOT NULL AND doc_id IS NOT NULL").groupBy("fingerprint").agg(F.min(F.struct("doc_id", "text_id")).alias("least"))
    numbered = least.select("fingerprint", F.col("least.doc_id").alias("doc"), F.col("least.text_id").alias("text_id")).orderBy("doc", "fingerprint").withColumn("node", F.monotonically_increasing_id())
    same = shelf.put(numbered)  # a table: the numbers stay, and Spark can split a join on a common fingerprint
    owner = same.select("fingerprint", F.col("doc").alias("doc_id"), "text_id", "node")
    nodes = shelf.put(marked.join(owner, ["fingerprint", "doc_id", "text_id"]).dropDuplicates(["node"]).select("node", "n_bytes", "n_shingles", "sketch"))

    band = F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1)))
    key = F.xxhash64("band", F.substring("sketch", F.col("band") * 2 * ROWS + 1, F.lit(2 * ROWS)))
    rows = nodes.select("node", "sketch", band.alias("band")).select("node", key.alias("key"))
    shared = rows.groupBy("key").agg(F.min("node").alias("leader"), F.count("*").alias("n")).where("n > 1")
    members = shelf.put(rows.join(shared, "key"))  # both sides are dealt by Spark, which splits a common key

    wanted = members.select("node").distinct()
    few = wanted.count() <= BROADCAST_NODES
    wanted = shelf.put(wanted.join(same.select("node", "doc", "text_id"), "node"))
    chosen = F.broadcast(wanted) if few else wanted
    full = docs.select("doc_id", F.xxhash64("text").alias("text_id"), "text").join(chosen.withColumnRenamed("doc", "doc_id"), ["doc_id", "text_id"])
    texts = shelf.put(full.dropDuplicates(["node"]).select("node", "text"))
    sketches = shelf.put(nodes.join(chosen.select("node"), "node", "left_semi"))

    stars = members.select(F.col("leader").alias("u"), F.col("node").alias("v")).where("u != v").distinct()
    found = shelf.put(confirmed(shelf.put(likely(stars, sketches, threshold)), texts, k, threshold).distinct())
    labels = shelf.put(components(spark, found))

    crowded = members.where("n > 2")  # of two, the star has told all
    both = texts.join(sketches.select("node", "sketch"), "node")
    known = sketches.select("node", "n_bytes").join(labels, "node", "left").select("node", F.coalesce("component", "node").alias("label"), "n_bytes")
    more = shelf.put(joining_links(shelf, crowded, known, both, k, threshold))
    if not more.isEmpty():
        relabelled = lambda side: labels.select(F.col("node").alias(side), F.col("component").alias(f"c_{side}"))
        merged = more.join(relabelled("u"), "u", "left").join(relabelled("v"), "v", "left").select(F.coalesce("c_u", "u").alias("u"), F.coalesce("c_v", "v").alias("v"))
        above = components(spark, merged).select(F.col("node").alias("component"), F.col("component").alias("top"))
        # above has heads of components and nodes that had no link so far, none of which is a node of labels
        labels = labels.join(above, "component", "left").select("node", F.coalesce("top", "component").alias("component")).unionByName(above.select(F.col("component").alias("node"), F.col("top").alias("component")))

    heads = labels.join(same.select(F.col("node").alias("component"), F.col("doc").alias("head")), "component").select("node", "head")
    rows = marked.select("doc_id", "text_id", "n_shingles", "fingerprint").join(same.withColumnRenamed("text_id", "least_text"), "fingerprint", "left").join(heads, "node", "left")
    component = F.coalesce("head", "doc", "doc_id")
    alone = F.col("head").isNull() & F.equal_null("doc_id", F.col("doc")) & F.equal_null("text_id", F.col("least_text"))  # labels has no row for the head itself
    return rows.select("doc_id", "n_shingles", component.alias("component_id"), F.equal_null("doc_id", component).alias("kept"), "text_id", (alone | F.col("fingerprint").isNull()).alias("first"))
