"""How sources of a language differ in their words: divergences of all pairs of sources, and the terms that set a source apart.

Each task makes radix tries over bytes from the terms of its documents, one for each language, whose leaves hold the number of documents and
the occurrences in each source. They are laid out flat, in UTF-8 order, and written; the tries of all tasks are merged by ranges of that order, leaf by leaf, so
a frequent term is one leaf of each task and not one row of each document. The merged leaves are walked once more, range by range: a walk sums the divergences of all
pairs of sources and keeps each source's best terms, in the order of ties. Shares are whole numbers and all arithmetic is exact.

A walk holds a matrix of BLOCK sources by all sources of a language; languages with more sources are walked once for each block.

Defined results: null text, lang and source are empty texts, which make a language or source of their own; repeated rows count again; a group
without terms is compared as well; ties are ranked in UTF-8 order; other columns are ignored; an empty table gives no rows. Long texts
enter whole; a task holds the distinct terms of the text at hand.
"""

from __future__ import annotations

import gc
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.llm.shelf import Shelf
from tidewatch.llm.textops import bounded_slices

#: Documents of its language that a term needs.
LEAST_DOCS = 10
#: Terms that are ranked for each source.
TOP = 10
#: Counters of a task's tries before they are handed on.
HELD_COUNTERS = 400_000
#: Bytes of a text that are split at once.
PIECE = 1 << 22
#: Sources of a walk's pairs on one side.
BLOCK = 512
#: Numbers of a walk's matrices.
CELLS = 1 << 20

#: Bytes of terms: letters, lower-cased, and all of a character that isn't ASCII; others part terms.
TERM_BYTES = bytes(b if 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """Terms of a UTF-8 text in lists of bounded size, in order, as often as they occur."""
    folded = text.translate(TERM_BYTES)
    at = 0
    while len(folded) - at > PIECE and (end := folded.find(b" ", at + PIECE)) >= 0:
        yield folded[at:end].split()
        at = end
    yield (folded[at:] if at else folded).split()


class Trie:
    """A radix trie over bytes. A node is [label, children by first byte or None, leaf or None]; a leaf is [documents, {source: occurrences}]."""

    def __init__(self) -> None:
        self.root: list = [b"", {}, None]
        self.known: dict[bytes, list] = {}

    def leaf(self, term: bytes) -> list:
        """The term's leaf, which is new if need be. Leaves that are known aren't searched from the root again."""
        if (found := self.known.get(term)) is None:
            found = [0, {}]
            self.put(term, found)
        return found

    def put(self, term: bytes, leaf: list) -> None:
        """A leaf for a term that has none."""
        self.known[term] = leaf
        node, rest = self.root, term
        while rest:
            children = node[1]
            if children is None:
                children = node[1] = {}
            child = children.get(rest[0])
            if child is None:
                children[rest[0]] = [rest, None, leaf]
                return
            label = child[0]
            if not rest.startswith(label):  # the edge parts where they differ
                same, most = 1, min(len(label), len(rest))
                while same < most and label[same] == rest[same]:
                    same += 1
                upper = children[rest[0]] = [label[:same], {label[same]: child}, None] if same < len(label) else child
                child[0], label, child = label[same:], label[:same], upper
            node, rest = child, rest[len(label) :]
        node[2] = leaf

    def merge(self, term: bytes, docs: int, counts: Iterable[tuple[str, int]]) -> int:
        """Add a leaf of another trie; how many counters are new."""
        leaf = self.leaf(term)
        leaf[0] += docs
        own, before = leaf[1], len(leaf[1])
        for source, n in counts:
            own[source] = own.get(source, 0) + n
        return len(own) - before

    def walk(self) -> Iterator[tuple[bytes, list]]:
        """Terms and leaves in UTF-8 order."""
        stack = [(b"", self.root)]
        while stack:
            prefix, (label, children, leaf) = stack.pop()
            term = prefix + label
            if leaf is not None:
                yield term, leaf
            if children:
                for b in sorted(children, reverse=True):
                    stack.append((term, children[b]))


LEAVES = "lang string, term string, docs long, sources array<string>, counts array<long>"


def pack(rows: list[tuple[str, bytes, list]]) -> pa.RecordBatch:
    """Leaves as a batch of LEAVES."""
    lang, term, leaves = zip(*rows, strict=True)
    ends = np.cumsum([0, *(len(leaf[1]) for leaf in leaves)], dtype=np.int32)
    sources = pa.ListArray.from_arrays(ends, pa.array([s for leaf in leaves for s in leaf[1]], pa.string()))
    counts = pa.ListArray.from_arrays(ends, pa.array([n for leaf in leaves for n in leaf[1].values()], pa.int64()))
    docs = pa.array([leaf[0] for leaf in leaves], pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(term, pa.binary()).cast(pa.string()), docs, sources, counts], ["lang", "term", "docs", "sources", "counts"])


def walked(tries: dict[str, Trie]) -> Iterator[pa.RecordBatch]:
    """Leaves of all tries in order."""
    rows = []
    for lang in sorted(tries, key=str.encode):
        for term, leaf in tries[lang].walk():
            rows.append((lang, term, leaf))
            if len(rows) == 10_000:
                yield pack(rows)
                rows = []
    if rows:
        yield pack(rows)


def without_gc(work: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """Tries are millions of small objects without circles, which the collector of circles needn't go over again and again."""

    def run(batches: Iterator) -> Iterator:
        gc.disable()
        try:
            yield from work(batches)
        finally:
            gc.enable()

    return run


Held = dict[str, tuple[Counter, dict[str, Counter]]]


def flat_tries(held: Held) -> Iterator[pa.RecordBatch]:
    """What a task has counted (of each language the documents of terms, and the occurrences of each source) as flat tries.

    A flat trie is its leaves in UTF-8 order, which is the walk of the trie: a leaf's edge is what it doesn't share with the one before.
    """
    for lang in sorted(held, key=str.encode):
        docs, sources = held[lang]
        if not docs:
            continue
        terms, n = pa.array(docs.keys(), pa.binary()), np.fromiter(docs.values(), np.int64, len(docs))
        order = pc.sort_indices(terms)
        terms, n = terms.take(order), n[order.to_numpy()]
        leaf = np.concatenate([pc.index_in(pa.array(c.keys(), pa.binary()), terms).to_numpy() for c in sources.values()])
        owner = np.repeat(np.arange(len(sources), dtype=np.int32), [len(c) for c in sources.values()])
        counts = np.concatenate([np.fromiter(c.values(), np.int64, len(c)) for c in sources.values()])
        by = np.argsort(leaf, kind="stable")
        ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(leaf, minlength=len(terms)))]), pa.int32())
        names = pa.DictionaryArray.from_arrays(pa.array(owner[by]), pa.array(list(sources), pa.string())).cast(pa.string())
        columns = [pa.repeat(pa.scalar(lang, pa.string()), len(terms)), terms.cast(pa.string()), pa.array(n), pa.ListArray.from_arrays(ends, names), pa.ListArray.from_arrays(ends, pa.array(counts[by]))]
        yield from pa.Table.from_arrays(columns, ["lang", "term", "docs", "sources", "counts"]).to_batches(max_chunksize=10_000)


def task_tries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents (lang, source, text) to the leaves of this task's tries."""
    held, size = {}, 0
    for batch in batches:
        for part in bounded_slices(batch, 2, len(batch)):
            for lang, source, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).cast(pa.large_binary()).to_pylist(), strict=True):
                docs, sources = held.setdefault(lang, (Counter(), {}))
                counts = sources.setdefault(source, Counter())
                before, own = len(counts), set()
                for terms in terms_of(text):
                    counts.update(terms)
                    own.update(terms)
                docs.update(own)
                size += len(counts) - before
                if size >= HELD_COUNTERS:
                    yield from flat_tries(held)
                    held, size = {}, 0
    yield from flat_tries(held)


def merged_runs(rows: pa.RecordBatch, starts: np.ndarray, chosen: np.ndarray) -> Iterator[tuple[str, bytes, int, list[tuple[str, int]]]]:
    """Of each chosen run of equal terms, which begin at starts: language, term, documents and the occurrences of each source."""
    sizes = np.diff(np.append(starts, len(rows)))
    part = rows.filter(pa.array(np.repeat(chosen, sizes)))
    if not len(part):
        return
    sizes = sizes[chosen]
    at = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    docs = np.add.reduceat(part.column(2).to_numpy(), at)
    sources, counts = part.column(3), part.column(4).flatten().to_numpy()
    codes = sources.flatten().dictionary_encode()
    names = codes.dictionary.to_pylist()
    key = np.repeat(np.repeat(np.arange(len(sizes)), sizes), sources.value_lengths().to_numpy()) * len(names) + codes.indices.to_numpy()
    order = np.argsort(key, kind="stable")
    first = np.flatnonzero(np.diff(key[order], prepend=-1))
    key, sums = key[order][first], np.add.reduceat(counts[order], first).tolist()
    ends = np.searchsorted(key, np.arange(len(sizes) + 1) * len(names)).tolist()
    owners = [names[c] for c in (key % len(names)).tolist()]
    heads = part.take(pa.array(at))
    for i, (lang, term, n) in enumerate(zip(heads.column(0).to_pylist(), heads.column(1).cast(pa.binary()).to_pylist(), docs.tolist(), strict=True)):
        yield lang, term, n, list(zip(owners[ends[i] : ends[i + 1]], sums[ends[i] : ends[i + 1]], strict=True))


def merge_range(least: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sorted leaves of many tries to the merged ones of a range.

    The range arrives in UTF-8 order, so the leaves of one term are together. Those in too few documents are passed over before anything is merged,
    and the trie is walked and let go between two terms whenever it has grown. The last term of a batch goes on as one leaf.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tries, size, carried = {}, 0, None
        for batch in batches:
            if not len(batch):
                continue
            rows = batch if carried is None else pa.concat_batches([carried, batch.cast(carried.schema)])
            parted = [pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False).astype(bool) for c in (rows.column(0), rows.column(1))]
            starts = np.concatenate([[0], np.flatnonzero(parted[0] | parted[1]) + 1])
            chosen = np.add.reduceat(rows.column(2).to_numpy(), starts) >= least
            chosen[-1] = False
            for lang, term, docs, counts in merged_runs(rows, starts, chosen):
                size += tries.setdefault(lang, Trie()).merge(term, docs, counts)
            if size >= HELD_COUNTERS:
                yield from walked(tries)
                tries, size = {}, 0
            last = rows.slice(starts[-1])
            [(lang, term, docs, counts)] = merged_runs(last, np.array([0]), np.array([True]))
            carried = pack([(lang, term, [docs, dict(counts)])])
        if carried is not None and carried.column(2)[0].as_py() >= least:
            [(lang, term, docs, counts)] = merged_runs(carried, np.array([0]), np.array([True]))
            tries.setdefault(lang, Trie()).merge(term, docs, counts)
        yield from walked(tries)

    return run


def shares(counts: np.ndarray, over: np.ndarray) -> np.ndarray:
    """1 + floor(10**9 * (counts + 2) / over), exact in 64 bits for totals below 2 * 10**14."""
    scaled = (counts + 2) * 31_250
    return 1 + 32_000 * (scaled // over) + 32_000 * (scaled % over) // over


def distances(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


WALK = "lang string, a int, b int, term string, value long"


def walk_ranges(top: int):
    """Leaves (lang, term, counts of all sources, over, over_all, from, upto), in order, to sums of divergences of pairs of sources (term is null) and best terms (b is null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, int], np.ndarray] = {}
        best: dict[tuple[str, int], list[tuple[int, str]]] = {}
        for batch in batches:
            langs, at = batch.column(0).to_pylist(), 0
            firsts = batch.column(5).to_numpy(zero_copy_only=False)
            while at < len(langs):
                lang, first = langs[at], int(firsts[at])
                over = np.array(batch.column(3)[at].as_py(), dtype=np.int64)
                last = at
                while last < len(langs) and langs[last] == lang and firsts[last] == first and last - at < max(1, CELLS // len(over)):
                    last += 1
                part = batch.slice(at, last - at)
                counts = part.column(2).flatten().to_numpy(zero_copy_only=False).reshape(last - at, len(over))
                p, q = shares(counts, over), shares(counts.sum(axis=1), np.int64(part.column(4)[0].as_py()))
                terms = part.column(1).to_pylist()
                for a in range(first, part.column(6)[0].as_py()):
                    own = p[:, a]
                    found = distances(own[:, None], p).sum(axis=0)
                    sums[lang, a] = sums[lang, a] + found if (lang, a) in sums else found
                    apart = np.flatnonzero((counts[:, a] > 0) & (own > q))
                    f = distances(own[apart], q[apart])
                    picked = np.argsort(-f, kind="stable")[:top]  # terms are in UTF-8 order, so ties stay in it
                    both = best.get((lang, a), []) + [(-int(f[i]), terms[apart[i]]) for i in picked]
                    best[lang, a] = sorted(both, key=lambda t: (t[0], t[1].encode()))[:top]
                at = last
        rows = [(lang, a, b, None, int(v)) for (lang, a), found in sums.items() for b, v in enumerate(found) if b != a]
        rows += [(lang, a, None, term, -minus) for (lang, a), found in best.items() for minus, term in found]
        types = (pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int64())
        for i in range(0, len(rows), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + 10_000], strict=True), types, strict=True)], ["lang", "a", "b", "term", "value"])

    return run


def merged_leaves(shelf: Shelf, docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """Leaves (LEAVES) of the terms that each language keeps. docs: lang, source, text, without nulls."""
    tries = shelf.put(docs.select("lang", "source", "text").mapInArrow(without_gc(task_tries), LEAVES))
    ranges = tries.repartitionByRange("lang", "term").sortWithinPartitions("lang", "term")
    return shelf.put(ranges.mapInArrow(without_gc(merge_range(least_docs)), LEAVES))


def audit(spark: SparkSession, docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP, block: int = BLOCK) -> DataFrame:
    """lang, source, part (`pair`: item is another source; `term`: item is a term), item, value, rank. docs: lang, source, text."""
    shelf = Shelf(spark, "divergence")
    docs = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    kept = merged_leaves(shelf, docs, least_docs)
    sums = kept.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("e")).groupBy("lang", F.col("e.sources").alias("source")).agg(F.sum("e.counts").alias("n"))
    terms = kept.groupBy("lang").agg(F.count("*").alias("v"))
    groups = docs.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").select("lang", F.struct("source", F.coalesce("n", F.lit(0)).alias("n")).alias("g"))
    sides = shelf.put(groups.groupBy("lang").agg(F.array_sort(F.collect_list("g")).alias("g")).join(terms, "lang", "left").select("lang", F.coalesce("v", F.lit(0)).alias("v"), F.col("g.source").alias("names"), F.col("g.n").alias("n")))
    over = F.transform("n", lambda n: n + 2 * F.col("v"))
    blocks = sides.where("v > 0").select("lang", "names", over.alias("over"), (F.aggregate("n", F.lit(0).cast("long"), lambda s, n: s + n) + 2 * F.col("v")).alias("over_all"), F.explode(F.sequence(F.lit(0), F.size("names") - 1, F.lit(block))).alias("from"))
    counter = F.map_from_arrays("sources", "counts")
    full = kept.join(blocks, "lang").withColumn("c", counter)
    dense = full.select("lang", "term", F.transform("names", lambda s: F.coalesce(F.try_element_at("c", s), F.lit(0).cast("long"))).alias("counts"), "over", "over_all", "from", F.least(F.col("from") + block, F.size("names")).alias("upto"))
    walks = shelf.put(dense.sortWithinPartitions("lang", "from", "term").mapInArrow(walk_ranges(top), WALK))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    named = sides.select("lang", F.posexplode("names").alias("a", "source"))
    found = walks.where("b IS NOT NULL").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    pairs = sides.select("lang", "names", F.posexplode("names").alias("a", "source")).select("lang", "a", "source", F.posexplode("names").alias("b", "item")).where("a != b")
    pair = pairs.join(found, ["lang", "a", "b"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))
    term = walks.where("b IS NULL").join(named, ["lang", "a"]).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")
    return pair.withColumn("rank", F.row_number().over(order)).unionByName(term.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top))
