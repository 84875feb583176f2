"""Repeated passages across documents, by prefix-partitioned suffix trees cut at the window's depth.

Every word position begins a suffix. Suffixes are split into groups by prefixes of variable length: the first
words decide, by a count over the whole corpus, and prefixes with more suffixes than a group may hold are
split further by the whole window of words. In each group the suffixes, kept as fingerprints of
their first words, are sorted; equal neighbours are the leaves below one internal node at the
depth of a window. A node's leaf in the earliest document is its owner; all other leaves begin a
repeated window, and runs of them are the maximal repeats.

Documents are dealt into batches by ascending doc_id, so of two batches the earlier has the smaller doc_ids:
a batch sends each node once, without document or position, and gets back one bit, whether it owns the
node. So copies are merged before the shuffle, and a passage that all documents have costs one
entry per batch. Batches are cut by running sums of text bytes in the order of doc_id, so a batch has at most BATCH_BYTES
whatever lies side by side; only one document that is longer by itself, or the rows of one doc_id, make a larger one.
The first doc_ids of the batches are broadcast: 8 bytes for each batch, 1.4 MB for each TB of text, so batches and tasks stay as they are at any size.

A window is identified by 64 bits of its words and the 16 bits of its prefix's bin. Edges below the
depth of a window are not built; README gives the reason.

Defined results: null texts have no words. Documents with fewer words than a window lose nothing. Rows
without a doc_id are returned unchanged and are no source of others. Rows with the same doc_id don't
take words from each other. Extra columns are carried as they are. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.textops import U64, Hasher, string_buffers, text_chunks, word_spans

WINDOW, PREFIX, BIN_BITS = 13, 4, 16
#: Text bytes in a batch and nodes in a group: what one task holds at a time, about 20 bytes for each byte of text and 60 for each node.
#: Raise both for very large corpora, where batches times groups is the number of rows shuffled.
BATCH_BYTES, GROUP_NODES = 6 << 20, 1_000_000


@lru_cache(maxsize=1)
def _hasher() -> Hasher:
    return Hasher(7_130_013)


class Words:
    """Word spans of a range of texts."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.ends_at = data, offsets
        self.starts, self.ends, self.word_at = word_spans(data, offsets)
        self.texts = len(offsets) - 1

    def windows(self, window: int, prefix: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each window within a text: its first word, its text, its fingerprint, its prefix's bin."""
        words = _hasher().words(self.data, self.starts, self.ends)
        whole = _hasher().runs(words, window)
        counts = np.diff(self.word_at)
        left = np.repeat(self.word_at[1:], counts) - np.arange(len(words))  # words from here to the text's end
        at = np.flatnonzero(left >= window)
        of = np.repeat(np.arange(self.texts), counts)[at]
        bins = (_hasher().runs(words, prefix)[at] >> U64(64 - BIN_BITS)).astype(np.int64)
        return at, of, whole[at], bins


def texts_of(column: pa.ChunkedArray | pa.Array) -> Iterator[tuple[int, Words]]:
    """The number of the first text of each range, and its words."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays([c.cast(pa.large_string()) for c in column.chunks]) if column.num_chunks else pa.array([], pa.large_string())
    data, offsets = string_buffers(column)
    for first, last in text_chunks(offsets):
        yield first, Words(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])


def prefix_counts(docs: DataFrame, window: int, prefix: int) -> np.ndarray:
    """Windows by prefix bin over the whole corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << BIN_BITS, dtype=np.int64)
        for batch in batches:
            for _, words in texts_of(batch.column(0)):
                counts += np.bincount(words.windows(window, prefix)[3], minlength=len(counts))
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(counts[at], pa.int64())], names=["bin", "n"])

    found = docs.select("text").mapInArrow(run, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).toPandas()  # at most one row per bin
    counts = np.zeros(1 << BIN_BITS, dtype=np.int64)
    counts[found["bin"].to_numpy(dtype=np.int64)] = found["n"].to_numpy(dtype=np.int64)
    return counts


def group_plan(counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """For each bin its first group and the number of groups that it is split into; neighbouring small bins have one together."""
    first, parts = np.zeros(len(counts), dtype=np.int64), np.ones(len(counts), dtype=np.int64)
    group, held = 0, 0
    for i, n in enumerate(counts.tolist()):
        if n > size:
            group += held > 0
            parts[i] = -(-n // size)
            first[i] = group
            group, held = group + int(parts[i]), 0
            continue
        if held + n > size:
            group, held = group + 1, 0
        first[i], held = group, held + n
    return first, parts


def batch_bounds(docs: DataFrame, batch_bytes: int) -> np.ndarray:
    """The last doc_ids of all batches but the last: runs of doc_ids whose texts have at most batch_bytes, counted in order over ranges of doc_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last, ends = 0, None, []
        for batch in batches:
            for i, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if last is not None and held + n > batch_bytes:
                    ends.append(last)
                    held = 0
                held, last = held + n, i
        if last is not None:
            ends.append(last)
        yield pa.RecordBatch.from_arrays([pa.array(ends, pa.int64())], names=["last"])

    sizes = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n"))
    per_id = sizes.groupBy("doc_id").agg(F.sum("n").alias("n")).repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    ends = per_id.mapInArrow(run, "last long").toPandas()["last"].to_numpy(dtype=np.int64)
    return np.sort(ends)[:-1]


class Nodes:
    """The distinct windows of a batch, ordered by group and then by fingerprint."""

    def __init__(self, table: pa.Table, window: int, prefix: int, first: np.ndarray, parts: np.ndarray):
        ids = table.column("doc_id").to_numpy()
        self.order = np.argsort(ids, kind="stable")
        self.ids = ids[self.order]
        self.texts = table.column("text").take(pa.array(self.order))
        of, prints, groups = [np.empty(0, np.int32)], [np.empty(0, U64)], [np.empty(0, np.int32)]
        for at, words in texts_of(self.texts):
            _, text, fingerprint, bins = words.windows(window, prefix)
            of.append((text + at).astype(np.int32))
            prints.append(fingerprint)
            groups.append((first[bins] + (fingerprint % parts[bins].astype(U64)).astype(np.int64)).astype(np.int32))
        self.of, prints, groups = np.concatenate(of), np.concatenate(prints), np.concatenate(groups)
        by = np.argsort(prints, kind="stable")
        by = by[np.argsort(groups[by], kind="stable")]
        new = np.ones(len(by), dtype=bool)
        sorted_ = prints[by]
        new[1:] = sorted_[1:] != sorted_[:-1]
        sorted_ = groups[by]
        new[1:] |= sorted_[1:] != sorted_[:-1]
        lead = by[new]  # in each node's run the stable sorts leave the smallest doc_id first
        self.prints, self.groups, self.owner = prints[lead], groups[lead], self.ids[self.of[lead]] if len(lead) else self.ids[:0]
        self.node = np.empty(len(by), dtype=np.int32)
        self.node[by] = np.cumsum(new, dtype=np.int32) - 1

    def by_group(self) -> Iterator[tuple[int, np.ndarray]]:
        cuts = np.flatnonzero(np.diff(self.groups)) + 1
        for part, at in zip(np.split(self.prints, cuts), [0, *cuts], strict=True):
            if len(part):
                yield int(self.groups[at]), part


def kept_texts(words: Words, gone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of the texts' words that are not gone, joined by one space."""
    keep = np.flatnonzero(~gone)
    of = np.searchsorted(words.word_at, keep, side="right") - 1
    head = np.ones(len(keep), dtype=bool)
    head[1:] = of[1:] != of[:-1]
    starts, ends = words.starts[keep] - ~head, words.ends[keep]  # a space before all but the first of a text
    data = words.data.copy()
    data[starts[~head]] = 0x20
    edge = np.zeros(len(data) + 1, dtype=np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, ends, -1)
    sizes = np.zeros(words.texts, dtype=np.int64)
    np.add.at(sizes, of, ends - starts)
    return data[np.cumsum(edge[:-1]) > 0], np.concatenate([[0], np.cumsum(sizes)])


def spaced_texts(words: Words, gone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of the texts without the gone words: each goes with the white space before it, a text's first ones with that after them."""
    edge, ends_at = np.zeros(len(words.data) + 1, dtype=np.int32), words.ends_at
    of = np.repeat(np.arange(words.texts), np.diff(words.word_at))
    before = np.where(np.arange(len(gone)) > words.word_at[of], np.concatenate([[0], words.ends[:-1]]), ends_at[of]) if len(gone) else words.ends
    np.add.at(edge, before[gone], 1)
    np.add.at(edge, words.ends[gone], -1)
    keep = np.flatnonzero(~gone)
    head = keep[np.searchsorted(keep, words.word_at[:-1]).clip(max=max(len(keep) - 1, 0))] if len(keep) else np.empty(0, np.int64)
    late = np.flatnonzero((head > words.word_at[:-1]) & (head < words.word_at[1:])) if len(keep) else head  # texts whose first words are gone
    np.add.at(edge, ends_at[late], 1)
    np.add.at(edge, words.starts[head[late]] if len(late) else late, -1)
    stay = np.cumsum(edge[:-1]) == 0
    return words.data[stay], np.concatenate([[0], np.cumsum(stay)])[ends_at]


def remove_repeats(spark: SparkSession, docs: DataFrame, window: int = WINDOW, prefix: int = PREFIX, batch_bytes: int = BATCH_BYTES, group_nodes: int = GROUP_NODES, spaced: bool = False) -> DataFrame:
    """doc_id, text, n_words, n_removed, kept (the words left, joined by one space, or spaced: as they stood), and `row`, a struct of the other columns of docs."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    counts = prefix_counts(docs, window, prefix)
    first, parts = group_plan(counts, group_nodes)
    bounds = batch_bounds(docs, batch_bytes)  # 8 bytes for each batch, so 1.4 MB a TB: tasks stay as they are at any size
    n_batches, dealt_at = len(bounds) + 1, spark.sparkContext.broadcast(bounds)

    @F.pandas_udf("long")
    def batch_of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(dealt_at.value, ids.to_numpy(), side="left"))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (F.struct(*others) if others else F.struct(F.lit(None).cast("boolean").alias("none"))).alias("row"))
    with_id = rows.where("doc_id IS NOT NULL").withColumn("batch", batch_of("doc_id"))
    without = rows.where("doc_id IS NULL").withColumn("batch", -1 - F.pmod(F.xxhash64("text", F.rand(1)), F.lit(n_batches)))
    dealt = with_id.unionByName(without)

    def send(key: tuple, table: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if key[0].as_py() >= 0:
            out = [(g, key[0].as_py(), p.tobytes()) for g, p in Nodes(table, window, prefix, first, parts).by_group()]
        cols = list(zip(*out, strict=True)) or [()] * 3
        pa.default_memory_pool().release_unused()
        return pa.table([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.binary())], names=["grp", "batch", "prints"])

    def own(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("batch")
        prints = [np.frombuffer(x, dtype="<u8") for x in table.column("prints").to_pylist()]
        every = np.concatenate(prints)
        by = np.argsort(every, kind="stable")  # earlier batches first among equals
        new = np.ones(len(by), dtype=bool)
        new[1:] = every[by][1:] != every[by][:-1]
        owns = np.empty(len(by), dtype=bool)
        owns[by] = new
        cuts = np.cumsum([len(p) for p in prints])[:-1]
        bits = [np.packbits(x).tobytes() for x in np.split(owns, cuts)]
        return pa.table([table.column("batch"), table.column("grp"), pa.array(bits, pa.binary())], names=["batch", "grp", "bits"])

    def cut(key: tuple, table: pa.Table, masks: pa.Table) -> pa.Table:
        if key[0].as_py() >= 0:
            nodes = Nodes(table, window, prefix, first, parts)
            masks = masks.sort_by("grp")
            sizes = [len(p) for _, p in nodes.by_group()]
            owns = np.concatenate([np.empty(0, bool), *(np.unpackbits(np.frombuffer(b, dtype=np.uint8), count=n).astype(bool) for b, n in zip(masks.column("bits").to_pylist(), sizes, strict=True))])
            repeated = ~owns[nodes.node] | (nodes.ids[nodes.of] > nodes.owner[nodes.node]) if len(nodes.node) else np.empty(0, bool)
            order, texts = nodes.order, nodes.texts
        else:
            repeated, order, texts = None, np.arange(len(table)), table.column("text")
        total, removed, data, offsets, done = [], [], [], [np.zeros(1, np.int64)], 0
        for _, words in texts_of(texts):
            gone = np.zeros(len(words.starts), dtype=bool)
            if repeated is not None:
                counts = np.diff(words.word_at)
                at = np.flatnonzero(np.repeat(words.word_at[1:], counts) - np.arange(len(words.starts)) >= window)
                at = at[repeated[done : done + len(at)]] if len(at) else at
                done += int(np.maximum(counts - window + 1, 0).sum())
                edge = np.zeros(len(gone) + 1, dtype=np.int32)
                np.add.at(edge, at, 1)
                np.add.at(edge, at + window, -1)
                gone = np.cumsum(edge[:-1]) > 0
            total.append(np.diff(words.word_at))
            removed.append(np.diff(np.concatenate([[0], np.cumsum(gone)])[words.word_at]))
            text, ends = spaced_texts(words, gone) if spaced else kept_texts(words, gone)
            data.append(text)
            offsets.append(ends[1:] + offsets[-1][-1])
        kept = pa.LargeStringArray.from_buffers(len(order), pa.py_buffer(np.concatenate(offsets)), pa.py_buffer(np.concatenate([np.empty(0, np.uint8), *data]))).cast(pa.string())
        table = table.take(pa.array(order))
        none = np.empty(0, np.int64)
        pa.default_memory_pool().release_unused()
        return pa.table([table.column("doc_id"), table.column("text"), pa.array(np.concatenate([none, *total])), pa.array(np.concatenate([none, *removed])), kept, table.column("row")], names=["doc_id", "text", "n_words", "n_removed", "kept", "row"])

    kind = rows.schema["row"].dataType.simpleString()
    sent = dealt.groupBy("batch").applyInArrow(send, "grp long, batch long, prints binary")
    masks = sent.groupBy("grp").applyInArrow(own, "batch long, grp long, bits binary")
    return dealt.groupBy("batch").cogroup(masks.groupBy("batch")).applyInArrow(cut, f"doc_id long, text string, n_words long, n_removed long, kept string, row {kind}")
