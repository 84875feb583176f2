"""Spelling variants: words that are one edit apart, by bands of letter parities.

A word's mask has a bit for each letter, set where the letter occurs an odd number of times. One inserted or deleted letter flips one
bit and a replaced one two or none, so of three bands of a mask at least one stays. Words are joined on an equal band and their lengths (equal, or one
longer); what meets is filtered by the number of flipped bits and verified by edit distance within the join, in the first band that agrees.
A band's bits with a length that more than `crowded` words have are split by halves of the words: one edit leaves the first or the second half.

Words come from runs of Latin letters counted in each task; only sums by word are shuffled. Forms are the near words of largest count if that
is at least twice the word's own, so chains of forms end, and their ends are found by doubling.

Defined results: null and empty texts have no words, a null doc_id counts as an empty text in the hash, repeated rows count again,
ties between near words go to the smallest in code-point order, other columns are ignored. Of texts of any length a task holds its distinct runs. An
empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.shelf import Shelf
from tidewatch.llm.textops import bounded_slices

#: Runs of letters in lower-cased UTF-8: a-z and U+00C0 to U+00FF.
RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")
#: Of one run in so many the hash deletes a code point.
TYPO = 97
LEAST_LENGTH, LEAST_COUNT = 5, 3
#: Distinct words that a task counts before it hands them on.
HELD_WORDS = 300_000
#: Bytes of a text beyond which its runs aren't listed at once.
LISTED = 1 << 22
BANDS = 3
#: Words of a band's bits and length beyond which they are split by halves.
CROWDED = 2000


def runs_of(text: bytes) -> Counter:
    """Lower-cased runs of a UTF-8 text and how often they occur."""
    lower = text.lower()  # of bytes: only A-Z
    return Counter(RUN.findall(lower) if len(lower) <= LISTED else (m[0] for m in RUN.finditer(lower)))


def with_typos(doc_id: bytes, runs: Counter) -> Iterator[tuple[bytes, int]]:
    """The words of a document, each with its count: of some runs a code point is deleted."""
    start = zlib.crc32(doc_id + b":")
    for run, n in runs.items():
        h = zlib.crc32(run, start)
        if h % TYPO == 0:
            letters = run.decode()
            at = h % len(letters)
            run = (letters[:at] + letters[at + 1 :]).encode()
        yield run, n


def count_words(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """word, n: words long and frequent enough. docs: doc_id, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        pack = lambda: pa.RecordBatch.from_pydict({"word": pa.array(list(held), pa.binary()).cast(pa.string()), "n": pa.array(held.values(), pa.int64())})
        for batch in batches:
            for part in bounded_slices(batch, 1, len(batch)):
                for doc_id, text in zip(part.column(0).cast(pa.binary()).to_pylist(), part.column(1).cast(pa.large_binary()).to_pylist(), strict=True):
                    for word, n in with_typos(doc_id, runs_of(text or b"")):
                        if len(word) - word.count(b"\xc3") >= least_length:
                            held[word] += n
                    if len(held) >= HELD_WORDS:
                        yield pack()
                        held.clear()
        if held:
            yield pack()

    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), "text").mapInArrow(run, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def parities(band: int) -> Column:
    """The band of a word's mask that holds the letters whose code points leave this remainder: nine bits for a-z, then U+00C0 to U+00FF."""
    bit = "IF(ascii(c) < 128, (ascii(c) - 97) DIV 3, 9 + (ascii(c) - 192) DIV 3)"
    return F.expr(f"aggregate(filter(split(word, ''), c -> c != ''), 0L, (m, c) -> m ^ IF(ascii(c) % {BANDS} = {band}, shiftleft(1L, CAST({bit} AS INT)), 0L))")


def near_pairs(words: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """Each pair of words that are exactly one edit apart, once: a, b with their counts; b is longer, or of the same length and greater. words: word, n, of the letters above."""
    masks = words.select("word", "n", F.char_length("word").alias("len"), F.array(*map(parities, range(BANDS))).alias("mask"))
    banded = masks.select("*", F.posexplode("mask").alias("band", "bits"))
    left = banded.withColumn("key_len", F.col("len"))
    right = banded.withColumn("key_len", F.explode(F.array("len", F.col("len") - 1)))
    key = ["band", "bits", "key_len"]
    full = right.groupBy(*key).agg(F.count("*").alias("members")).where(F.col("members") > crowded)
    half = F.expr("key_len DIV 2")
    first, second = F.substring("word", F.lit(1), half), F.substring("word", F.col("len") - F.col("key_len") + half + 1, F.col("key_len") - half)
    halves = F.when(F.col("members").isNull(), F.array(F.lit(""))).otherwise(F.array(F.concat(F.lit("<"), first), F.concat(F.lit(">"), second)))

    def side(rows: DataFrame, name: str) -> DataFrame:
        split = rows.join(full, key, "left").withColumn("half", F.explode(halves))
        return split.select(*key, "half", *(F.col(c).alias(f"{name}_{c}") for c in ("word", "n", "len", "mask")))

    other = lambda i: F.col("a_mask")[i] != F.col("b_mask")[i]
    flips = sum((F.bit_count(F.col("a_mask")[i].bitwiseXOR(F.col("b_mask")[i])) for i in range(1, BANDS)), F.bit_count(F.col("a_mask")[0].bitwiseXOR(F.col("b_mask")[0])))
    first_band = ((F.col("band") < 1) | other(0)) & ((F.col("band") < 2) | other(1))
    same_first = F.substring("a_word", F.lit(1), half) == F.substring("b_word", F.lit(1), half)
    order = (F.col("a_len") < F.col("b_len")) | (F.col("a_word") < F.col("b_word"))
    once = ~F.startswith("half", F.lit(">")) | ~same_first
    met = side(left, "a").join(side(right, "b"), [*key, "half"])
    return met.where(order & (flips <= 2) & first_band & once & (F.levenshtein("a_word", "b_word", 1) == 1)).select(F.col("a_word").alias("a"), F.col("a_n").alias("n_a"), F.col("b_word").alias("b"), F.col("b_n").alias("n_b"))


def roots_of(shelf: Shelf, forms: DataFrame) -> DataFrame:
    """word, root: the end of each chain of forms (word, form), which has no circles."""
    now = shelf.put(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")))
    while not now.where("moved").isEmpty():
        up = now.select(F.col("word").alias("root"), F.col("root").alias("above"))
        after = shelf.put(now.join(up, "root", "left").select("word", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved")))
        shelf.take_off(now)
        now = after
    return now.select("word", "root")


def variants(spark: SparkSession, docs: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """word, form, root, n, n_near, form_n for each word of docs (doc_id, text)."""
    shelf = Shelf(spark, "spelling")
    words = shelf.put(count_words(docs))
    pairs = shelf.put(near_pairs(words, crowded))
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("near_n")).unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("near"), F.col("n_a").alias("near_n")))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), "near")).alias("best"))
    above = -F.col("best.minus") >= 2 * F.col("n")
    found = shelf.put(words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(above, F.col("best.near")).alias("form"), F.when(above, -F.col("best.minus")).alias("form_n")))
    roots = roots_of(shelf, found.where("form IS NOT NULL"))
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
