"""Joins of texts with globs by equality.

A glob's letters before its first * or ? are a key that a fitting text begins with; a glob that begins with one is keyed by its letters at the end. A text
is looked up by its own beginnings and ends of the lengths that occur among the globs, so no text meets globs that can't fit it, whatever the number of globs,
and the pattern is only tried on what meets. A glob without wildcards is keyed by all its letters and looked up by whole texts. A glob without such letters
meets all texts, since it has nothing to be known by.

Most beginnings and ends of texts are no glob's key. They are passed over before the join's shuffle by a table of key hashes (`marks`) that is broadcast: at
most 2^WORD_BITS words of 64 bits, of which each key sets three bits in one, whatever the number of globs. It never passes over a key that is there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.filters.predicates import glob_column

#: Letters that fit an ASCII letter without regard to case, besides its own two.
OTHERS = ("ſİıK", "siik")
#: Letters of a key: up to the first wildcard, and only ASCII, whose cases are plain.
BEGINNING, END = r"^[^*?\x{80}-\x{10FFFF}]*", r"[^*?\x{80}-\x{10FFFF}]*$"

#: Words of the table of key hashes: at most a million, so that it may be broadcast. With 5 million keys it lets 1 % of other keys through.
WORD_BITS = 20


def folded(c: Column) -> Column:
    return F.lower(F.translate(c, *OTHERS))


def keyed_globs(globs: DataFrame, glob: str) -> DataFrame:
    """globs with their key, a mark and letters, and its length, below 0 for letters at the end, null for a whole text."""
    first, last = F.regexp_extract(folded(F.col(glob)), BEGINNING, 0), F.regexp_extract(folded(F.col(glob)), END, 0)
    ends = (first == "") & (last != "")
    whole = first == folded(F.col(glob))  # no wildcard
    key = F.when(whole, F.concat(F.lit("="), first)).when(ends, F.concat(F.lit(">"), last)).otherwise(F.concat(F.lit("<"), first))
    return globs.withColumns({"_key": key, "_size": F.when(whole, None).when(ends, -F.length(last)).otherwise(F.length(first)), "_pattern": glob_column(F.col(glob))})


def hashed(keyed: DataFrame) -> DataFrame:
    """keyed with the word of a key in the table of hashes (_word) and its bits there (_own)."""
    h = F.col("_hash")
    bit = lambda at: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, at).bitwiseAND(63).cast("int"))
    return keyed.withColumn("_hash", F.xxhash64("_key")).withColumns({"_word": F.shiftrightunsigned(h, 64 - WORD_BITS), "_own": bit(0).bitwiseOR(bit(6)).bitwiseOR(bit(12))}).drop("_hash")


def marks(keyed: DataFrame) -> DataFrame:
    """_word, _bits: the keys' hashes."""
    return hashed(keyed).groupBy("_word").agg(F.bit_or("_own").alias("_bits"))


def glob_join(rows: DataFrame, text: Column, globs: DataFrame, glob: str) -> DataFrame:
    """Each row with each glob that fits its text. The names of rows and globs must differ; null texts and globs fit nothing."""
    keyed = keyed_globs(globs.where(F.col(glob).isNotNull()), glob)
    sizes = keyed.agg(F.collect_set(F.coalesce("_size", F.lit(1 << 30)))).scalar()  # as many as there are lengths of globs
    texts = rows.withColumns({"_asked": text, "_sizes": sizes}).withColumn("_text", folded(F.col("_asked")))
    ended = texts.withColumn("_end", F.when(F.endswith("_text", F.lit("\n")), F.left("_text", F.length("_text") - 1)).otherwise(F.col("_text")))
    sized = ended.withColumn("_n", F.explode("_sizes"))
    n, whole = F.col("_n"), F.col("_n") == 1 << 30
    key = F.when(whole, F.concat(F.lit("="), "_end")).when(n < 0, F.concat(F.lit(">"), F.right("_end", -n))).otherwise(F.concat(F.lit("<"), F.left("_text", n)))
    asked = sized.where(whole | (F.length("_text") >= F.abs(n))).withColumn("_key", key).drop("_sizes", "_n", "_text", "_end")
    likely = hashed(asked).join(F.broadcast(marks(keyed)), "_word").where(F.col("_bits").bitwiseAND(F.col("_own")) == F.col("_own"))
    met = likely.drop("_word", "_own", "_bits").join(keyed, "_key").where(F.regexp_like("_asked", F.col("_pattern")))
    return met.drop("_key", "_asked", "_size", "_pattern")
