"""Sharding by a two-pass external shuffle.

Pass one scatters records uniformly into buckets that fit into memory: it writes them as they come, numbered, and a record's bucket is
a seeded hash of its number, so copies, hot sources and ties are spread like anything else. Pass two brings each bucket into one task's memory,
shuffles it by Fisher and Yates and writes it. Buckets one after the other are a uniform permutation of all records; shard s is the s-th
of `shards` equal runs of it, so row counts of shards differ by one at most (law `rows`).

Only numbers of rows by bucket are carried between tasks, as prefix sums in two levels. Both passes read written tables, so a lost
task gives the same rows again. The same files, seed and sizes give the same shards; another seed gives others.

Defined results: rows with nulls in any column, empty texts and equal rows are records like others, none is merged or lost. A record
longer than a bucket makes a longer bucket. All columns are kept within the struct `record`, so no name can clash with `shard` and `slot`.
An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.llm.shelf import Shelf

#: Bytes of a bucket on average; a task holds one, its Arrow form and its shuffled copy.
BUCKET_BYTES = 32 << 20
#: Buckets at least, so that tasks are even on small tables, too.
LEAST_BUCKETS = 1024
#: Buckets whose starts are one row of the upper level of prefix sums.
SUPER = 1024


def fisher_yates(n: int, seed: tuple[int, ...]) -> np.ndarray:
    """A uniform permutation of range(n)."""
    order = list(range(n))
    picks = np.random.default_rng(seed).integers(0, np.arange(1, n + 1)).tolist() if n else []
    for i in range(n - 1, 0, -1):
        j = picks[i]
        order[i], order[j] = order[j], order[i]
    return np.array(order, dtype=np.int64)


def bucket_of(number, buckets: int, seed: int):
    return F.pmod(F.xxhash64(F.lit(seed).cast("long"), number), F.lit(buckets).cast("long"))


def starts_of(buckets: DataFrame) -> DataFrame:
    """(bucket, start): rows in buckets before each. buckets: bucket, one row for each record."""
    counts = buckets.groupBy("bucket").agg(F.count("*").alias("n")).withColumn("upper", F.floor(F.col("bucket") / SUPER))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    upper = counts.groupBy("upper").agg(F.sum("n").alias("n")).select("upper", before(Window.orderBy("upper")).alias("base"))  # a row for SUPER buckets
    own = counts.withColumn("own", before(Window.partitionBy("upper").orderBy("bucket")))
    return own.join(upper, "upper").select("bucket", (F.col("own") + F.col("base")).alias("start"))


def shuffle_bucket(shards: int, total: int, seed: int) -> Callable[[pa.Table], pa.Table]:
    """Shuffles a bucket (record, number, bucket, start) and gives each record its shard and slot."""

    def run(rows: pa.Table) -> pa.Table:
        by_number = np.argsort(rows["number"].to_numpy(), kind="stable")
        order = by_number[fisher_yates(len(rows), (seed, rows["bucket"][0].as_py()))]
        place = rows["start"][0].as_py() + np.arange(len(rows), dtype=np.int64)
        shard = place * shards // total
        first = -(-shard * total // shards)
        return pa.table({"record": rows["record"].take(pa.array(order)), "shard": shard.astype(np.int32), "slot": place - first})

    return run


def external_shuffle(spark: SparkSession, records: DataFrame, shards: int = 24, text: str = "text", seed: int = 20, bucket_bytes: int = BUCKET_BYTES, least_buckets: int = LEAST_BUCKETS, folder: str | None = None) -> DataFrame:
    """record (all columns), shard, slot: all records in a random order, dealt evenly.

    The shards are written to the folder, else to one of intermediate tables, as Parquet below shard=<n>, each file in the order of slots.
    """
    shelf = Shelf(spark, "sharding")
    size = F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long") + 8
    scattered = shelf.put(records.select(F.struct(*(F.col(f"`{c}`") for c in records.columns)).alias("record"), size.alias("size"), F.monotonically_increasing_id().alias("number")), "zstd")
    whole = scattered.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("size")).first()
    buckets = max(least_buckets, -(-whole.size // bucket_bytes))
    dealt = scattered.select("record", "number", bucket_of(F.col("number"), buckets, seed).alias("bucket"))
    record = scattered.schema["record"].dataType.simpleString()
    placed = dealt.join(starts_of(dealt.select("bucket")), "bucket").groupBy("bucket")
    done = placed.applyInArrow(shuffle_bucket(shards, whole.n, seed), f"record {record}, shard int, slot long")
    path = folder or f"{shelf.folder}/shards"
    done.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path, compression="zstd")
    shelf.take_off(scattered)
    return spark.read.schema(done.schema).parquet(path)
