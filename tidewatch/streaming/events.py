"""Streams of events: the batch operators' semantics, kept up to date.

State is Spark's own. `newest` is a grouped `max_by`: an older row that comes late changes nothing, and the state grows with the
number of keys. `newest_live`, `history` and `failure_streaks` take `idle`: a key that has had no rows for so long by the clock is
forgotten (see `keyed`), so their state is bounded by the keys in use. No row is left out because other keys are further on in time.
`history` calls Python for each row and key; `LiveHistory` keeps the same in a table, by Spark's own functions, for batches of many rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators import metrics
from tidewatch.sources.tables import Table
from tidewatch.streaming.keyed import kept_by_key, no_empty_batches


def read_log(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    """An append-only event log as a stream; the rate is bounded by files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def newest(stream: DataFrame, key: str, order: tuple[str, ...]) -> DataFrame:
    """The newest row of each key (by order, ascending; nulls are oldest), for update or complete mode."""
    rows = stream.groupBy(key).agg(F.max_by(F.struct(*stream.columns), F.struct(*order)).alias("row"))
    return rows.select("row.*")


def newest_live(stream: DataFrame, key: str, time: str, idle: str | None = "3 hours", arrival: str | None = None, prefer_finished: str | None = None) -> DataFrame:
    """The newest row of each key by time, sent again whenever it changes; of one time the first to arrive.

    arrival: a column that orders rows of one batch, such as a log id. prefer_finished: a column that, where the held row has none, lets a row of the same time in.
    """
    names, stamps = stream.columns, [f.name for f in stream.schema.fields if f.dataType.typeName() == "timestamp"]
    schema = ", ".join(f"`{f.name}` {'bigint' if f.name in stamps else f.dataType.simpleString()}" for f in stream.schema.fields)
    at, finish = names.index(time), names.index(prefer_finished) if prefer_finished else None

    def step(_: object, rows: Iterator[Row], held: tuple | None) -> tuple[list[Row], tuple]:
        best = before = tuple(held) if held is not None else None
        for row in map(tuple, sorted(rows, key=lambda r: r[arrival]) if arrival else rows):
            finished = finish is not None and best is not None and row[at] == best[at] and best[finish] is None and row[finish] is not None
            if best is None or finished or (row[at] is not None and (best[at] is None or row[at] > best[at])):
                best = row
        return [] if best == before else [Row(**dict(zip(names, best, strict=True)))], best

    numbers = stream.select(*(F.unix_micros(c).alias(c) if c in stamps else c for c in names))
    kept = kept_by_key(numbers, key, schema, schema, step, idle)
    return kept.select(*(F.timestamp_micros(c).alias(c) if c in stamps else c for c in names))


def history(stream: DataFrame, keep: int = 1000, idle: str | None = "3 hours") -> DataFrame:
    """Each key's newest samples, one for each moment (the last to arrive), oldest first: key, n and the arrays ts (microseconds), current and child, sent with each change.

    stream: key, ts, id (order of arrival), current, child.
    """
    arrays = "ts array<long>, current array<long>, child array<long>"

    def step(key: object, rows: Iterator[Row], held: tuple | None) -> tuple[list[Row], tuple]:
        known = dict(zip(held[0], zip(*held[1:], strict=True), strict=True)) if held is not None else {}
        for r in rows:
            if r["at"] not in known or known[r["at"]][0] <= r["id"]:
                known[r["at"]] = r["id"], r["current"], r["child"]
        last = sorted(known.items())[-keep:]
        ts, ids, current, child = [t for t, _ in last], *([v[i] for _, v in last] for i in range(3))
        return [Row(key=key, n=len(last), ts=ts, current=current, child=child)], (ts, ids, current, child)

    rows = stream.withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
    return kept_by_key(rows, "key", f"key string, n int, {arrays}", "ts array<long>, id array<long>, current array<long>, child array<long>", step, idle)


class LiveHistory(Table):
    """`history` as a table of key, ts, id, current and child, in buckets of keys; a batch writes the buckets that it touches anew. No key is forgotten.

    A batch is brought down to each key's newest samples before it meets the table's, so a bucket's task gets at most twice as many rows of a key as are kept.
    """

    def __init__(self, spark: SparkSession, path: str, keep: int = 1000, buckets: int = 64):
        super().__init__(spark, path, "key string, ts timestamp_ntz, id long, current long, child long")
        self.keep, self.buckets = keep, buckets

    def take(self, batch: DataFrame, number: int, writer: str = "stream") -> bool:
        """Take a batch of samples in once; whether it was new. batch: key, ts (a timestamp_ntz), id (order of arrival), current, child."""
        now = self.manifest()
        if now["writers"].get(writer, -1) >= number:
            return False
        bucket = F.pmod(F.xxhash64("key"), F.lit(self.buckets)).cast("int").alias("bucket")
        touched, parts = [r.bucket for r in batch.select(bucket).distinct().collect()], dict(now["parts"])  # no more than buckets
        if touched:
            known = self.rows(sorted(parts[str(b)] for b in touched if str(b) in parts))
            both = known.unionByName(metrics.newest_samples(batch, self.keep)).withColumn("bucket", bucket)
            folder = f"data/{uuid.uuid4().hex}"
            metrics.newest_samples(both.repartition("bucket"), self.keep, "bucket", "key").write.partitionBy("bucket").parquet(f"{self.path}/{folder}")
            parts |= {str(b): f"{folder}/bucket={b}" for b in touched}
        self.commit(now, parts, now["writers"] | {writer: number})
        return True


def alive(latest: DataFrame, as_of: str, seconds: int = 30) -> DataFrame:
    """Latest heartbeats with whether they are online; liveness is decided when read."""
    age = F.unix_seconds(F.lit(as_of).cast("timestamp")) - F.unix_seconds(F.col("Updated").cast("timestamp"))
    return latest.withColumn("IsOnline", age <= seconds)


def failure_streaks(stream: DataFrame, idle: str | None = None) -> DataFrame:
    """Consecutive failures of each key up to each check. stream: key, ts, id, ok; rows of a batch are taken by ts and id. idle: after so long a key begins anew."""

    def step(_: object, rows: Iterator[Row], held: tuple | None) -> tuple[list[Row], tuple]:
        streak, out = held[0] if held is not None else 0, []
        for r in sorted(rows, key=lambda r: (r["ts"], r["id"])):
            streak = 0 if r["ok"] else streak + 1
            out.append(Row(key=r["key"], ts=r["ts"], streak=streak))
        return out, (streak,)

    return kept_by_key(stream, "key", "key string, ts timestamp, streak long", "streak long", step, idle)


def fan_out(stream: DataFrame, checkpoint: str, *sinks: Callable[[DataFrame, int], None], every: str | None = None, mode: str = "append", persist: bool = True):
    """One query that hands each batch to several sinks; every: a processing time, else all that is there, once. mode: the output mode, `update` for `newest_live`, `history` and `failure_streaks`.

    persist: keep a batch while the sinks read it; without, each read makes it anew, which is less work where it is only columns of files, and wrong for one that comes from state.
    """

    def both(batch: DataFrame, number: int) -> None:
        if persist:
            batch.persist()
        for sink in sinks:
            sink(batch, number)
        if persist:
            batch.unpersist()

    writer = stream.writeStream.outputMode(mode).foreachBatch(both).option("checkpointLocation", checkpoint)
    if every:
        return writer.trigger(processingTime=every).start()
    with no_empty_batches(stream.sparkSession):
        return writer.trigger(availableNow=True).start()


def with_backfill(live: DataFrame, backfill: DataFrame, key: str = "key", ts: str = "ts") -> DataFrame:
    """Live samples and, for the time before each key's first live one, those of the backfill."""
    first = live.groupBy(key).agg(F.min(ts).alias("_first"))
    older = backfill.join(first, key, "left").where(F.col("_first").isNull() | (F.col(ts) < F.col("_first"))).drop("_first")
    return live.unionByName(older).dropDuplicates([key, ts])
