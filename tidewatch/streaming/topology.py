"""Topology kept up to date while events come in, in any order.

Each chunk's events are state. When some come in, the chunk's hops and places before and after are compared and only the difference goes out, as counts
to add: an event that comes between two others takes back one hop and adds two. The topology is the sum of all differences,
which are a log that can be packed to one row for each count.

`topology_deltas` keeps a chunk as state of its own, which ends by itself when the chunk is idle: a call for each chunk with new events, for streams that
go on for long. `LiveTopology` keeps the chunks in a table and finds a batch's differences with Spark's own functions, for batches of many chunks.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidewatch.operators.topology import EDGE, RECENT_SECONDS, state
from tidewatch.sources.tables import EventLog, Table
from tidewatch.streaming.keyed import milliseconds, use_rocksdb

#: kind: `hop` and `both` (chunks done at the source and seen at the target) of two places; `done`, `open` and `error` of a place. at: the second of a place's finish or start.
DELTAS = "kind string, source string, source_pipeline string, target string, target_pipeline string, at long, n long"
HELD = "events array<struct<id: string, start: bigint, arrival: bigint, finish: bigint, service: string, pipeline: string, failed: boolean>>"


def counts_of(events: dict[str, tuple]) -> Counter:
    """What a chunk's events (by id: start, arrival, finish, service, pipeline, failed) add to the topology."""
    found: Counter = Counter()
    before, seen, finished = None, set(), set()
    for start, _, finish, service, pipeline, failed in (e for _, e in sorted(events.items(), key=lambda item: (item[1][0], item[0]))):
        here = service, pipeline
        if before is not None and before != here:
            found["hop", *before, *here, None] += 1
        before = here
        seen.add(here)
        if finish is not None:
            finished.add(here)
        found["open" if finish is None else "done", *here, None, None, (start if finish is None else finish) // 1_000_000] += 1
        if failed:
            found["error", *here, None, None, None] += 1
    found.update(("both", *a, *b, None) for a in finished for b in seen)
    return found


class Chunk(StatefulProcessor):
    def __init__(self, idle: str | None):
        self.idle = milliseconds(idle)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.events = handle.getValueState("events", HELD, self.idle)  # a chunk's few events, read and written at once

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        held = {e[0]: tuple(e[1:]) for e in self.events.get()[0]} if self.events.exists() else {}
        after = dict(held)
        for r in rows:
            known = after.get(r["id"])
            if known is None or (r["start"], -r["arrival"]) > (known[0], -known[1]):  # newer, or of one time the earlier to arrive
                after[r["id"]] = r["start"], r["arrival"], r["finish"], r["service"], r["pipeline"], r["failed"]
        self.events.update(([(i, *event) for i, event in after.items()],))
        difference = counts_of(after)
        difference.subtract(counts_of(held))
        for (kind, a, b, c, d, at), n in difference.items():
            if n:
                yield Row(kind=kind, source=a, source_pipeline=b, target=c, target_pipeline=d, at=at, n=n)

    def close(self) -> None:
        pass


def held_columns(events: DataFrame, arrival: Column) -> DataFrame:
    """What is kept of events: Name and the fields of HELD."""
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    failed = F.coalesce(F.col("Error") != "", F.lit(False))
    return events.select("Name", F.col("Id").alias("id"), micros("Start").alias("start"), arrival.cast("long").alias("arrival"), micros("Finish").alias("finish"), F.col("Service").alias("service"), F.col("Pipeline").alias("pipeline"), failed.alias("failed"))


def topology_deltas(events: DataFrame, arrival: Column, idle: str | None = None) -> DataFrame:
    """What each batch of events changes in the counts (DELTAS). arrival: a long that grows as events come in.

    idle: how long after its last event a chunk is taken for complete; an event that comes still later counts as a new chunk's.
    """
    use_rocksdb(events.sparkSession)
    return held_columns(events, arrival).groupBy("Name").transformWithState(Chunk(idle), DELTAS, "Append", "ProcessingTime" if idle else "None")


#: A chunk's events in the order of an upsert. fresh: came with the last batch; kept: the newest of its id. Neither: it was replaced by the last batch.
CHUNKS = "Name string, events array<struct<id: string, back: bigint, arrival: bigint, fresh: boolean, finish: bigint, service: string, pipeline: string, failed: boolean, kept: boolean>>"
EVENT = ("id", "back", "arrival", "fresh", "finish", "service", "pipeline", "failed")


def merged(chunks: DataFrame) -> DataFrame:
    """One row for each bucket and Name, with all its rows' events: of an id the newest, or of one time the earlier to arrive, and what that replaces."""
    grouped = chunks.groupBy("bucket", "Name").agg(F.array_sort(F.flatten(F.collect_list("events"))).alias("e"))
    newest = lambda e, i: (i == 0) | ~F.get("e", i - 1)["id"].eqNullSafe(e["id"])
    marked = F.transform("e", lambda e, i: F.struct(*(e[c].alias(c) for c in EVENT), newest(e, i).alias("kept")))
    return grouped.select("bucket", "Name", F.filter(marked, lambda e: e["kept"] | ~e["fresh"]).alias("events"))


def differences(chunks: DataFrame) -> DataFrame:
    """What the last batch changed in the counts (DELTAS): `counts_of` the events kept less those of the events before. chunks: CHUNKS."""
    sides = F.explode(F.array(F.struct(F.lit(1).alias("n"), F.filter("events", lambda e: e["kept"]).alias("e")), F.struct(F.lit(-1).alias("n"), F.filter("events", lambda e: ~e["fresh"]).alias("e"))))
    place = lambda e: F.struct(e["service"].alias("service"), e["pipeline"].alias("pipeline"))
    step = lambda e: F.struct((-e["back"]).alias("start"), e["id"].alias("id"), place(e).alias("at"), e["finish"].alias("finish"), e["failed"].alias("failed"))
    walks = chunks.where(F.exists("events", lambda e: e["fresh"] | ~e["kept"])).select(sides.alias("side")).select("side.n", F.array_sort(F.transform("side.e", step)).alias("walk"))
    none, second = F.lit(None), lambda micros: F.unix_seconds(F.timestamp_micros(micros))
    text = lambda place, field: (place[field] if place is not None else none.cast("string"))
    item = lambda kind, a, b=None, at=none: F.struct(kind.alias("kind"), text(a, "service").alias("source"), text(a, "pipeline").alias("source_pipeline"), text(b, "service").alias("target"), text(b, "pipeline").alias("target_pipeline"), at.cast("long").alias("at"))
    places = walks.select("n", "walk", F.array_distinct(F.transform("walk", lambda e: e["at"])).alias("seen"), F.array_distinct(F.transform(F.filter("walk", lambda e: e["finish"].isNotNull()), lambda e: e["at"])).alias("finished"))
    moved = F.transform(F.filter(F.transform("walk", lambda e, i: F.struct(F.get("walk", i - 1)["at"].alias("a"), e["at"].alias("b"))), lambda m: m["a"].isNotNull() & (m["a"] != m["b"])), lambda m: item(F.lit("hop"), m["a"], m["b"]))
    own = F.transform("walk", lambda e: item(F.when(e["finish"].isNull(), "open").otherwise("done"), e["at"], None, second(F.coalesce(e["finish"], e["start"]))))
    errors = F.transform(F.filter("walk", lambda e: e["failed"]), lambda e: item(F.lit("error"), e["at"]))
    both = F.flatten(F.transform("finished", lambda a: F.transform("seen", lambda b: item(F.lit("both"), a, b))))
    counted = places.select("n", F.explode(F.concat(moved, own, errors, both)).alias("i")).select("i.*", "n")
    return summed(counted)


class LiveTopology(Table):
    """Chunks in buckets of their names, and the log of what batches change (`log`, DELTAS). A batch writes the buckets that it touches anew.

    One shuffle brings a batch's events to their chunks; differences are made within a chunk's row. A batch is logged before its chunks are committed, and
    either counts a batch once, so one that is run again finds the chunks as they were or has nothing to do.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        super().__init__(spark, f"{path}/chunks", CHUNKS)
        self.log, self.buckets = EventLog(spark, f"{path}/deltas", DELTAS), buckets

    def take(self, events: DataFrame, arrival: Column, number: int, writer: str = "stream") -> bool:
        """Take a batch of events in once; whether it was new. arrival: a long that grows as events come in."""
        now = self.manifest()
        if now["writers"].get(writer, -1) >= number:
            return False
        bucket = F.pmod(F.xxhash64("Name"), F.lit(self.buckets)).cast("int").alias("bucket")
        touched, parts = [r.bucket for r in events.select(bucket).distinct().collect()], dict(now["parts"])  # no more than buckets
        if touched:
            new = held_columns(events, arrival).withColumns({"back": -F.col("start"), "fresh": F.lit(True)}).select("Name", F.array(F.struct(*EVENT)).alias("events"))
            held = F.transform(F.filter("events", lambda e: e["kept"]), lambda e: F.struct(*(F.lit(False).alias(c) if c == "fresh" else e[c].alias(c) for c in EVENT)))
            known = self.rows(sorted(parts[str(b)] for b in touched if str(b) in parts)).select("Name", held.alias("events"))
            folder = f"data/{uuid.uuid4().hex}"
            merged(known.unionByName(new).withColumn("bucket", bucket).repartition("bucket")).write.partitionBy("bucket").parquet(f"{self.path}/{folder}")
            self.log.append(differences(self.rows([folder])), number, writer)
            parts |= {str(b): f"{folder}/bucket={b}" for b in touched}
        self.commit(now, parts, now["writers"] | {writer: number})
        return True


def summed(deltas: DataFrame) -> DataFrame:
    """One row for each count, which is what a log of deltas is packed to."""
    return deltas.groupBy("kind", *EDGE, "at").agg(F.sum("n").alias("n")).where("n != 0")


def edges_of(deltas: DataFrame) -> DataFrame:
    """`operators.topology.edges` from deltas."""
    counts = summed(deltas)
    n = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("n"))), F.lit(0))
    pairs = counts.where("kind IN ('hop', 'both')").groupBy(*EDGE).agg(n("hop").alias("hops"), n("both").alias("both"))
    own = F.when((F.col("source") == F.col("target")) & (F.col("source_pipeline") == F.col("target_pipeline")), F.col("both"))
    pairs = pairs.withColumn("at_source", F.coalesce(F.max(own).over(Window.partitionBy("source", "source_pipeline")), F.lit(0)))
    latest = counts.where("kind IN ('done', 'open')").agg(F.max("at")).scalar()
    recent = F.coalesce(F.sum(F.when((F.col("kind") == "done") & (latest - F.col("at") <= RECENT_SECONDS), F.col("n"))), F.lit(0))
    rows = counts.where("kind IN ('done', 'open', 'error')").groupBy("source", "source_pipeline").agg(n("error").alias("errors"), recent.alias("recent"), n("open").alias("open"), n("done").alias("done"))
    states = rows.select("source", "source_pipeline", state(F.col("errors"), F.col("recent"), F.col("open"), F.col("done")).alias("state"))
    joined = pairs.where("hops > 0").join(states, ["source", "source_pipeline"], "left")
    return joined.select(*EDGE, F.col("hops").alias("done"), (F.col("at_source") - F.col("both")).alias("waiting"), F.coalesce("state", F.lit("NotStarted")).alias("state"))
