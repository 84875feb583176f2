"""State by key: each key's state ends by itself, when the key has been idle, and never because other keys are further on.

State is in RocksDB through `transformWithState`. `idle` is counted from a key's last row by the clock, as time to live of the key's own values;
there is no watermark, so a row is never late. Rows of one key in one batch are taken in the order of arrival where a column of it is named.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
EMPTY_BATCHES = "spark.sql.streaming.noDataMicroBatches.enabled"


def milliseconds(interval: str | None) -> int | None:
    """'3 hours' in milliseconds."""
    if interval is None:
        return None
    n, unit = interval.split()
    return int(n) * {"millisecond": 1, "second": 1000, "minute": 60_000, "hour": 3_600_000, "day": 86_400_000}[unit.removesuffix("s")]


@contextmanager
def no_empty_batches(spark: SparkSession) -> Iterator[None]:
    """For starting streams that shall end when all that is there is done: Spark would go on with batches without rows for the sake of clocks."""
    before = spark.conf.get(EMPTY_BATCHES)
    spark.conf.set(EMPTY_BATCHES, "false")
    try:
        yield
    finally:
        spark.conf.set(EMPTY_BATCHES, before)


def use_rocksdb(spark: SparkSession) -> None:
    """Streams that start from now on keep their state in RocksDB; one that goes on keeps the store that it began with."""
    spark.conf.set(PROVIDER, ROCKSDB)


class Keeper(StatefulProcessor):
    """One value for each key: step(key, rows, value or None) -> (rows that go out, value)."""

    def __init__(self, state: str, step: Callable[[object, Iterator[Row], tuple | None], tuple[list[Row], tuple]], idle: str | None):
        self.state, self.step, self.idle = state, step, milliseconds(idle)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.value = handle.getValueState("value", self.state, self.idle)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        out, after = self.step(key[0], rows, self.value.get() if self.value.exists() else None)
        self.value.update(after)  # its time to live begins anew
        yield from out

    def close(self) -> None:
        pass


def kept_by_key(stream: DataFrame, key: str, output: str, state: str, step: Callable, idle: str | None = None) -> DataFrame:
    """step's rows for each key with new rows; a key that is idle for so long is forgotten and begins anew."""
    use_rocksdb(stream.sparkSession)
    return stream.groupBy(key).transformWithState(Keeper(state, step, idle), output, "Update", "ProcessingTime" if idle else "None")


class Heartbeats(StatefulProcessor):
    """Online with a key's heartbeat, Offline when none came for a while, forgotten when idle. Rows go out when a state changes."""

    def __init__(self, updated: str, alive: str, idle: str):
        self.updated, self.alive, self.idle = updated, milliseconds(alive), milliseconds(idle)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "updated timestamp_ntz, state string, timer long")

    def _until(self, now: int, updated: object, state: str, wait: int) -> None:
        self.handle.registerTimer(now + wait)
        self.last.update((updated, state, now + wait))

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        now, newest = timerValues.getCurrentProcessingTimeInMs(), max(r[self.updated] for r in rows)
        held = self.last.get() if self.last.exists() else None
        if held is not None:
            self.handle.deleteTimer(held[2])
            newest = max(newest, held[0])
        self._until(now, newest, "Online", self.alive)
        if held is None or held[1] != "Online":
            yield Row(key=key[0], updated=newest, state="Online")

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[Row]:
        now, (updated, state, _) = timerValues.getCurrentProcessingTimeInMs(), self.last.get()
        if state == "Offline":
            self.last.clear()
            return
        self._until(now, updated, "Offline", self.idle)
        yield Row(key=key[0], updated=updated, state="Offline")

    def close(self) -> None:
        pass


def heartbeat_states(stream: DataFrame, key: str, updated: str, alive: str = "30 seconds", idle: str = "10 minutes") -> DataFrame:
    """key, updated, state: what each key's state becomes. updated: a timestamp_ntz column without nulls."""
    use_rocksdb(stream.sparkSession)
    return stream.groupBy(key).transformWithState(Heartbeats(updated, alive, idle), "key string, updated timestamp_ntz, state string", "Update", "ProcessingTime")


class Backfill(StatefulProcessor):
    """Live samples as they come, and samples of a backfill from before the key's first live one, each moment once.

    Backfilled samples wait for the first live one; a key that gets none for a while has its backfill sent without.
    """

    def __init__(self, moment: str, names: list[str], schema: str, wait: str, idle: str):
        self.moment, self.names, self.schema, self.wait, self.idle = moment, names, schema, milliseconds(wait), milliseconds(idle)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.first = handle.getValueState("first", "at timestamp_ntz, timer long", None)
        self.seen = handle.getListState("seen", "at timestamp_ntz", self.idle)  # read and added to at once: a call for each moment would be most of the time
        self.waiting = handle.getListState("waiting", self.schema, self.idle)

    def _sent(self) -> set:
        return {r[0] for r in self.seen.get()} if self.seen.exists() else set()

    def _send(self, rows: list[Row], sent: set) -> Iterator[Row]:
        """The rows of new moments, each once."""
        fresh = {}
        for row in rows:
            if row[self.moment] not in sent:
                fresh.setdefault(row[self.moment], row)
        if fresh:
            self.seen.appendList([(at,) for at in fresh])
        sent.update(fresh)
        for row in fresh.values():
            yield Row(**{n: row[n] for n in self.names})

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        held = self.first.get() if self.first.exists() else (None, None)
        first, live, late = held[0], [], []
        for row in rows:
            (live if row["_live"] else late).append(row)
        if live:
            first = min([r[self.moment] for r in live] + ([first] if first is not None else []))
        if first is None:  # no live one yet
            if late:
                self.waiting.appendList([tuple(r[n] for n in self.names) for r in late])
            if held[1] is None:
                until = timerValues.getCurrentProcessingTimeInMs() + self.wait
                self.handle.registerTimer(until)
                self.first.update((None, until))
            return
        if held[1] is not None:
            self.handle.deleteTimer(held[1])
        self.first.update((first, None))
        if held[0] is None:
            late += [Row(**dict(zip(self.names, r, strict=True))) for r in self.waiting.get()] if self.waiting.exists() else []
            self.waiting.clear()
        # live samples first, so that of one moment the live one goes out
        yield from self._send(live + [r for r in late if r[self.moment] < first], self._sent())

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[Row]:
        late = [Row(**dict(zip(self.names, r, strict=True))) for r in self.waiting.get()] if self.waiting.exists() else []
        yield from self._send(late, self._sent())
        self.waiting.clear()
        self.first.clear()

    def close(self) -> None:
        pass


def live_with_backfill(live: DataFrame, backfill: DataFrame, key: str, moment: str, wait: str = "1 minute", idle: str = "3 hours") -> DataFrame:
    """Two streams of the same columns as one: see Backfill. moment: a timestamp_ntz column without nulls."""
    use_rocksdb(live.sparkSession)
    both = live.withColumn("_live", F.lit(True)).unionByName(backfill.withColumn("_live", F.lit(False)))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in live.schema.fields)
    return both.groupBy(key).transformWithState(Backfill(moment, live.columns, schema, wait, idle), schema, "Append", "ProcessingTime")
