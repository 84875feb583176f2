import time
from datetime import datetime, timedelta

from pyspark.sql import Row
from pyspark.sql import functions as F

from tidewatch.operators import metrics
from tidewatch.operators.events import upsert
from tidewatch.plans import further
from tidewatch.streaming import events as st
from tidewatch.streaming import keyed

T0 = datetime(2024, 1, 1)
SCHEMA = "Id string, Start timestamp_ntz, Finish timestamp_ntz, RecordCount int"


def write(spark, path, rows, schema=SCHEMA):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def test_newest_is_the_batch_upsert(spark, tmp_path):
    log = str(tmp_path / "log")
    for k in range(4):
        write(spark, log, [(str(i % 5), T0 + timedelta(seconds=(i * 7 + k * 3) % 20), None if i % 2 else T0, i) for i in range(12)])
    stream = st.newest(st.read_log(spark, log, SCHEMA, 1), "Id", ("Start", "Finish", "RecordCount"))
    query = stream.writeStream.outputMode("complete").format("memory").queryName("newest").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted(map(str, spark.table("newest").collect())) == sorted(map(str, upsert(spark.read.parquet(log)).collect()))


def test_streaks_are_the_batch_streaks(spark, tmp_path):
    log, schema = str(tmp_path / "log"), "key string, ts timestamp, ok boolean, id long"
    for k in range(3):
        write(spark, log, [("ab"[i % 2], T0 + timedelta(seconds=k * 100 + i), (i * 5 + k) % 3 == 0, k * 100 + i) for i in range(10)], schema)
    got: list = []
    query = st.fan_out(st.failure_streaks(st.read_log(spark, log, schema, 1)), str(tmp_path / "c"), lambda batch, _: got.extend(batch.collect()))
    query.awaitTermination(120)
    files = metrics.streaks(spark.read.parquet(log)).select("key", F.col("ts"), "streak").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, files))


def run(stream, tmp_path, mode="update"):
    got: list = []
    with keyed.no_empty_batches(stream.sparkSession):
        query = stream.writeStream.outputMode(mode).foreachBatch(lambda batch, _: got.append(sorted(map(tuple, batch.collect()), key=str))).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert query.awaitTermination(180)
    return got


def test_history_is_the_batch_history(spark, tmp_path):
    log, schema = str(tmp_path / "log"), "key string, ts timestamp, id long, current long, child long"
    for k in range(4):
        write(spark, log, [("ab"[i % 2], T0 + timedelta(seconds=(i * 5 + k * 3) % 17, microseconds=i % 3), k * 100 + i, i + k, i) for i in range(12)], schema)
    got = run(st.history(st.read_log(spark, log, schema, 1), keep=4), tmp_path)
    last = {r[0]: r for batch in got for r in batch}
    want: dict = {}
    for r in metrics.history(spark.read.schema(schema).parquet(log), 4).select("key", F.unix_micros("ts").alias("ts"), "current", "child").orderBy("key", "ts").collect():
        want.setdefault(r.key, []).append((r.ts, r.current, r.child))
    assert {k: list(zip(r[2], r[3], r[4], strict=True)) for k, r in last.items()} == want and len(want) == 2


def test_history_of_batches_is_the_batch_history(spark, tmp_path):
    log, schema = str(tmp_path / "log"), "key string, ts timestamp_ntz, id long, current long, child long"
    table = st.LiveHistory(spark, str(tmp_path / "t"), keep=4, buckets=2)
    for k in range(4):  # moments that come again in one batch and in later ones, older ones later; a key without any, one that comes once
        rows = [("ab"[i % 2], T0 + timedelta(seconds=(i * 5 + k * 3) % 17, microseconds=i % 3), k * 100 + i, i + k, None if i == 7 else i) for i in range(24)]
        write(spark, log, [*rows, (None, T0, k * 100 + 50, k, k), *([("c", T0, 1, 1, 1)] if k == 1 else [])], schema)
        assert st.fan_out(st.read_log(spark, log, schema, 1), str(tmp_path / "c"), lambda batch, n: table.take(batch, n), persist=False).awaitTermination(180)
        want = metrics.history(spark.read.schema(schema).parquet(log), 4).select("key", "ts", "current", "child")
        assert sorted(map(str, table.read().select(*want.columns).collect())) == sorted(map(str, want.collect()))
    assert not table.take(spark.createDataFrame([("a", T0 + timedelta(9), 9999, 1, 1)], schema), 3)  # a batch that is run again
    assert sorted(map(str, table.read().drop("id").collect())) == sorted(map(str, want.collect()))
    table.vacuum()
    assert table.read().count() == 10


def test_the_history_query_keeps_no_state_in_python(spark, monkeypatch):
    monkeypatch.setattr(st, "kept_by_key", lambda *a, **k: (_ for _ in ()).throw(AssertionError("a call of Python for each key")))
    assert further.mem_history_streamed(spark, "/root/testdata/sf0.001").count() == 450


def test_newest_live_loses_no_late_key(spark, tmp_path):
    log, schema = str(tmp_path / "log"), "Id string, ts timestamp, n long"
    day, minute = timedelta(days=1), timedelta(minutes=1)
    for rows in ([("a", T0 + day, 1), ("z", None, 0)], [("b", T0 + day / 2, 2), ("b", T0 + day / 2 + minute, 3)], [("a", T0, 9), ("a", T0 + day, 8), ("c", T0 - 90 * day, 4), ("z", T0, 5)]):
        write(spark, log, rows, schema)
    got = run(st.newest_live(st.read_log(spark, log, schema, 1), "Id", "ts", arrival="n"), tmp_path)
    assert sorted((r[0], r[2]) for batch in got for r in batch) == [("a", 1), ("b", 3), ("c", 4), ("z", 0), ("z", 5)]


def test_ties_of_newest_live_are_those_of_the_upsert(spark, tmp_path):
    log, schema = str(tmp_path / "log"), "Id string, ts timestamp, done timestamp, n long"
    rows = [("a", T0, None, 1), ("a", T0, T0, 2), ("a", T0, T0 + timedelta(1), 3), ("b", T0, T0, 4), ("b", T0, None, 5), ("c", T0, None, 6), ("c", T0 + timedelta(1), None, 7), ("c", T0, T0, 8)]
    for i in (0, 3, 6):
        write(spark, log, rows[i : i + 3], schema)
    for option, want in ((None, {"a": 1, "b": 4, "c": 7}), ("done", {"a": 2, "b": 4, "c": 7})):
        folder = tmp_path / str(option)
        folder.mkdir()
        got = run(st.newest_live(st.read_log(spark, log, schema, 1), "Id", "ts", arrival="n", prefer_finished=option), folder)
        assert {r[0]: r[3] for batch in got for r in batch} == want
        batch = upsert(spark.read.schema(schema).parquet(log), time="ts", arrival="n", prefer_finished=option)
        assert {r.Id: r.n for r in batch.collect()} == want


def test_state_goes_on_after_a_restart(spark, tmp_path):
    log, schema = str(tmp_path / "log"), "Id string, ts timestamp, n long"
    every = []
    for k in range(3):
        rows = [(str((i * k) % 4), T0 + timedelta(seconds=(i * 7 + k * 5) % 11), 10 * k + i) for i in range(8)]
        every += rows
        write(spark, log, rows, schema)
        got = run(st.newest_live(st.read_log(spark, log, schema, 1), "Id", "ts", arrival="n"), tmp_path)  # the same checkpoint each time
        sent = {r[0]: r[2] for batch in got for r in batch} if k == 0 else sent | {r[0]: r[2] for batch in got for r in batch}
    assert sent == {r.Id: r.n for r in upsert(spark.createDataFrame(every, schema), time="ts", arrival="n").collect()}


def test_an_idle_key_is_forgotten_by_itself(spark, tmp_path):
    log, schema = str(tmp_path / "log"), "key string, ts timestamp, ok boolean, id long"
    stream = lambda: run(st.failure_streaks(st.read_log(spark, log, schema, 1), idle="20 seconds"), tmp_path)
    write(spark, log, [("a", T0, False, 1), ("b", T0, False, 2)], schema)
    before = time.time()
    assert [(r[0], r[2]) for r in stream()[0]] == [("a", 1), ("b", 1)]
    write(spark, log, [("a", T0 + timedelta(9), False, 3)], schema)
    again = [(r[0], r[2]) for r in stream()[0]]
    assert again == [("a", 2)] or time.time() - before > 20  # days of event time don't matter; a slow machine may have let the key go
    time.sleep(21)
    write(spark, log, [("a", T0, False, 4)], schema)
    assert [(r[0], r[2]) for r in stream()[0]] == [("a", 1)]


def test_heartbeat_states(spark, tmp_path):
    log, schema = str(tmp_path / "log"), "key string, Updated timestamp_ntz"
    write(spark, log, [("a", T0), ("b", T0), ("a", T0 - timedelta(1))], schema)
    got: list = []
    stream = keyed.heartbeat_states(st.read_log(spark, log, schema, 1), "key", "Updated", "8 seconds", "10 minutes")
    query = stream.writeStream.outputMode("update").foreachBatch(lambda batch, _: got.extend(map(tuple, batch.collect()))).option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="1 second").start()
    try:
        until = time.time() + 90
        while len(got) < 4 and time.time() < until:
            time.sleep(1)
        assert sorted(got[:2]) == [("a", T0, "Online"), ("b", T0, "Online")] and sorted(got[2:]) == [("a", T0, "Offline"), ("b", T0, "Offline")]
        write(spark, log, [("b", T0 + timedelta(1))], schema)
        while len(got) < 5 and time.time() < until:
            time.sleep(1)
        assert got[4] == ("b", T0 + timedelta(1), "Online")
    finally:
        query.stop()


def test_live_and_backfill_are_one_stream(spark, tmp_path):
    schema = "key string, ts timestamp_ntz, v string"
    s = lambda n: T0 + timedelta(seconds=n)
    live, old = str(tmp_path / "live"), str(tmp_path / "old")
    write(spark, old, [("a", s(1), "file"), ("a", s(5), "file"), ("b", s(9), "file"), ("b", s(9), "again")], schema)
    write(spark, live, [("c", s(3), "live")], schema)
    stream = lambda: keyed.live_with_backfill(st.read_log(spark, live, schema, 1), st.read_log(spark, old, schema, 1), "key", "ts", wait="15 seconds")
    sent = [r for batch in run(stream(), tmp_path, "append") for r in batch]
    write(spark, live, [("a", s(5), "live"), ("a", s(6), "live"), ("a", s(5), "twice")], schema)
    write(spark, old, [("a", s(4), "file"), ("a", s(6), "file"), ("c", s(3), "file"), ("c", s(2), "file")], schema)
    sent += [r for batch in run(stream(), tmp_path, "append") for r in batch]
    time.sleep(16)
    write(spark, live, [("d", s(1), "live")], schema)
    sent += [r for batch in run(stream(), tmp_path, "append") for r in batch]
    places = [(r[0], r[1]) for r in sent]
    assert len(places) == len(set(places))
    want = st.with_backfill(*(spark.read.schema(schema).parquet(p) for p in (live, old)))
    assert set(places) == {(r.key, r.ts) for r in want.collect()} and {(r[0], r[1]): r[2] for r in sent}["a", s(4)] == "file"


def test_backfill(spark):
    s = lambda rows: spark.createDataFrame(rows, "key string, ts int, v string")
    got = st.with_backfill(s([("a", 5, "live"), ("a", 6, "live")]), s([("a", 4, "file"), ("a", 5, "file"), ("b", 9, "file")]))
    assert sorted(map(tuple, got.collect())) == [("a", 4, "file"), ("a", 5, "live"), ("a", 6, "live"), ("b", 9, "file")]


def test_liveness(spark):
    df = spark.createDataFrame([(T0,), (T0 - timedelta(minutes=5),)], "Updated timestamp_ntz")
    assert [r.IsOnline for r in st.alive(df, "2024-01-01 00:00:10").collect()] == [True, False]


def test_every_sink_gets_every_batch(spark, tmp_path):
    log, schema = str(tmp_path / "log"), "key string, ts timestamp, ok boolean, id long"
    for k in range(3):
        write(spark, log, [("a", T0, True, k)], schema)
    one, two = [], []
    stream = st.read_log(spark, log, schema, 1)
    query = st.fan_out(stream, str(tmp_path / "c"), lambda batch, n: one.append((n, [r.id for r in batch.collect()])), lambda batch, n: two.append((n, batch.count())))
    query.awaitTermination(120)
    assert [n for n, _ in one] == [0, 1, 2] and sorted(i for _, ids in one for i in ids) == [0, 1, 2] and two == [(0, 1), (1, 1), (2, 1)]
    write(spark, log, [("a", T0, True, 9)], schema)
    query = st.fan_out(stream, str(tmp_path / "c"), lambda batch, n: one.append((n, [r.id for r in batch.collect()])), every="400 milliseconds")
    query.processAllAvailable()
    query.stop()
    assert one[-1] == (3, [9])  # goes on where it stopped


class Counted:
    """A state of the kinds that Backfill uses, which counts calls."""

    def __init__(self):
        self.values, self.calls = [], 0

    def __getattr__(self, name):
        def call(*args):
            self.calls += 1
            if name == "exists":
                return bool(self.values)
            if name == "get":
                return self.values[0] if self.single else iter(list(self.values))
            self.values = [] if name == "clear" else [args[0]] if name == "update" else self.values + args[0]

        return call


def test_backfill_calls_its_state_a_few_times_however_many_rows_come():
    whole, states = keyed.Backfill("ts", ["key", "ts"], "key string, ts timestamp_ntz", "1 minute", "1 hour"), {}

    class Handle:
        def made(self, name, single):
            states[name] = Counted()
            states[name].single = single
            return states[name]

        getValueState = lambda self, name, *a: self.made(name, True)
        getListState = getMapState = lambda self, name, *a: self.made(name, False)
        registerTimer = deleteTimer = lambda self, at: None

    class Clock:
        getCurrentProcessingTimeInMs = lambda self: 0

    whole.init(Handle())
    at = lambda n: datetime(2024, 1, 1) + timedelta(seconds=n)
    rows = lambda live, *ns: [Row(key="a", ts=at(n), _live=live) for n in ns]
    sent = lambda rows: [r.ts for r in whole.handleInputRows(("a",), iter(rows), Clock())]
    assert sent(rows(False, *range(1000))) == []
    assert sorted(sent(rows(True, *range(600, 1500), 700) + rows(False, 3, 900))) == [at(n) for n in range(1500)]
    assert sent(rows(True, 700, 2000) + rows(False, 5, 1999)) == [at(2000)]
    assert sum(s.calls for s in states.values()) < 40
