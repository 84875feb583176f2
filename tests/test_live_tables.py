import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import topology
from tidewatch.operators.events import upsert
from tidewatch.sources import tables
from tidewatch.streaming import events as st
from tidewatch.streaming import topology as live

T0 = datetime(2024, 1, 1)
SCHEMA = "Id string, Name string, Service string, Pipeline string, Start timestamp_ntz, Finish timestamp_ntz, Error string, n long"


def events(seed, n=150):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        start = T0 + timedelta(seconds=rng.randrange(60))
        finish = start + timedelta(seconds=rng.randrange(9)) if rng.random() < 0.7 else None
        rows.append((f"e{rng.randrange(n * 2 // 3)}", f"c{rng.randrange(9)}", f"s{rng.randrange(3)}", f"p{rng.randrange(2)}", start, finish, "E" if rng.random() < 0.05 else None, i))
    return [(*r[:1], f"c{int(r[0][1:]) % 9}", *r[2:]) for r in rows]  # an event stays in its chunk


def test_topology_of_a_stream_is_that_of_the_table(spark, tmp_path):
    rows = events(1)
    path, log = str(tmp_path / "in"), tables.EventLog(spark, str(tmp_path / "deltas"), live.DELTAS)
    for k in range(3):
        part = spark.createDataFrame(rows[k * 50 : k * 50 + 50], SCHEMA)
        part.coalesce(1).write.mode("append").parquet(path)
        stream = live.topology_deltas(st.read_log(spark, path, SCHEMA, 1), F.col("n"))
        query = st.fan_out(stream, str(tmp_path / "c"), lambda batch, n: log.append(batch, n))
        assert query.awaitTermination(120)
        want = topology.edges(upsert(spark.createDataFrame(rows[: k * 50 + 50], SCHEMA), arrival="n"))
        assert sorted(map(tuple, live.edges_of(log.read()).collect())) == sorted(map(tuple, want.collect()))
    packed = tables.EventLog(spark, str(tmp_path / "packed"), live.DELTAS)
    packed.append(live.summed(log.read()), 0)
    assert sorted(map(tuple, live.edges_of(packed.read()).collect())) == sorted(map(tuple, want.collect()))


def test_topology_of_batches_is_that_of_the_table(spark, tmp_path, monkeypatch):
    rows, whole = events(4), live.LiveTopology(spark, str(tmp_path / "t"), buckets=4)
    part = lambda k: spark.createDataFrame(rows[k * 50 : k * 50 + 50], SCHEMA)
    commit, log = tables.Table.commit, type(whole.log)
    for k in range(3):
        # the chunks' commit is lost after the log's: the batch runs again and is logged once
        monkeypatch.setattr(tables.Table, "commit", lambda self, *a: commit(self, *a) if isinstance(self, log) else (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            whole.take(part(k), F.col("n"), k)
        monkeypatch.setattr(tables.Table, "commit", commit)
        assert whole.take(part(k), F.col("n"), k) and not whole.take(part(k), F.col("n"), k)
        want = topology.edges(upsert(spark.createDataFrame(rows[: k * 50 + 50], SCHEMA), arrival="n"))
        assert sorted(map(tuple, live.edges_of(whole.log.read()).collect())) == sorted(map(tuple, want.collect()))
    few = spark.createDataFrame([("e0", "c0", "s0", "p0", T0, None, None, -1)], SCHEMA)  # older than what is there, so nothing changes
    before = whole.log.read().count()
    assert whole.take(few, F.col("n"), 3) and whole.log.read().count() == before
    whole.vacuum()
    assert whole.read().count() == 9


def test_differences_are_small():
    one = {"a": (1, 0, None, "s", "p", False), "c": (9, 0, 10, "t", "p", False)}
    two = one | {"b": (5, 0, None, "u", "p", False)}
    change = live.counts_of(two)
    change.subtract(live.counts_of(one))
    hops = {(k[1], k[3]): n for k, n in change.items() if k[0] == "hop" and n}
    assert hops == {("s", "t"): -1, ("s", "u"): 1, ("u", "t"): 1}


def test_a_batch_that_runs_twice_leaves_one_copy(spark, tmp_path, monkeypatch):
    log = tables.EventLog(spark, str(tmp_path / "log"), "id long, text string")
    batch = lambda *ids: spark.createDataFrame([(i, "" if i % 2 else "x") for i in ids], "id long, text string")
    assert log.append(batch(1, 2), 0) and not log.append(batch(1, 2), 0) and log.append(batch(3), 1)
    commit = tables.Table.commit
    monkeypatch.setattr(tables.Table, "commit", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        log.append(batch(4), 2)
    monkeypatch.setattr(tables.Table, "commit", commit)
    again = tables.EventLog(spark, str(tmp_path / "log"), "id long, text string")  # after a restart
    assert again.append(batch(4), 2) and again.append(batch(5), 0, "other")
    want = [(1, None), (2, "x"), (3, None), (4, "x"), (5, None)]
    assert sorted(map(tuple, again.read().collect())) == want
    again.pack()
    again.vacuum(1)
    assert sorted(map(tuple, log.read().collect())) == want and len(log.manifest()["parts"]) == 1 and not log.append(batch(4), 2)
    assert len(list((tmp_path / "log" / "data").iterdir())) == 0


def test_two_writers_do_not_commit_one_number(spark, tmp_path):
    log = tables.EventLog(spark, str(tmp_path / "log"), "id long")
    before = log.manifest()
    assert log.append(spark.range(1), 0, "a")
    with pytest.raises(RuntimeError):
        log.commit(before, {}, {"b": 0})
    assert log.read().count() == 1 and tables.EventLog(spark, str(tmp_path / "none"), "id long").read().count() == 0


def test_keyed_table_is_the_upsert(spark, tmp_path):
    rows = events(5, 90)
    for finished in (None, "Finish"):
        table = tables.KeyedTable(spark, str(tmp_path / f"t{finished}"), SCHEMA, "Id", "Start", "n", buckets=8, prefer_finished=finished)
        for k in range(3):
            part = spark.createDataFrame(rows[k * 30 : k * 30 + (30 if k < 2 else 2)], SCHEMA)
            assert table.upsert(part, k) and not table.upsert(part, k)
        parts = table.manifest()["parts"]
        assert len(set(p.split("/")[1] for p in parts.values())) > 1  # the last batch left most buckets as they were
        want = upsert(spark.createDataFrame(rows[:62], SCHEMA), arrival="n", prefer_finished=finished)
        table.vacuum()
        assert sorted(map(str, table.read().collect())) == sorted(map(str, want.collect()))
        assert table.upsert(spark.createDataFrame([], SCHEMA), 3) and table.read().count() == want.count()


def test_an_upsert_shuffles_its_rows_once(spark, tmp_path, monkeypatch):
    plans, kind = [], type(spark.range(1))
    write = kind.write
    monkeypatch.setattr(kind, "write", property(lambda self: (plans.append(self._jdf.queryExecution().executedPlan().toString()), write.fget(self))[1]))
    table = tables.KeyedTable(spark, str(tmp_path / "t"), SCHEMA, "Id", "Start", "n", buckets=8)
    for k in range(2):
        assert table.upsert(spark.createDataFrame(events(6, 60)[k * 30 : k * 30 + 30], SCHEMA), k)
    assert [p.count("Exchange ") for p in plans] == [1, 1]
