import json
import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidewatch.filters.predicates import Term, TimeOfDay, column
from tidewatch.functions import jsonpath, text
from tidewatch.operators import events, graph, logs, metrics, runs, timeline, topics, topology
from tidewatch.plans import lineage

T0 = datetime(2024, 1, 1)


def test_cursor_and_lag(spark):
    log = spark.createDataFrame([(i, T0 + timedelta(seconds=i)) for i in range(10)], "LogId long, LoggedAtUtc timestamp_ntz")
    batch = events.since(log, events.Cursor(3), T0 + timedelta(seconds=10), timedelta(seconds=4))
    assert sorted(r.LogId for r in batch.collect()) == [4, 5]
    assert events.advance(batch, events.Cursor(3)) == events.Cursor(5)
    assert events.advance(batch.limit(0), events.Cursor(3)) == events.Cursor(3)


def test_sources_merge_and_log_rows(spark, tmp_path):
    a = spark.createDataFrame([("1", T0, None, 1, ""), ("2", T0, T0, 1, "e")], "Id string, Start timestamp_ntz, Finish timestamp_ntz, RecordCount int, Error string")
    b = spark.createDataFrame([("1", T0 + timedelta(1), T0, 2)], "Id string, Start timestamp_ntz, Finish timestamp_ntz, RecordCount int")
    merged = events.merge_sources(a, b)
    assert sorted((r.Id, r.RecordCount) for r in merged.collect()) == [("1", 2), ("2", 1)]
    events.append(a, str(tmp_path / "log"))
    events.append(b.withColumn("Error", F.lit("")), str(tmp_path / "log"))
    back = spark.read.parquet(str(tmp_path / "log"))
    assert back.count() == 3 and back.where("Error = ''").count() == 0


def test_empty_topology(spark):
    none = spark.createDataFrame([], "Id string, Name string, Service string, Pipeline string, Server string, ProcessId int, Start timestamp_ntz, Finish timestamp_ntz, Error string, RecordCount int")
    assert topology.edges(none).count() == topology.pipeline_rows(none).count() == 0
    row = topology.summary(none).first()
    assert (row.chunks, row.events, row.progress) == (0, 0, 0.0)


def test_first_fit_rows(spark):
    rng = random.Random(1)
    rows = []
    for i in range(300):
        a = T0 + timedelta(milliseconds=rng.randrange(200_000))
        rows.append((f"{i:03}", "s" if i % 3 else "t", "p", a, a + timedelta(milliseconds=rng.randrange(3000)) if i % 10 else None))
    df = spark.createDataFrame(rows, "Id string, Service string, Pipeline string, Start timestamp_ntz, Finish timestamp_ntz")
    want, count = {}, {}
    for s in ("s", "t"):
        free = []
        for i, _, _, a, b in sorted((r for r in rows if r[1] == s), key=lambda r: (r[3], r[0])):
            at = next((k for k, end in enumerate(free) if end <= a), len(free))
            free[at : at + 1] = [b or a + timedelta(milliseconds=5000)]
            want[i] = at
        count[f"{s}/p"] = len(free)
    for slice_ms in (700, 20_000, 3_600_000):
        assert {r.Id: r.sub_row for r in timeline.sub_rows(df, slice_ms=slice_ms).collect()} == want
        assert {r.lane: r.sub_rows for r in timeline.sub_row_counts(df, slice_ms=slice_ms).collect()} == count


def test_durations_filter_by_time_of_day(spark):
    df = spark.createDataFrame([("a", T0, T0 + timedelta(seconds=61)), ("b", T0, T0 + timedelta(seconds=59, milliseconds=7)), ("c", T0, None)], "Id string, Start timestamp_ntz, Finish timestamp_ntz")
    rich = timeline.enriched(df, "2024-05-05 17:00:00")
    assert [(r.Id, r.FinishUtc, r.Duration) for r in rich.orderBy("Id").collect()] == [("a", "2024-01-01T00:01:01.000Z", datetime(2024, 5, 5, 0, 1, 1)), ("b", "2024-01-01T00:00:59.007Z", datetime(2024, 5, 5, 0, 0, 59, 7000)), ("c", None, None)]
    assert [r.Id for r in rich.where(column(Term("duration", "gt", TimeOfDay(60)), rich.schema)).collect()] == ["a"]


def test_blueprint(spark):
    s = lambda rows, schema: spark.createDataFrame(rows, schema)
    hints = s([(0, "load?er", "source", "g", ["Raw"], []), (1, "SVC-*", "", "h", ["x"], ["raw"]), (2, "Archiver", "sink", "o", [], ["X"]), (3, "archiver", "", "p", [], [])], "idx int, name string, role string, grp string, publishes array<string>, subscribes array<string>")
    explicit = s([("svc-1", "archiver", 0), ("SVC-1", "Archiver", 1), ("a_b", " ", 2), ("svc-2", "svc-*", 3)], "source string, target string, idx int")
    declared = topology.declared_edges(hints, explicit)
    assert sorted(tuple(r) for r in declared.collect()) == [("SVC-*", "Archiver"), ("load?er", "SVC-*"), ("svc-1", "archiver"), ("svc-2", "svc-*")]
    observed = s([("loadXer",), ("loader",), ("load%er",), ("svc-1-dev",), ("svc-2",)], "id string")
    label = lambda c: F.regexp_replace(c, "-dev$", "")
    nodes = topology.blueprint_nodes(observed, hints, label)
    got = {r.id: (r.is_declared, r.is_observed, r.grp) for r in nodes.collect()}
    assert got == {"loadXer": (True, True, "g"), "loader": (False, True, None), "load%er": (True, True, "g"), "svc-1-dev": (True, True, "h"), "svc-2": (True, True, "h"), "Archiver": (True, False, "o")}
    seen = s([("svc-1-dev", "p", "svc-2", "q"), ("svc-2", "q", "svc-1-dev", "p"), ("loader", "p", "svc-2", "q")], "source string, source_pipeline string, target string, target_pipeline string")
    edges = {(r.source, r.source_pipeline, r.target): (r.is_declared, r.is_observed) for r in topology.blueprint_edges(seen, nodes.select("id"), declared, label).collect()}
    assert edges == {
        ("svc-1-dev", "p", "svc-2"): (False, True),
        ("svc-2", "q", "svc-1-dev"): (True, True),
        ("loader", "p", "svc-2"): (False, True),
        **{(a, "", b): (True, False) for a in ("loadXer", "load%er") for b in ("svc-1-dev", "svc-2")},
        **{(a, "", "Archiver"): (True, False) for a in ("svc-1-dev", "svc-2")},
    }
    variants = s([(0, " "), (1, "load_er"), (2, "SVC-?"), (3, "*")], "idx int, any_service string")
    assert topology.variant(observed, variants).first().variant == 2 and topology.variant(observed, variants.where("idx < 2")).first().variant is None


def test_metrics_lines(spark):
    line = lambda *said: "2024-01-01 00:00:01|INFO|current usage: 7|1|2|" + "".join(said) + "|c"
    mark = "Sending Metrics Tracker message "
    rows = [(1, line(mark, "current usage:  10 byte, child peak usage:4")), (2, line(mark, "peak usage: 3")), (3, line(mark, "current usage: 99999999999999999999")), (4, line("current usage: 1")), (5, mark + "current usage: 1")]
    got = metrics.parse_metrics_lines(spark.createDataFrame(rows, "id int, line string")).collect()
    assert [tuple(r)[2:] for r in got] == [(10, 0, 0, 4)] and got[0].id == 1 and got[0].ts == datetime(2024, 1, 1, 0, 0, 1)


def test_fields_are_trimmed(spark):
    rows = [("2024-01-01 00:00:01 | ERROR | h | 5 | x | what happened |  me ",), ("[WARN ] < h2> 12",)]
    df = spark.createDataFrame(rows, "line string").withColumn("continuation", F.lit("more"))
    got = logs.parse(df, [logs.template("[{level}] <{host}>{*}{pid}"), logs.template("[{level}] <{host}> {pid}")]).collect()
    assert (got[0].level, got[0].host, got[0].pid, got[0].thread, got[0].message, got[0].caller) == ("ERROR", "h", 5, 0, "what happened\nmore", "me")
    assert (got[1].level, got[1].host, got[1].message) == ("WARN", "h2", "\nmore") and got[0].timestamp == datetime(2024, 1, 1, 0, 0, 1)


def test_files_of_several_formats(spark):
    text = "lost\r\n[INFO] a: one\nmore\n\nand more\n2024|7|h|two\n[WARN] b: three\n--\ncode 9 here\ntail"
    formats = [logs.template("[{level}] {host}: {message}{newline}--{newline}code {pid} {*}"), logs.template("{timestamp}|{pid}|{host}|{message}"), logs.template("[{level}] {host}: {message}")]
    files = spark.createDataFrame([("f", text), ("g", None), ("h", "nothing fits")], "file string, text string")
    got = [(r.line_index, r.level, r.host, r.pid, r.message, r.continuations, r.n_lines, r.plain) for r in logs.parse_files(files, formats).orderBy("entry").collect()]
    assert got == [(1, "INFO", "a", 0, "one", ["more", "and more"], 3, False), (5, "", "h", 7, "two", [], 1, False), (6, "WARN", "b", 9, "three", ["tail"], 4, False)]
    plain = logs.parse_files(files.where("file = 'f'")).orderBy("entry").collect()
    assert [r.message for r in plain] == text.replace("\r", "").split("\n") and all(r.plain for r in plain)


def test_sorts_and_caps(spark):
    t = spark.createDataFrame([("b", 1, 9), ("A", 3, 9), ("c", 2, 1)], "Topic string, partitions long, messages long")
    names = lambda d: [r.Topic for r in d.collect()]
    assert names(topics.sorted_topics(t)) == ["A", "b", "c"] and names(topics.sorted_topics(t, "PartitionCount", True)) == ["A", "c", "b"] and names(topics.sorted_topics(t, "MessageCount")) == ["c", "A", "b"]
    f = spark.createDataFrame([(f"p{i}", f"f{i % 3}", "h", i, T0, T0 + timedelta(days=i)) for i in range(6)], "FullPath string, FileName string, Server string, SizeBytes long, CreatedUtc timestamp_ntz, ModifiedUtc timestamp_ntz")
    paths = lambda d: [r.FullPath for r in d.collect()]
    assert paths(logs.sorted_files(f, most=2)) == ["p5", "p4"] and paths(logs.sorted_files(f, "file", False)) == ["p0", "p3", "p1", "p4", "p2", "p5"]
    found = f.where("SizeBytes > 1").select(F.col("FullPath").alias("file"))
    assert [(r.FullPath, r.capped) for r in logs.found_files(f, found, 2).collect()] == [("p2", True), ("p3", True)] and {r.capped for r in logs.found_files(f, found, 4).collect()} == {False}


def test_document_times_by_kind(spark):
    df = spark.createDataFrame([("2020", T0, None), ("x", None, T0)], "timestamp string, createdAt timestamp_ntz, updatedAt timestamp_ntz")
    assert [r.at for r in df.select(runs.document_time(df).alias("at")).collect()] == [T0, T0]
    assert df.select(runs.document_time(df.select("timestamp")).alias("at")).first().at is None


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("r", "1", 'a "b", c', "s", "p", "h", 1, T0, None, None, 3)], "RunId string, Id string, Name string, Service string, Pipeline string, Server string, ProcessId int, Start timestamp_ntz, Finish timestamp_ntz, Error string, RecordCount int")
    timeline.write_csv(df, str(tmp_path / "csv"))
    assert timeline.read_csv(spark, str(tmp_path / "csv"), "2024-02-02").collect() == df.collect()


def test_json_paths(spark):
    doc = '{"store":{"book":[{"title":"A","price":8.95},{"title":"B","price":12.99}]}}'
    df = spark.createDataFrame([(doc,), ("no json",), (None,)], "d string")
    one = lambda p: [tuple(r.q) for r in df.select(jsonpath.query(F.col("d"), p).alias("q")).collect()][:2]
    assert one("$.store.book[?(@.price < 10)].title")[0] == (True, '["A"]', 1)
    assert one("$.store.book[*].title") == [(True, '["A","B"]', 2), (False, None, None)]
    assert one("$.store.book[1].title")[0] == (True, '["B"]', 1)
    assert one("$.nothing")[0] == (True, "[]", 0)
    for bad in ("", "store", "$.a..b", "$[?(1)]"):
        with pytest.raises(ValueError):
            jsonpath.query(F.col("d"), bad)


def test_templates(spark):
    df = spark.createDataFrame([("2024-01-01 00:00:01 [WARN] h1 a b (c)",), ("junk",)], "line string")
    t = logs.template("{timestamp} [{level}] {host} {message} ({caller})")
    assert t is None or t.fields[1] == "level"
    t = logs.template("{message}|{caller}")
    assert t.fields == ("message", "caller") and logs.template("{message}") is None and logs.template("none") is None
    t = logs.template("{level}{message}")
    row = df.select(logs.captured(F.col("line"), t, "level").alias("l"), logs.captured(F.col("line"), t, "message").alias("m")).first()
    assert row.l == "" and row.m.startswith("2024")


def test_log_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.log").write_text("lost\r\n2024-01-01 00:00:01|INFO|h|1|2|first|c\r\nmore\n2024-01-01 00:00:02|WARN|h|x|2|second|c\n")
    (tmp_path / "y.txt").write_text("2024-01-01 00:00:01|INFO|h|1|2|other|c\n")
    found = logs.entries(logs.read_lines(spark, str(tmp_path), "*.log"))
    rows = sorted((r.entry_no, r.level, r.pid, r.message, r.continuation) for r in logs.parse(found).collect())
    assert rows == [(1, "INFO", 1, "first\nmore", "more"), (2, "WARN", 0, "second", "")]
    assert sorted(r.FileName for r in logs.file_table(spark, str(tmp_path)).collect()) == ["x.log", "y.txt"]


def test_entries_over_slices(spark):
    rng = random.Random(2)
    rows = [(f, i * 3, "2024-01-01 00:00:01 x" if rng.random() < 0.3 else f"more {i}") for f in "ab" for i in range(80)]
    lines = spark.createDataFrame(rows, "file string, line_no long, line string").repartition(3)
    whole = sorted(map(tuple, logs.entries(lines).collect()))
    assert sorted(map(tuple, logs.entries(lines, 7).collect())) == whole == sorted(map(tuple, logs.entries(lines, 100).collect())) and len(whole) > 20
    for f in "ab":
        texts = [line for g, _, line in rows if g == f]
        first = next(i for i, t in enumerate(texts) if t.startswith("2024"))
        assert [t for r in whole if r[0] == f for t in [r[2], *r[3].split("\n")] if t] == texts[first:]


def test_folders(spark):
    paths = spark.createDataFrame([("a",), ("a/b",), ("a/b/log",), ("c",)], "path string")
    assert {r.path for r in logs.kept_folders(paths, F.contains("path", F.lit("log"))).collect()} == {"a", "a/b", "a/b/log"}
    some = lambda s, n: spark.createDataFrame([(s, x) for x in n], "server string, name string")
    assert [r.name for r in logs.merge_folders(some("1", ["B", "a"]), some("2", ["b", "c"])).collect()] == ["a", "B", "c"]


def test_text(spark):
    df = spark.createDataFrame([("dev1-Loader__svc-", 3725, 1500.0)], "a string, s int, m double")
    row = df.select(text.strip_label(F.col("a"), ["{ENVID}", "svc"], "dev1").alias("l"), text.strip_label(F.lit("svc"), ["SVC"]).alias("k"), text.clock(F.col("s")).alias("c"), text.memory(F.col("m")).alias("m"), text.topic_name(F.lit(" ")).alias("t"), text.palette_index(F.lit("hello"), 12).alias("p")).first()
    h = 0
    for c in "hello":
        h = (h * 31 + ord(c) + 2**31) % 2**32 - 2**31
    assert tuple(row) == ("Loader", "svc", "1:02:05", "1.5 GB", "", abs(h) % 12)
    order = spark.createDataFrame([("a10",), ("a2",), ("A1",)], "n string").orderBy(text.natural_key(F.col("n")))
    assert [r.n for r in order.collect()] == ["A1", "a2", "a10"]
    long = spark.createDataFrame([("x" + "9" * 25,), ("x1" + "0" * 25,), ("x007",)], "n string").orderBy(text.natural_key(F.col("n")))
    assert [len(r.n) for r in long.collect()] == [4, 26, 27]
    assert text.fill("{A}-{b}", {"a": "1"}) == "1-{b}"
    assert json.loads(text.typed_body({"a": "1", "b": "2.5", "c": "x, y", "d": "no"}, {"a": "boolean", "b": "number", "c": "multiselect", "d": "number"})) == {"a": True, "b": 2.5, "c": ["x", "y"], "d": "no"}
    h = 0
    for unit in (0x68, 0xD83D, 0xDE00, 0xE9):
        h = (h * 31 + unit + 2**31) % 2**32 - 2**31
    assert df.select(text.palette_index(F.lit("h😀é"), 12).alias("p"), text.palette_index(F.lit(""), 12).alias("e")).first()[:] == (abs(h) % 12, 0)


def test_layers_and_closure(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("c", "b"), ("d", "d"), ("d", "c")], "source string, target string")
    forward = graph.forward_edges(e)
    layered = graph.layers(forward)
    assert {r.node: r.layer for r in layered.collect()} == {"a": 0, "d": 0, "b": 1, "c": 2}
    assert [tuple(r) for r in graph.long_edge_stops(forward.where("source != 'd'"), layered).collect()] == [("a", "c", 1)]
    assert graph.closure(e.where("source != 'd'")).count() == 6
    roles = spark.createDataFrame([("d", "sink"), ("c", "sink"), ("a", "source")], "node string, role string")
    assert {r.node: r.layer for r in graph.pinned(layered, roles, forward).collect()} == {"a": 0, "d": 0, "b": 1, "c": 2}
    assert {r.node: r.layer for r in graph.layers(e.where("source != 'd'")).collect()} == {"a": 0, "b": 1, "c": 1}


def test_tables_are_stored_in_the_checkpoint_folder(spark):
    df = lineage.stored(spark.createDataFrame([(1, "a", None)], "a int, b string, c timestamp_ntz"))
    assert [tuple(r) for r in df.collect()] == [(1, "a", None)] and df.schema.simpleString() == "struct<a:int,b:string,c:timestamp_ntz>"
    assert all(lineage.folder(spark).split("/")[-1] in f for f in df.inputFiles())
    exists = lambda path: os.path.exists(path.removeprefix("file:"))
    before = list(lineage.FOLDERS)
    with lineage.scratch(spark):
        inner = lineage.stored(spark.range(3))
        assert inner.count() == 3 and exists(lineage.FOLDERS[-1])
        path = lineage.FOLDERS[-1]
    assert not exists(path) and lineage.FOLDERS == before and exists(before[-1])
    lineage.clear(spark)
    assert not exists(before[-1]) and lineage.FOLDERS == []


def test_pages_and_codes(spark):
    assert [runs.page_count(n, 10) for n in (0, 10, 11)] == [1, 1, 2]
    df = spark.createDataFrame([(" f ",), ("x",), (None,)], "c string")
    assert [r.s for r in df.select(runs.status_name(F.col("c")).alias("s")).collect()] == ["Failed", "Unknown", "Unknown"]


def test_interpolation_ends(spark):
    p = spark.createDataFrame([("a", 0, 0.0), ("a", 7_200_000, 2.0), ("b", 3_600_000, 5.0)], "series string, ts long, value double")
    got = {(r.series, r.ts // 3_600_000): r.value for r in metrics.interpolated(p).collect()}
    assert got == {("a", 0): 0.0, ("a", 1): 1.0, ("a", 2): 2.0, ("b", 0): 5.0, ("b", 1): 5.0, ("b", 2): 5.0}


def test_point_fetch(spark):
    m = spark.createDataFrame([("t", 0, 5, T0, "k", "{}"), ("t", 1, 5, T0, "k", "{}")], "Topic string, Part int, Off long, Ts timestamp_ntz, Key string, Payload string")
    assert topics.fetch(m, "t", 1, 5).count() == 1


def test_pieces_of_a_file_are_the_whole_file(spark):
    """Pieces that begin with continuations, have nothing else, or come before any entry; and files that have none."""
    rng = random.Random(3)
    made = lambda n: [rng.choice(["a|INFO|m", "b|WARN|x|y", "  at", "", "more", "   "]) for _ in range(n)]
    texts = {f"f{k}": [*(["head", ""] if k % 2 else []), *made(40), *["  at"] * 9, *made(5)] for k in range(4)} | {"none": ["x", "y", "z"]}
    formats = [logs.template("{timestamp}|{level}|{message}")]
    whole = spark.createDataFrame([(f, "\n".join(t)) for f, t in texts.items()], "file string, text string")
    fields = ("file", "entry", "timestamp", "level", "message", "continuations", "n_lines")
    want = sorted(map(str, logs.parse_files(whole, formats).select(*fields).collect()))
    for size in (1, 4, 7):
        cut = [(f, k // size, "\n".join(t[k : k + size])) for f, t in texts.items() for k in range(0, len(t), size)]
        pieces = spark.createDataFrame(cut, "file string, piece long, text string")
        assert sorted(map(str, logs.parse_files(pieces, formats).select(*fields).collect())) == want
    with pytest.raises(ValueError):
        logs.parse_files(pieces, [logs.template("{level}{newline}{message}")])


def test_more_events_are_more_tasks_of_bitmaps_not_larger_ones(spark):
    assert [topology.chunk_buckets(n) for n in (0, 800_000, 36_000_000, 216_000_000)] == [8, 8, 360, 2160]
    rows = spark.range(4000).select((F.col("id") % 700).cast("string").alias("Name"), (F.col("id") % 3).cast("string").alias("Service"), F.lit("p").alias("Pipeline"), F.when(F.col("id") % 2 == 0, F.lit(T0)).alias("Finish"))
    for buckets, tasks in ((8, 8), (160, 40)):
        bits = topology.chunk_bitmaps(rows, buckets)
        assert "RepartitionByExpression [bucket" in (plan := bits._jdf.queryExecution().optimizedPlan().toString()) and f", {tasks}" in plan.split("RepartitionByExpression", 1)[1].split("\n", 1)[0]
        seen = bits.groupBy("Service").agg(F.sum(F.bitmap_count("seen")).alias("n"), F.sum(F.bitmap_count("done")).alias("d"))
        want = rows.groupBy("Service").agg(F.countDistinct("Name").alias("n"), F.countDistinct(F.when(F.col("Finish").isNotNull(), F.col("Name"))).alias("d"))
        assert sorted(map(tuple, seen.collect())) == sorted(map(tuple, want.collect()))
