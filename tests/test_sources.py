from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tidewatch.functions import protobuf
from tidewatch.operators import events, logs, metrics
from tidewatch.sources import catalog, config, tables
from tidewatch.sources.reporter import Reporter

T0 = datetime(2024, 1, 1)


def test_json_with_comments(tmp_path, spark):
    (tmp_path / "load.json").write_text('{ // services\n "services": [ {"name": "a//b", "publishes": ["x",],}, /* no */ {"name": "c"} ], }')
    rows = config.hints(spark, str(tmp_path), "Load").orderBy("idx").collect()
    assert [(r.name, r.publishes) for r in rows] == [("a//b", ["x"]), ("c", [])]
    assert config.hints(spark, str(tmp_path), "none") is None and config.load(str(tmp_path / "none"), 3) == 3


def test_environment(tmp_path):
    (tmp_path / "dev1.json").write_text('{"KAFKA": {"Servers": "a:1", "other": 2}, /* none */ "sql": 3}')
    defaults = {"Kafka": {"servers": "", "cap": 2000}, "Sql": {"schema": "dbo"}}
    assert config.environment(str(tmp_path), "DEV1", defaults) == {"Kafka": {"servers": "a:1", "cap": 2000}, "Sql": {"schema": "dbo"}}
    assert config.environment(str(tmp_path), "none", defaults) == defaults


def test_jobs(spark):
    jobs = spark.createDataFrame([("Load", "full", "A", ["nightly"]), ("Sync", None, "B", None)], "name string, description string, category string, tags array<string>")
    names = lambda d: [r.name for r in d.collect()]
    assert names(config.matching_jobs(jobs, text="NIGHT")) == ["Load"] and names(config.matching_jobs(jobs, "b")) == ["Sync"]
    assert [r.category for r in config.categories(jobs).collect()] == ["A", "B"]


def test_reporter(spark, tmp_path):
    r, path = Reporter("run", "svc", pipeline="p"), str(tmp_path / "log")
    r.event("Connect")
    with r.span("chunk", records=4):
        pass
    with pytest.raises(ValueError), r.span("bad"):
        raise ValueError("broken")
    r.flush(spark, path)
    r.flush(spark, path)
    log = spark.read.parquet(path)
    assert log.count() == 3 and log.where("Status = 'Failed' AND Error = 'broken'").count() == 1
    assert sorted(e.Name for e in events.bridge(log).collect()) == ["bad", "chunk"]


def test_catalog(spark, tmp_path):
    spark.range(10).coalesce(1).write.parquet(str(tmp_path / "One.parquet"))
    spark.range(5).coalesce(1).write.parquet(str(tmp_path / "two.parquet"))
    tables = catalog.parquet_tables(spark, str(tmp_path))
    assert {(r.name, r.files) for r in tables.collect()} == {("One", 1), ("two", 1)}
    assert [r.name for r in catalog.page_of_tables(tables, "O", 2, 1).collect()] == ["two"]
    stats = {r.name: (r.files, r.rows, r.row_bytes == r.bytes // r.rows) for r in catalog.table_stats(spark, str(tmp_path), ["One", "two"]).collect()}
    assert stats == {"One": (1, 10, True), "two": (1, 5, True)}
    columns = catalog.column_stats(spark.createDataFrame([(1, None), (2, "x"), (2, None)], "a int, `b c` string"))
    assert sorted(map(tuple, columns.collect())) == [("a", "int", 0, 2), ("b c", "string", 2, 1)]


def test_kept_statistics_are_those_of_the_whole_table(spark, tmp_path):
    path, store = str(tmp_path / "t"), tables.EventLog(spark, str(tmp_path / "store"), catalog.SKETCHES)
    make = lambda low, high: spark.range(low, high, 1, 1).select("id", (F.col("id") % 7).cast("string").alias("b c"), F.when(F.col("id") % 5 != 0, F.col("id") / 2).alias("x"), F.array("id").alias("a"))
    make(0, 3000).write.parquet(path)
    assert catalog.refresh(spark, path, store) == 1 and catalog.refresh(spark, path, store) == 0
    make(2000, 6000).write.mode("append").parquet(path)
    assert catalog.refresh(spark, path, store) == 1
    got = {r.column: r for r in catalog.kept_stats(spark, path, store).collect()}
    assert {c: (r.kind, r.rows, r.nulls) for c, r in got.items()} == {"id": ("bigint", 7000, 0), "b c": ("string", 7000, 0), "x": ("double", 7000, 1400), "a": ("array<bigint>", 7000, 0)}
    assert abs(got["id"].distinct - 6000) < 180 and got["b c"].distinct == 7 and abs(got["x"].distinct - 4800) < 150 and abs(got["a"].distinct - 6000) < 180
    assert abs(got["id"].median - 2857) < 120 and got["b c"].median is None and got["x"].median is not None
    make(0, 10).write.mode("overwrite").parquet(path)
    assert catalog.refresh(spark, path, store) == 1 and {r.column: r.rows for r in catalog.kept_stats(spark, path, store).collect()}["id"] == 10


def test_decoding_rules(spark):
    df = spark.createDataFrame([("orders.a", bytearray(b"123")), ("other", bytearray(b"1"))], "Topic string, Value binary")
    rules = [("orders.%", [F.lit(None).cast("string"), F.lit("second")]), ("%", [F.lit(None).cast("string")])]
    assert [r.Json for r in protobuf.by_topic(df, rules).collect()] == ["second", '{"type":"unknown","sizeBytes":1}']


def test_search_and_detection(spark):
    df = spark.createDataFrame([("a|b|An Error.", 0), ("c|d|fine", 1)], "line string, line_no int")
    assert [r.highlighted for r in logs.search(df, "line", "error.").collect()] == ["a|b|An «Error.»"]
    assert logs.search(df, "line", "^[ac]", regex=True).count() == 2 and logs.search(df, "line", "error", case_sensitive=True).count() == 0
    t = [logs.template("{level} {message}"), logs.template("{level}|{host}|{message}"), logs.template("{level}|{message}")]
    assert logs.detect(df, t) == 1 and logs.detect(df, t[:1]) == 0 and logs.detect(df, [logs.template("<{level}> {message}")]) is None
    assert logs.detect(df, t, chars=14) == 1 and logs.detect(df.where("line_no = 0"), t) == 1  # one line that fits is better than none
    far = spark.createDataFrame([("x" * 9999, 0), ("a|b", 1), ("a|b", 2)], "line string, line_no int")
    assert logs.detect(far, t) is None and logs.detect(far, t, chars=20_000) == 2


def test_newest_file(spark):
    files = spark.createDataFrame([("/l/svc-20240101.log", T0), ("/l/svc-20240101-2.log", datetime(2024, 1, 2)), ("/l/old.log", datetime(2025, 1, 1))], "FullPath string, ModifiedUtc timestamp_ntz")
    path = logs.log_path("/L/{service}-{date}*.log", "svc", "h", 1, "e", date(2024, 1, 1))
    patterns = spark.createDataFrame([("k", 0, "/l/none*"), ("k", 1, path), ("k", 2, "/l/old*")], "key string, idx int, pattern string")
    assert logs.newest_file(files, patterns).first().FullPath == "/l/svc-20240101-2.log"


def test_samples_and_brokers(spark):
    beats = spark.createDataFrame([("H", "Svc", "1", 7)], "HostName string, ServiceName string, ServiceInstanceId string, ProcessId int")
    m = spark.createDataFrame([("h", "svc", "1", 5), ("h", "x", "1", 6)], "host string, service string, instance string, v int")
    assert [(r.v, r.ProcessId) for r in metrics.matched_samples(m, beats).collect()] == [(5, 7)]
    checks = spark.createDataFrame([("k", i, i, n, 3) for i, n in enumerate([3, 2, 0, 0, 0, 3])], "key string, ts int, id int, online int, total int")
    assert [r.status for r in metrics.broker_health(checks).orderBy("id").collect()] == ["Healthy", "Degraded", "Degraded", "DegradedEscalating", "Down", "Healthy"]
    assert spark.createDataFrame([('{"Ab": "7"}',)], "d string").select(metrics.payload_value(F.col("d"), "aB", "int")).first()[0] == 7


def test_scan(spark):
    log = spark.createDataFrame([("r", "1", None, "c", T0, None, None), ("r", "2", "n", "c", datetime(2023, 1, 1), None, 4)], "RunId string, Id string, Name string, ChunkId string, Start timestamp_ntz, Finish timestamp_ntz, RecordCount int").withColumn("Error", F.lit(None).cast("string"))
    assert [(r.Name, r.Service, r.RecordCount) for r in events.run_events_scan(log, "r", T0).collect()] == [("c", "", 0)]
