import os
import random
from datetime import datetime, timedelta
from pathlib import Path

import duckdb
import pyarrow as pa
import pyarrow.dataset as ds
import pyarrow.parquet as pq
from pyspark.sql.types import StructType

from tidewatch.plans import further, lineage, queries
from tidewatch.sources import tail
from tidewatch.streaming import keyed

T0 = datetime(2024, 1, 1)
SCHEMA = "LogId long, LoggedAtUtc timestamp_ntz, v string"


def run(stream, checkpoint):
    got = []
    with keyed.no_empty_batches(stream.sparkSession):
        query = stream.writeStream.foreachBatch(lambda batch, _: got.extend(map(tuple, batch.collect()))).option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    return got


def test_late_commits_are_neither_lost_nor_doubled(spark, tmp_path):
    """Rows get ids in order but appear some seconds later, out of order; polls restart each time."""
    rng = random.Random(4)
    rows = [(i, T0 + timedelta(seconds=i // 3), T0 + timedelta(seconds=i // 3 + rng.choice([0, 1, 4]))) for i in range(1, 61)]
    log, got = str(tmp_path / "log"), []
    done = set()
    for now in range(0, 32, 4):
        as_of = T0 + timedelta(seconds=now)
        seen = [(i, at, f"v{i}") for i, at, visible in rows if visible <= as_of and i not in done]
        done |= {i for i, _, _ in seen}
        if seen:
            spark.createDataFrame(seen, SCHEMA).coalesce(1).write.mode("append").parquet(log)
        got += [r[0] for r in run(tail.log_stream(spark, log, SCHEMA, lag=5, ids=7, now=as_of.isoformat()), tmp_path / "c")]
    assert len(done) == 60 and got and sorted(got) == list(range(1, 61))


def test_without_lag_all_rows_come_at_once(spark, tmp_path):
    log = str(tmp_path / "log")
    spark.createDataFrame([(i, T0, None if i == 2 else "x") for i in range(1, 5)], SCHEMA).write.parquet(log)
    assert sorted(run(tail.log_stream(spark, log, SCHEMA), tmp_path / "c")) == [(1, T0, "x"), (2, T0, None), (3, T0, "x"), (4, T0, "x")]


def test_tail_gives_whole_lines_once(spark, tmp_path):
    folder = tmp_path / "logs"
    (folder / "deep").mkdir(parents=True)
    one, two = folder / "a.log", folder / "deep" / "b.log"
    stream = lambda: [(os.path.basename(f), place, line) for f, place, line in run(tail.line_stream(spark, str(folder), "*.log", "10"), tmp_path / "c")]
    one.write_bytes("eins\r\nzwei é\n\nhal".encode())
    (folder / "c.txt").write_text("no\n")
    assert sorted(stream()) == [("a.log", 0, "eins"), ("a.log", 6, "zwei é")]
    assert stream() == []
    with one.open("ab") as f:
        f.write(b"b ganz\nvier")
    two.write_text("x\n")
    assert sorted(stream()) == [("a.log", 15, "halb ganz"), ("b.log", 0, "x")]
    one.write_text("neu\n")  # cut
    assert stream() == [("a.log", 0, "neu")]
    two.unlink()
    with one.open("a") as f:
        f.write("mehr\n")
    assert stream() == [("a.log", 4, "mehr")]


def test_pieces_of_any_size_give_the_same_lines(tmp_path, monkeypatch):
    rng = random.Random(1)
    text = "".join(rng.choice(["", "ab", "é" * rng.randint(1, 30)]) + rng.choice(["\n", "\r\n"]) for _ in range(200)) + "end"
    path = tmp_path / "f.log"
    path.write_bytes(text.encode())
    want = [line.rstrip("\r") for line in text.split("\n") if line.rstrip("\r")]
    for step, piece in ((1 << 20, "64m"), (7, "1"), (3, "13"), (64, "1k")):
        monkeypatch.setattr(tail, "STEP", step)
        reader = tail.WholeFilesReader({"path": str(tmp_path), "piece": piece})
        got = [row for p in reader.partitions() for row in reader.read(p)]
        assert [r[2] for r in got] == want
        assert [r[1] for r in got] == sorted({r[1] for r in got})


def test_where_a_log_ends_is_told_by_footers(tmp_path, monkeypatch):
    schema = StructType().add("id", "long").add("at", "timestamp_ntz")
    for n, statistics in ((0, True), (1, True), (2, False)):
        ids = list(range(n * 10, n * 10 + 10))
        pq.write_table(pa.table({"id": pa.array(ids, pa.int64()), "at": pa.array([datetime(2024, 1, 1)] * 10, pa.timestamp("us"))}), tmp_path / f"{n}.parquet", write_statistics=statistics, row_group_size=4)
        reader = tail.LogTailReader({"path": str(tmp_path), "id": "id", "time": "at", "start": "-1"}, schema)
        if statistics:
            with monkeypatch.context() as m:
                m.setattr(tail.LogTailReader, "_log", lambda self: type("D", (), {"get_fragments": lambda _: ds.dataset(str(tmp_path), format="parquet").get_fragments()})())
                assert reader.latestOffset() == {"id": n * 10 + 9}  # no rows are read
        assert reader.latestOffset() == {"id": n * 10 + 9}
    (tmp_path / "none").mkdir()
    assert tail.LogTailReader({"path": str(tmp_path / "none"), "id": "id", "time": "at", "start": "-1"}, schema).latestOffset() == {"id": -1}


def test_files_are_written_whole_and_once(spark, tmp_path):
    rows = [(f"d{i % 3}/e{i % 2}/f{i}.txt", None if i == 5 else f"é{i}\n" * i) for i in range(40)]
    for folder in (str(tmp_path / "a"), f"file:{tmp_path}/b", f"file://{tmp_path}/c"):
        for _ in range(2):  # a task that is run again
            assert tail.write_files(spark.createDataFrame(rows, "path string, text string").repartition(4), folder) == 40
    for name in "abc":
        found = {str(p.relative_to(tmp_path / name)): p.read_bytes().decode() for p in (tmp_path / name).rglob("*") if p.is_file()}
        assert found == {path: text or "" for path, text in rows}
    assert tail.write_files(spark.createDataFrame([], "path string, text string"), str(tmp_path / "none")) == 0


def test_a_folder_of_logs_has_many_files_and_any_names(spark, tmp_path, monkeypatch):
    names = ["click", "a b/ü%2B+c", "..", "", "x=1&y", None]
    rows = [(i, T0 + timedelta(seconds=i), i % 7, names[i % 6] if i % 6 < 5 or i % 5 in (3, 4) else "click") for i in range(3000)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string").write.parquet(str(tmp_path / "events.parquet"))
    monkeypatch.setattr(further, "FOLDER_PARTS", 4)
    got = further.log_folder_read(spark, str(tmp_path))
    folder = lineage.FOLDERS[-1].removeprefix("file:")
    files, folders = ([p for p in Path(folder).rglob("*") if p.is_dir() == kind] for kind in (False, True))
    assert len(files) == 6 * 6 and len(folders) == 6 + 6 * 2  # files share folders
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
        want = db.execute(queries.ORACLE_SQL["log_folder_read"]).fetchall()
    assert sorted(map(str, map(tuple, got.select("file", "part", "line_no", "line").collect()))) == sorted(map(str, want)) and len(want) == 3000
