import random
import re
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import globs, graph, logs

ROOT = Path(__file__).resolve().parent.parent


def peeled(edges):
    """Layers by one queue."""
    nodes = {n for e in edges for n in e}
    layer, left = dict.fromkeys(nodes, 0), {n: sum(t == n for _, t in edges) for n in nodes}
    queue = [n for n in nodes if not left[n]]
    for n in queue:
        for s, t in edges:
            if s == n:
                layer[t] = max(layer[t], layer[n] + 1)
                left[t] -= 1
                if not left[t]:
                    queue.append(t)
    return layer


def test_layers_of_any_graph(spark):
    rng = random.Random(3)
    graphs = [
        {("a", "b"), ("b", "c"), ("c", "a")},
        {("s", "a"), ("a", "b"), ("b", "c"), ("c", "d"), ("d", "a"), ("c", "out"), ("s", "out"), ("x", "y")},
        {(f"n{rng.randrange(14)}", f"n{rng.randrange(14)}") for _ in range(22)},
        {(f"n{i}", f"n{i + 1}") for i in range(10)} | {("n3", "n8")},
    ]
    for edges in graphs:
        edges = {(s, t) for s, t in edges if s != t}
        df = spark.createDataFrame(sorted(edges) + sorted(edges)[:1], "source string, target string")
        assert {r.node: r.layer for r in graph.layers(df).collect()} == peeled(edges)
    assert graph.layers(spark.createDataFrame([], "source string, target string")).count() == 0


def fits(text, glob):
    body = "".join({"*": r"[^\n]*", "?": r"[^\n]"}.get(c, re.escape(c)) for c in glob)
    return re.fullmatch(body + r"\n?", text, re.I) is not None


def test_beginnings_that_are_no_globs_key_are_passed_over_before_the_shuffle(spark):
    """Texts whose beginnings are mostly no keys, a literal glob that all texts begin with, and one text that ends in a line feed."""
    rows = spark.range(2000).select(F.concat(F.lit("7"), F.col("id").cast("string"), F.lit("-x")).alias("id")).union(spark.createDataFrame([("K7\n",), ("",)], "id string"))
    many = spark.createDataFrame([("7",), ("k7",), ("75-*",), ("7?1-X",), ("*99-x",), ("",), ("71234",)], "pattern string")
    found = globs.glob_join(rows, F.col("id"), many, "pattern")
    got = sorted(map(tuple, found.collect()))
    ends = [("7" + n + "-x", "*99-x") for n in map(str, range(2000)) if ("7" + n).endswith("99")]
    assert got == sorted([("K7\n", "k7"), ("", ""), ("75-x", "75-*"), *ends, *(("7" + n + "-x", "7?1-X") for n in map(str, range(2000)) if len(n) == 2 and n[1] == "1")])
    keyed = globs.keyed_globs(many, "pattern")
    assert {r._key for r in keyed.where("_size IS NULL").collect()} == {"=7", "=k7", "=71234", "="}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "_bits" in plan and "_own" in plan


def test_glob_join_is_every_pattern_on_every_text(spark):
    rng = random.Random(7)
    word = lambda n: "".join(rng.choice("abKs.é-") for _ in range(rng.randint(0, n)))
    texts = sorted({word(6) for _ in range(60)} | {"Straße", "ABs\n", "ab", "", "\u212a1", "\u017fa"})
    patterns = sorted({word(3) + rng.choice(["*", "?", "", "*b", "?a*"]) + word(2) for _ in range(60)} | {"*", "??", "", "k?", "s*", "*S", "STRASSE"})
    rows = spark.createDataFrame([(t,) for t in texts], "id string").union(spark.createDataFrame([(None,)], "id string"))
    globbed = spark.createDataFrame([(i, p) for i, p in enumerate(patterns)] + [(-1, None)], "idx int, pattern string")
    got = [(r.id, r.pattern) for r in globs.glob_join(rows, F.col("id"), globbed, "pattern").collect()]
    assert len(got) == len(set(got)) and set(got) == {(t, p) for t in texts for p in patterns if fits(t, p)}
    assert globs.glob_join(rows, F.col("id"), globbed.limit(0), "pattern").count() == 0


def test_many_globs_need_no_product(spark):
    rows = spark.range(300).select(F.concat(F.lit("svc-"), F.col("id").cast("string")).alias("id"))
    many = spark.range(20_000).select(F.col("id").alias("idx"), F.concat(F.lit("svc-"), F.col("id").cast("string"), F.lit("*")).alias("pattern"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = globs.glob_join(rows, F.col("id"), many, "pattern")
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan
        assert found.count() == 10 + 90 * 2 + 200 * 3
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_files_in_splits_of_any_size_give_the_same_entries(spark, tmp_path):
    rng = random.Random(5)
    for name in ("a.log", "b.log"):
        lines = [rng.choice(["2024-01-01 00:00:01|INFO|h|1|2|m|c", "  more é", "", "x" * rng.randint(1, 90)]) for _ in range(150)]
        (tmp_path / name).write_bytes("\r\n".join(lines).encode() if name == "a.log" else ("\n".join(lines) + "\n").encode())
    want = None
    for size in ("128m", "700b", "64b"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "16b")
        try:
            read = logs.read_lines(spark, str(tmp_path), "*.log")
            numbered = sorted((r.file.rsplit("/", 1)[1], r.line_no, r.line) for r in read.collect())
            found = sorted((r.file, r.entry_no, r.line, r.continuation, r.n_lines) for r in logs.entries(read, 40).collect())
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")
        assert want is None or want == (numbered, found)
        want = numbered, found
    plain = [(f, i, line) for f in ("a.log", "b.log") for i, line in enumerate((tmp_path / f).read_bytes().decode().replace("\r\n", "\n").split("\n")) if line]
    assert want[0] == sorted(plain)


def test_files_parsed_in_pieces_are_those_parsed_whole(spark, tmp_path):
    rng = random.Random(11)
    formats = [logs.template("[{level}] {host}: {message}({caller})"), logs.template("{timestamp}|{pid}|{host}|{message}"), logs.template("[{level}] {host}: {message}")]
    shapes = ["[INFO ] a: one(c) and rest", "2024| 7x|h|two", "[WARN] b: three", "more", "", "  ", "[X]", "a|b", "[E] h: m (c)", "|-12|  h |"]
    texts = {f"f{i}.log": "\n".join(rng.choice(shapes) for _ in range(60)) for i in range(3)}
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    fields = ("level", "timestamp", "host", "pid", "message", "caller")
    whole = logs.parse_files(spark.createDataFrame(list(texts.items()), "file string, text string"), formats).collect()
    want = sorted((r.file, r.entry + 1, *(r[f] for f in fields), [c for c in r.continuations if c.strip()]) for r in whole)
    pieces = logs.parse_lines(logs.read_lines(spark, str(tmp_path)), formats, 7).collect()
    assert sorted((r.file.rsplit("/", 1)[1], r.entry_no, *(r[f] for f in fields), [c for c in r.continuations if c.strip()]) for r in pieces) == want and len(want) > 60
    with pytest.raises(ValueError):
        logs.parse_lines(logs.read_lines(spark, str(tmp_path)), [logs.template("{level}{newline}{message}")])


def test_executors_get_the_package(tmp_path):
    """On a cluster of other processes, started elsewhere and without the driver's path."""
    code = f"""
import sys
sys.path.insert(0, {str(ROOT)!r})
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local-cluster[1,1,1024]").config("spark.ui.enabled", "false").config("spark.executor.memory", "1g")
    .config("spark.sql.shuffle.partitions", "2").config("spark.checkpoint.dir", {str(tmp_path)!r}).getOrCreate())
from tidewatch.operators import logs
from tidewatch.session import ship_package
ship_package(spark)
files = spark.createDataFrame([("f", "2024-01-01|INFO|x\\nmore")], "file string, text string")
assert [r.level for r in logs.parse_files(files, [logs.template("{{timestamp}}|{{level}}|{{message}}")]).collect()] == ["INFO"]
def where(parts):
    import pandas, tidewatch
    yield pandas.DataFrame({{"path": [tidewatch.__file__]}})
assert ".zip/" in spark.range(1).mapInPandas(where, "path string").first().path
spark.stop()
"""
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, timeout=240, capture_output=True, text=True, env={k: v for k, v in __import__("os").environ.items() if k not in ("PYTHONPATH", "SPARK_CONF_DIR")})
    assert done.returncode == 0, done.stderr[-3000:]
