import random
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tidewatch.llm import quality


def stats(text):
    return dict(zip(quality.STATISTICS, quality.statistics(pa.array([text]))[0], strict=True))


def test_statistics():
    s = stats("Ab cd!\ncd é. 12\n\ncd é. 12")
    assert s["bytes"] == 27 and s["words"] == 8 and s["lines"] == 3
    assert s["distinct_words"] == 5 / 8 and s["distinct_lines"] == 2 / 3 and s["longest_word"] == 3
    assert s["capital_words"] == 1 / 8 and s["shouted_words"] == 1 / 8 and s["stopped_words"] == 2 / 8
    assert s["high"] == 4 / 27 and s["digit"] == 4 / 27
    assert not any(stats(None).values()) and not any(stats("").values())


def test_statistics_of_many_texts_are_those_of_each():
    rng = random.Random(2)
    texts = ["".join(rng.choice("ab \n\tÉ!|.Z9") for _ in range(rng.randrange(80))) for _ in range(300)] + [None, "\n", "x" * 100000]
    assert np.allclose(quality.statistics(pa.array(texts)), np.concatenate([quality.statistics(pa.array([t])) for t in texts[:-3]] + [quality.statistics(pa.array([t], pa.string())) for t in texts[-3:]]))


def test_trees_learn_and_walk():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 4))
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] < -0.2)).astype(float)
    model = quality.fit(x[:2000], y[:2000])
    assert ((model.score(x[2000:]) > 0.5) == y[2000:]).mean() > 0.95

    def walk(row):
        total = model.base
        for f, t, v in zip(model.feature, model.threshold, model.value, strict=True):
            i = 0
            while i < len(f):
                i = 2 * i + 1 + (row[f[i]] > t[i])
            total += v[i - len(f)]
        return total

    assert np.allclose(model.margin(x[:50]), [walk(r) for r in x[:50]])
    assert quality.fit(x[:0], y[:0]).score(x[:2]).tolist() == [0.5, 0.5]


def corpus():
    rng = random.Random(1)
    rows = []
    for i in range(400):
        words = [rng.choice(["the", "river", "stone", "Over", "green,", "hill."]) for _ in range(rng.randrange(5, 60))]
        bad = i % 3 == 0
        rows.append((i, " ".join(w.upper() + "!!" if bad else w for w in words), 0 if bad else 1))
    return rows


def test_held_out_accuracy(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + [(900, None, "x"), (901, "", "x"), (None, "a b", "x")], "doc_id long, text string, quality string")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows] + [(5000, 1), (None, 0), (3, None)], "doc_id long, quality int")
    got = quality.score(docs, quality.learn(docs, labels)).withColumn("held", quality.held_out(4, 2)).collect()
    assert len(got) == len(rows) + 3 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    assert all(r.held == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    want = {i: q for i, _, q in rows}
    held = [r for r in got if r.held and r.doc_id in want]
    assert len(held) > 50 and sum(r.predicted == want[r.doc_id] for r in held) >= 0.97 * len(held)
    chosen = quality.learnable(labels, "quality", 4, 2, 1000)
    assert chosen.where(quality.held_out(4, 2)).count() == 0 and chosen.count() > 200


def test_empty(spark):
    docs, labels = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, quality int")
    assert quality.score(docs, quality.learn(docs, labels)).count() == 0
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    assert quality.score(docs, quality.learn(docs, labels)).select(F.col("score")).first().score == 0.5


def test_repeated_rows_long_texts_and_clashing_columns(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice(["good", "words", "here"]) for _ in range(40)) if i % 2 else "!!! 9 " * 30, i % 2) for i in range(200)]
    long = "good words here " * 50_000
    docs = spark.createDataFrame([(i, t, 7.0, "p") for i, t, _ in rows] + [(1000, long, 7.0, "p"), (1000, long, 7.0, "p"), (1001, None, None, None), (None, "", 7.0, "p")], "doc_id long, text string, score double, predicted string")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows], "doc_id long, quality int")
    scored = quality.score(docs, quality.learn(docs.select("doc_id", "text"), labels))
    assert scored.columns == ["doc_id", "text", "score", "predicted"] and dict(scored.dtypes)["predicted"] == "int"
    got = scored.select("doc_id", "score", "predicted").collect()
    assert len(got) == 204 and len({r.score for r in got if r.doc_id == 1000}) == 1 and sum(r.doc_id == 1000 for r in got) == 2
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    assert sum(r.predicted == dict((i, q) for i, _, q in rows)[r.doc_id] for r in got if r.doc_id is not None and r.doc_id < 1000) > 195
