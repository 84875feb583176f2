import re

import corpus_pipeline as p
import pytest
from pyspark.sql import functions as F

from tests.llm.test_minhash import brute as near_brute
from tests.llm.test_substring import brute as cut_brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """What goes into and comes out of each stage."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in p.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, SF).write.parquet(path)
        after = spark.read.parquet(path)
        out.append((docs, after))
        docs = after
    return out


def rows(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_filters_keep_rows_as_they_are(steps):
    for before, after in steps[:2]:
        assert after.columns == before.columns and 0 < after.count() < before.count()
        assert after.exceptAll(before).count() == 0


def test_near_dedup_keeps_one_of_each_group(steps):
    before, after = steps[2]
    want = sorted({i for i, _, component in near_brute(rows(before), 5) if i == component})
    assert sorted(i for i, _ in rows(after)) == want


def test_substring_stage_is_brute_force(steps):
    before, after = steps[3]
    texts = dict(rows(before))
    want = {i: kept if gone else texts[i] for i, n, gone, kept in cut_brute(rows(before)) if gone < n or not n}
    got = dict(rows(after))
    plain = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    assert {i: plain(t) for i, t in got.items()} == {i: plain(t) for i, t in want.items()}
    assert any(gone and "\n" in texts[i] and "\n" in got[i] for i, n, gone, _ in cut_brute(rows(before)) if i in got)
    assert after.columns == before.columns and after.where(F.length("text") != F.col("n_chars")).count() == 0


def test_packing_holds_all_that_came(steps):
    before, after = steps[4]
    assert {r.doc_id for r in after.collect()} == {i for i, _ in rows(before)}
    assert after.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("m")).where("n != m OR n > 2048").count() == 0


def test_run_gives_what_the_stages_give(spark, steps):
    assert re.search("^sequence_id|sequence_id", " ".join(p.run(spark, SF).columns))
    cols = ["doc_id", "piece", "start", "length", "ids_crc32"]
    got, want = p.run(spark, SF).select(cols), steps[-1][1].select(cols)
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0


def test_empty_documents(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in p.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.count() == 0


def test_clashing_columns_and_rows_without_id(spark):
    text = "a passage that says one thing after the other and then some more words to fill it " * 3
    rows = [(1, text, 9.5, 1, "k"), (None, text, 9.5, 1, "k"), (None, None, None, None, None), (2, text, None, None, None), (2, text, None, None, None), (3, "", 1.0, 0, "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double, predicted int, `row` string")
    for _, stage in p.STAGES[:4]:
        after = stage(spark, docs, SF)
        assert after.columns == docs.columns and after.schema == docs.schema
        after.collect()
    got = p.near_dedup_stage(spark, docs, SF).collect()
    assert sorted(str(r.doc_id) for r in got) == ["1", "3", "None", "None"]
    got = p.substring_stage(spark, docs, SF).collect()
    assert sorted(str(r.doc_id) for r in got) == ["1", "3", "None", "None"]
    assert p.packing_stage(spark, docs, SF).count() == len(rows)


def test_a_doc_id_with_unlike_texts_keeps_them(spark):
    a, b, c = ("one two three four five six seven", "seven eight nine ten eleven twelve", "the third text is unlike the others")
    for given, want in (
        ([(1, a, "x"), (1, b, "x"), (2, c, "x")], [(1, a), (1, b), (2, c)]),
        ([(2, a, "x"), (2, b, "x"), (1, a, "x")], [(1, a), (2, b)]),
        ([(1, a, "y"), (1, a, "x"), (1, a.upper(), "x"), (2, a, "x")], None),
        ([(1, None, "x"), (1, "", "x"), (None, a, "x"), (1, a, "x")], [(1, None), (1, ""), (None, a), (1, a)]),
    ):
        kept = set()
        for parts in (1, 4) if want and given[0][0] == 2 else (2,):
            got = p.near_dedup_stage(spark, spark.createDataFrame(given, "doc_id long, text string, text_id string").repartition(parts, "text"), SF).collect()
            kept.add(tuple(sorted(map(str, got))))
            if want:
                assert sorted(map(str, ((r.doc_id, r.text) for r in got))) == sorted(map(str, want))
            else:
                assert len(got) == 1
        assert len(kept) == 1


def test_very_long_texts(spark):
    rows = [(1, "a line of words. " * 200_000), (2, "x" * 3_000_000), (3, "short and clean text"), (4, "a line of words. " * 200_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for _, stage in p.STAGES[2:]:
        docs = stage(spark, docs, SF)
        assert sorted({r.doc_id for r in docs.select("doc_id").collect()}) == [1, 2, 3]
