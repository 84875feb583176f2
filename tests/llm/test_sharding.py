import os

import numpy as np
from pyspark.sql import functions as F

from tidewatch.llm import sharding

SCHEMA = "doc_id long, text string, shard string, slot int"


def dealt(df):
    return [(r.shard, r.slot, tuple(r.record)) for r in df.collect()]


def table(spark, n):
    rows = [(i % 7 if i % 3 else 5, None if i % 5 == 0 else "" if i % 5 == 1 else "same" if i % 5 == 2 else f"text {i} é", "own", i if i % 5 > 2 else 0) for i in range(n)]
    return spark.createDataFrame(rows, SCHEMA), rows


def test_every_record_has_one_place_and_counts_are_level(spark):
    for n in (0, 1, 5, 23, 24, 25, 500):
        df, rows = table(spark, n)
        got = dealt(sharding.external_shuffle(spark, df, 24, least_buckets=8))
        assert sorted(map(str, (r for _, _, r in got))) == sorted(map(str, rows))
        places = {}
        for shard, slot, _ in got:
            places.setdefault(shard, []).append(slot)
        assert all(sorted(v) == list(range(len(v))) for v in places.values())
        sizes = [len(places.get(s, [])) for s in range(24)]
        assert set(places) <= set(range(24)) and max(sizes) - min(sizes) <= 1


def test_places_are_those_of_a_plain_shuffle(spark):
    df = spark.range(300, numPartitions=5).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") % 40).cast("int")).alias("text"))
    seed, buckets, shards = 4, 16, 7
    got = {r[0]: (s, k) for s, k, r in dealt(sharding.external_shuffle(spark, df, shards, seed=seed, bucket_bytes=1 << 30, least_buckets=buckets))}
    numbered = df.select("doc_id", F.monotonically_increasing_id().alias("number")).select("*", sharding.bucket_of(F.col("number"), buckets, seed).alias("bucket")).collect()
    order = []
    for b in range(buckets):
        members = [r.doc_id for r in sorted(numbered, key=lambda r: r.number) if r.bucket == b]
        picks = np.random.default_rng((seed, b)).integers(0, np.arange(1, len(members) + 1)) if members else []
        for i in range(len(members) - 1, 0, -1):
            members[i], members[picks[i]] = members[picks[i]], members[i]
        order += members
    want = {}
    for s in range(shards):
        run = [doc for place, doc in enumerate(order) if place * shards // 300 == s]
        want |= {doc: (s, k) for k, doc in enumerate(run)}
    assert got == want


def test_seeds_and_evenness(spark):
    df = spark.range(2000, numPartitions=4).select("id", F.lit("t").alias("text"))
    one, again, other = ({r[0]: (s, k) for s, k, r in dealt(sharding.external_shuffle(spark, df, 10, seed=s, least_buckets=16))} for s in (1, 1, 2))
    assert one == again and one != other
    first = [sum(one[i][0] == s for i in range(1000)) for s in range(10)]  # about 100 of the first half in each shard
    assert all(60 < n < 140 for n in first)
    follows = sum(one[i][0] == one[i + 1][0] and one[i][1] + 1 == one[i + 1][1] for i in range(1999))
    assert follows < 12


def test_permutations_are_uniform():
    seen = {}
    for seed in range(6000):
        p = tuple(sharding.fisher_yates(4, (seed, 1)))
        seen[p] = seen.get(p, 0) + 1
    assert len(seen) == 24 and all(180 < n < 320 for n in seen.values())
    assert len(sharding.fisher_yates(0, (1,))) == 0 and list(sharding.fisher_yates(1, (1,))) == [0]


def test_small_buckets_and_files(spark, tmp_path):
    folder = str(tmp_path / "shards")
    df = spark.createDataFrame([(i, "y" * (50_000 if i == 3 else 10)) for i in range(200)], "doc_id long, text string")
    done = sharding.external_shuffle(spark, df, 4, bucket_bytes=100, least_buckets=1, folder=folder)
    assert {f for f in os.listdir(folder) if f.startswith("shard=")} == {f"shard={s}" for s in range(4)}
    assert done.groupBy("shard").count().select("count").distinct().collect()[0][0] == 50
    assert done.where("length(record.text) = 50000").count() == 1


def test_upper_level_of_starts(spark, monkeypatch):
    monkeypatch.setattr(sharding, "SUPER", 4)
    rows = [(int(b),) for b in np.random.default_rng(1).integers(0, 40, 500)]
    got = {r.bucket: r.start for r in sharding.starts_of(spark.createDataFrame(rows, "bucket long")).collect()}
    assert got == {b: sum(r[0] < b for r in rows) for b in {r[0] for r in rows}}
