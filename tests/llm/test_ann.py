import numpy as np

from tidewatch.llm import ann
from tidewatch.llm.queries import op2_nearest_neighbours

SCHEMA = "vec_id long, embedding array<float>, rank string"


def brute(rows, every=50, k=5):
    good = [(i, np.array(v, float)) for i, v, _ in rows if i is not None and v is not None and None not in v and len(v) == 8 and np.isfinite(v).all() and np.any(v)]
    ids, x = np.array([i for i, _ in good]), np.array([v for _, v in good])
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for i, u in zip(ids, x, strict=True):
        if i % every == 0:
            s = np.round((x * u).sum(axis=1), 12)
            order = [j for j in np.lexsort((ids, -s)) if ids[j] != i][:k]
            out[int(i)] = [(int(ids[j]), s[j]) for j in order]
    return out


def corpus(n=1500):
    rng = np.random.default_rng(4)
    x = np.float32(rng.normal(size=(n, 8))).tolist()
    rows = [(i, x[i], "r") for i in range(n)]
    rows += [(n + i, x[50], "r") for i in range(400)]  # many copies of a query's vector
    return rows + [(10000, None, "r"), (10050, [0.0] * 8, "r"), (10100, [None] + [1.0] * 7, "r"), (10150, [float("nan")] * 8, "r"), (10200, [float("inf")] * 8, "r"), (10250, [1.0], "r"), (None, x[3], "r")]


def test_recall_ties_and_scores(spark):
    rows = corpus()
    want = brute(rows)
    got = {}
    for r in ann.nearest(spark, spark.createDataFrame(rows, SCHEMA)).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(got[r.query_id])
    assert got.keys() == want.keys() and all(len(v) == 5 for v in got.values())
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 5 * len(want)
    assert [i for i, _ in got[50]] == [i for i, _ in want[50]] and [i for i, _ in got[1550]] == [i for i, _ in want[1550]]
    true = {q: dict(v) for q, v in want.items()}
    assert all(abs(s - true[q][i]) < 1e-9 for q in got for i, s in got[q] if i in true[q])


def test_few_and_none(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0], "r"), (1, [1.0, 0.1], "r"), (0, [1.0, 0.0], "r"), (100, [2.0, 0.0], "r")], SCHEMA)
    got = sorted((r.query_id, r.rank, r.vec_id) for r in ann.nearest(spark, few).collect())
    assert got == [(0, 1, 100), (0, 2, 1), (100, 1, 0), (100, 2, 1)]
    assert ann.nearest(spark, spark.createDataFrame([], SCHEMA)).count() == 0


def test_repeated_rows_and_equal_cosines(spark):
    rng = np.random.default_rng(9)
    base = np.float32(rng.normal(size=(300, 8))).tolist()
    x, y = base[0], base[1]
    rows = [(100 + i, base[i], "r") for i in range(300)] * 7  # each row seven times
    rows += [(i, x, "r") for i in (1, 2, 3, 4, 5, 6, 7)] * 7  # one vector, seven ids
    rows += [(1000 + i, [v * 2.0 ** (40 - i) for v in y], "r") for i in range(40)]  # one direction, forty vectors
    want = {}
    unit = {i: np.array(v, float) / np.linalg.norm(np.array(v, float)) for i, v, _ in rows}
    ids = np.array(sorted(unit))
    for q in ids[ids % 50 == 0]:
        score = np.round(np.array([unit[i] @ unit[q] for i in ids]), 12)
        want[q] = [int(i) for i in ids[np.lexsort((ids, -score))] if i != q][:5]
    got = {}
    for r in ann.nearest(spark, spark.createDataFrame(rows, SCHEMA), fraction=1.0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == want and got[100] == [1, 2, 3, 4, 5] and got[1000] == [101, 1001, 1002, 1003, 1004]


def test_an_id_with_two_vectors_has_one_place(spark):
    rows = [(0, [1.0, 0.0], "r"), (0, [0.0, 1.0], "r"), (1, [1.0, 0.1], "r"), (1, [0.1, 1.0], "r"), (1, [1.0, 1.0], "r"), (2, [1.0, 0.2], "r"), (3, [0.3, 1.0], "r"), (4, [1.0, 0.4], "r"), (5, [1.0, 0.5], "r"), (6, [0.6, 1.0], "r")]
    got = {r.rank: (r.vec_id, round(r.score, 6)) for r in ann.nearest(spark, spark.createDataFrame(rows, SCHEMA)).collect() if r.query_id == 0}
    assert got == {i: (i, round(1 / (1 + (i / 10) ** 2) ** 0.5, 6)) for i in range(1, 6)}


def test_traversal_is_by_summed_distance():
    rng = np.random.default_rng(0)
    one, two, counts = rng.random(9), rng.random(7), np.ones((9, 7), int)
    sums = [one[i] + two[j] for i, j in ann.traverse(one, two, counts, 63)]
    assert len(sums) == 63 and sums == sorted(sums)


def test_fraction_follows_the_structure():
    rng = np.random.default_rng(2)
    loose = ann.unit(rng.normal(size=(3000, 32)))
    middles = rng.normal(size=(60, 32))
    tight = ann.unit(middles[rng.integers(0, 60, 3000)] + 0.05 * rng.normal(size=(3000, 32)))
    need = [ann.needed_fraction(x, (ann.centroids(x[:, :16], 8), ann.centroids(x[:, 16:], 8)), 16, 5) for x in (loose, tight)]
    assert need[0] > 0.4 and need[1] < 0.2


def test_recall_on_the_registered_table(spark):
    folder = "/root/testdata/sf0.1"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect() if r.embedding is not None and None not in r.embedding and np.isfinite(r.embedding).all() and np.any(r.embedding)]
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], dtype=float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = {}
    for i, u in zip(ids, x, strict=True):
        if i % 50 == 0:
            near = np.where(ids == i, -np.inf, np.round(x @ u, 12))
            want[int(i)] = set(ids[np.lexsort((ids, -near))[:5]].tolist())
    got = {}
    for r in op2_nearest_neighbours(spark, folder).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    recall = sum(len(got[q] & want[q]) for q in want) / sum(map(len, want.values()))
    print("recall of the registered query:", recall)
    assert got.keys() == want.keys() and recall >= 0.9


def test_blocks_of_queries_get_what_they_visit(spark, monkeypatch):
    monkeypatch.setattr(ann, "QUERY_BLOCK", 7)
    monkeypatch.setattr(ann, "ENTRY_BLOCK", 60)
    rng = np.random.default_rng(6)
    middles = rng.normal(size=(40, 8))
    rows = [(i, np.float32(middles[i % 40] + 0.1 * rng.normal(size=8)).tolist(), "r") for i in range(2000)]
    whole = {}
    for fraction in (1.0, None):
        got = {}
        for r in ann.nearest(spark, spark.createDataFrame(rows, SCHEMA), every=10, fraction=fraction).collect():
            got.setdefault(r.query_id, {})[r.rank] = r.vec_id
        whole[fraction] = got
    want = {q: dict(enumerate((i for i, _ in v), 1)) for q, v in brute(rows, every=10).items()}
    assert whole[1.0] == want
    assert sum(len(set(whole[None][q].values()) & set(want[q].values())) for q in want) >= 0.9 * 5 * len(want)


def test_neighbours_stand_together():
    assert ann.chain(np.array([[0.0], [9.0], [1.0], [8.0], [2.0]])) == [0, 2, 4, 3, 1]
