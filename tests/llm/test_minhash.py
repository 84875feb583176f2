import random
import re

import numpy as np

from tidewatch.llm import minhash
from tidewatch.llm.graph import components

SCHEMA = "doc_id long, text string, node string, component string"


def shingles(text, k):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)} if words else set()


def brute(rows, k, percent=80):
    """doc_id, size and component of each row; a row is a document."""
    sets, up = [shingles(r[1], k) for r in rows], list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, s in enumerate(sets):
        for j, t in enumerate(sets[:i]):
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                up[root(i)] = root(j)
    least = {}
    for i, r in enumerate(rows):
        least[root(i)] = min(least.get(root(i), r[0]), r[0])
    return sorted((r[0], len(s), least[root(i)]) for i, (r, s) in enumerate(zip(rows, sets, strict=True)))


def corpus(seed=5, n=60):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)] + ["É", "naïve", "X"]
    rows = []
    for _ in range(n):
        base = [rng.choice(vocab) for _ in range(rng.randrange(1, 120))]
        for _ in range(rng.randrange(1, 7)):
            copy = list(base)
            for _ in range(rng.randrange(0, 1 + len(copy) // 12)):
                copy[rng.randrange(len(copy))] = rng.choice(vocab)
            rows.append(" ".join(copy))
    rng.shuffle(rows)
    rows = [(i, t, "n", "c") for i, t in enumerate(rows)]
    base = [rng.choice(vocab) for _ in range(100)]
    for i in range(60):  # a chain: neighbours are alike, the ends are not
        base[i] = f"chain{i}"
        rows.append((1000 + i, " ".join(base), "n", "c"))
    return rows + [(2000, None, "n", "c"), (2001, "", "n", "c"), (2002, " \t\n", "n", "c"), (2003, "one", "n", "c"), (2004, "ONE", "n", "c"), (2005, "one two", "n", "c"), (2006, "w1 " * 30000, "n", "c"), (3, rows[3][1], "n", "c"), (3, rows[9][1], "n", "c"), (3, "quite another text " * 9, "n", "c"), (2007, "quite another text", "n", "c"), (2007, rows[11][1], "n", "c")]


def test_equals_brute_force(spark):
    rows = corpus()
    for k in (2, 5):
        got = minhash.near_duplicates(spark, spark.createDataFrame(rows, SCHEMA).repartition(5), k).collect()
        assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows, k)
        assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_groups_near_the_threshold_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 4)
    monkeypatch.setattr(minhash, "TASK_ROWS", 30)
    rng = random.Random(8)
    base = [f"b{i}" for i in range(80)]
    rows = []
    for i in range(90):  # pairs of copies are alike by 0.6 to 0.95
        copy = list(base)
        for j in rng.sample(range(80), rng.randrange(1, 9)):
            copy[j] = f"x{rng.randrange(3)}"
        rows.append((i, " ".join(copy), "n", "c"))
    got = minhash.near_duplicates(spark, spark.createDataFrame(rows, SCHEMA), 2).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows, 2)


def test_cross_links_join_what_is_linked():
    rng = np.random.default_rng(3)
    base = np.arange(1000, 1400, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[rng.random(400) < 0.9], rng.integers(0, 999, 5).astype(np.uint64)])) for _ in range(40)]
    labels, every = np.arange(40), np.arange(40)
    links = minhash.cross_links(sets, minhash.sketch(sets), labels, every, every, 80, 0.13)
    up = list(range(40))

    def root(i):
        return i if up[i] == i else root(up[i])

    def joined(pairs):
        up[:] = range(40)
        for a, b in pairs:
            up[max(root(a), root(b))] = min(root(a), root(b))
        return [root(i) for i in range(40)]

    def same(a, b):
        common = len(np.intersect1d(sets[a], sets[b]))
        return 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common)

    assert joined(links) == joined([(a, b) for a in range(40) for b in range(a) if same(a, b)])
    assert len(links) < 40


def family(rng, n, common, own):
    """Texts of `common` words that all have, in one place, and `own` words of their own."""
    base = [f"c{i}" for i in range(common)]
    return [(i, " ".join(base + [f"o{rng.randrange(1 << 40)}" for _ in range(own)]), "n", "c") for i in range(n)]


def test_families_that_are_not_alike_enough(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 16)
    monkeypatch.setattr(minhash, "TASK_ROWS", 40)
    rng = random.Random(12)
    rows = family(rng, 120, 80, 18)  # pairs of about 0.7
    copies = [(1000 + i, t + " x", "n", "c") for i, (_, t, *_) in enumerate(rows[:40])]
    base = [f"d{i}" for i in range(100)]
    for i in range(80):  # pairs of 0.65 to 0.9, by words changed in any place
        text = list(base)
        for j in rng.sample(range(100), rng.randrange(2, 12)):
            text[j] = f"e{rng.randrange(1 << 40)}"
        rows.append((3000 + i, " ".join(text), "n", "c"))
    rows += copies
    got = minhash.near_duplicates(spark, spark.createDataFrame(rows, SCHEMA), 2).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows, 2)


def test_blocks_and_tasks_are_bounded_in_bytes(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK_BYTES", 3000)
    monkeypatch.setattr(minhash, "TASK_BYTES", 20_000)
    rng = random.Random(21)
    rows, base = family(rng, 30, 60, 12), [f"b{i}" for i in range(150)]
    for i in range(40):  # books of about 1, 2 and 40 thousand bytes, alike by 0.7 to 1
        text = list(base)
        for j in rng.sample(range(150), rng.randrange(0, 14)):
            text[j] = f"x{rng.randrange(4)}"
        rows.append((1000 + i, " ".join(text * (1, 2, 40)[i % 3]), "n", "c"))
    seen, put = [], minhash.Shelf.put

    def looked_at(self, df):
        out = put(self, df)
        if "among" in out.columns:
            seen.extend(out.where("n - n_most > 1").selectExpr("a", "ceil((bytes - bytes_most) / 3000D) AS parts", "n - n_most AS rows").collect())
        return out

    monkeypatch.setattr(minhash.Shelf, "put", looked_at)
    got = minhash.near_duplicates(spark, spark.createDataFrame(rows, SCHEMA), 2).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows, 2)
    assert seen and all(r.a == min(r.rows, r.parts) for r in seen) and max(r.a for r in seen) > 3


def dealt_rows(spark, rows, monkeypatch):
    """Rows that the comparison of what stars leave open gets, and buckets' rows by rare shingles."""
    seen = {"dealt": 0, "rare": 0}
    put = minhash.Shelf.put

    def counted(self, df):
        out = put(self, df)
        if "among" in out.columns:
            seen["dealt"] += out.selectExpr("coalesce(sum((n - n_most) * (among + b) + n_most * a), 0) AS r").first().r
        if out.columns == ["key", "node"]:
            seen["rare"] += out.count()
        return out

    with monkeypatch.context() as m:
        m.setattr(minhash.Shelf, "put", counted)
        n = minhash.near_duplicates(spark, spark.createDataFrame(rows, SCHEMA), 2).where("kept").count()
    return n, seen["dealt"], seen["rare"]


def test_open_families_grow_in_proportion(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 64)
    few, many = (dealt_rows(spark, family(random.Random(3), n, 40, 9), monkeypatch) for n in (300, 1200))
    assert few[0] == 300 and many[0] == 1200  # nothing is linked
    assert few[1] > 300 and many[1] <= 5 * few[1] and few[2] == many[2] == 0


def test_one_doc_id_with_different_texts(spark):
    a, b, c = "one two three four five six", "seven eight nine ten eleven", "twelve thirteen fourteen fifteen"
    cases = [([(1, a), (1, b), (2, c)], 3), ([(2, a), (2, b), (1, a)], 2), ([(1, a), (1, a.upper()), (1, ""), (1, None), (3, a)], 3)]
    for rows, kept in cases:
        for parts in (3,):
            got = minhash.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(parts), 2).collect()
            assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows, 2)
            assert len({(r.doc_id, r.text_id) for r in got if r.first}) == kept


def test_rows_without_id(spark):
    rows = [(None, "a b c", "n", "c"), (4, "a b c", "n", "c"), (None, "x y z", "n", "c"), (None, None, "n", "c"), (7, "a b c", "n", "c")]
    got = minhash.near_duplicates(spark, spark.createDataFrame(rows, SCHEMA), 2).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in got) == [("4", 2, "4", True), ("7", 2, "4", False), ("None", 0, "None", True), ("None", 2, "4", False), ("None", 2, "None", True)]


def test_empty_table(spark):
    assert minhash.near_duplicates(spark, spark.createDataFrame([], SCHEMA)).count() == 0


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(1)
    x = [np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64)) for n in (1, 30, 3000)]
    a = minhash.sketch(x)
    joined = minhash.sketch([np.union1d(x[0], x[2]), np.union1d(x[1], x[2])])
    assert (joined == np.maximum(a[:2], a[2])).all()
    half = minhash.sketch([x[2][:2400], x[2][600:]])
    assert abs(minhash.joint_estimate(half[:1], half[1:], np.array([2400]), np.array([2400]))[0] - 0.6) < 0.15


def test_components(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, 9), (9, 5), (7, 7), (9, 3), (200, 100)]
    got = {r.node: r.component for r in components(spark, spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 100 for i in range(101, 161)}, 200: 100, 5: 3, 9: 3}
