import random
import re
from collections import Counter

import numpy as np
import pytest

from tidewatch.llm import divergence
from tidewatch.llm.queries import OP13_SQL

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def plain(docs, least=10, top=10):
    rows = [tuple("" if v is None else v for v in d[:3]) for d in docs]
    out = set()
    for lang in {r[0] for r in rows}:
        df, groups, whole = Counter(), {}, Counter()
        for _, source, text in (r for r in rows if r[0] == lang):
            terms = Counter("".join(c.lower() if "A" <= c <= "Z" else c for c in t) for t in TERM.findall(text))
            df.update(terms.keys())
            groups.setdefault(source, Counter()).update(terms)
            whole.update(terms)
        kept = [t for t, n in df.items() if n >= least]
        share = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c[t] for t in kept) + 2 * len(kept)) for t in kept}  # noqa: E731, B023
        p, q = {s: share(c) for s, c in groups.items()}, share(whole)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in groups:
            pairs = sorted(((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in groups if o != s))
            terms = sorted((-f(p[s][t], q[t]), t.encode()) for t in kept if groups[s][t] and p[s][t] > q[t])[:top]
            for part, found in (("pair", pairs), ("term", terms)):
                out |= {(lang, s, part, item.decode(), -v, i + 1) for i, (v, item) in enumerate(found)}
    return out


def documents(seed, n=150):
    rng = random.Random(seed)
    words = ["".join(rng.choice("aBé中ñz") for _ in range(rng.randint(1, 4))) for _ in range(60)]
    rows = []
    for _ in range(n):
        lang, source = rng.choice(["en", "en", "fr", None, ""]), rng.choice([None, "", "a", "b", "b", "b", "é", "z"])
        rows.append((lang, source, rng.choice([" ", ".", "_", "1\t"]).join(rng.choice(words[: 20 + len(source or "") * 20]) for _ in range(rng.randint(0, 30)))))
    return rows + [("en", "a", None), ("en", "only", ""), ("xx", "s", "few terms"), ("xx", "t", ""), rows[0], rows[0]]


COLUMNS = ("lang", "source", "part", "item", "value", "rank")


@pytest.mark.parametrize("seed,block,held", [(1, 512, 400_000), (2, 2, 40), (3, 1, 1)])
def test_audit_is_the_plain_one(spark, monkeypatch, seed, block, held):
    monkeypatch.setattr(divergence, "HELD_COUNTERS", held)
    monkeypatch.setattr(divergence, "CELLS", 7)
    docs = documents(seed)
    got = [tuple(r[c] for c in COLUMNS) for r in divergence.audit(spark, spark.createDataFrame(docs, "lang string, source string, text string").repartition(5), block=block).collect()]
    assert len(got) == len(set(got)) and set(got) == plain(docs)


def test_empty_tables_and_clashing_columns(spark):
    assert divergence.audit(spark, spark.createDataFrame([], "lang string, source string, text string")).count() == 0
    docs = [(*d, 1, "x") for d in documents(4, 60)]
    got = divergence.audit(spark, spark.createDataFrame(docs, "lang string, source string, text string, value int, item string"))
    assert {tuple(r[c] for c in COLUMNS) for r in got.collect()} == plain(docs)


def test_twin(spark):
    import duckdb

    docs = documents(9)
    db = duckdb.connect()
    db.execute("CREATE TABLE documents (lang VARCHAR, source VARCHAR, text VARCHAR)")
    db.executemany("INSERT INTO documents VALUES (?, ?, ?)", docs)
    assert set(db.execute(f"SELECT {', '.join(COLUMNS)} FROM ({OP13_SQL})").fetchall()) == plain(docs)


def test_tries_hold_what_they_are_given_in_order():
    rng = random.Random(3)
    words = [bytes(rng.choices(b"ab\xc3\xff", k=rng.randint(1, 7))) for _ in range(3000)]
    trie, want = divergence.Trie(), {}
    new = 0
    for w in words:
        source = rng.choice("xyz")
        new += trie.merge(w, 1, ((source, 2),))
        want.setdefault(w, Counter())[source] += 2
    assert [(t, leaf[1]) for t, leaf in trie.walk()] == sorted((w, dict(c)) for w, c in want.items())
    assert sum(leaf[0] for _, leaf in trie.walk()) == 3000 and new == sum(map(len, want.values()))
    depth = lambda node: 1 + max(map(depth, (node[1] or {}).values()), default=0)
    assert depth(trie.root) <= 8 and all(n[2] or len(n[1]) > 1 for n in nodes(trie.root) if n is not trie.root)  # no node with one child and no leaf
    for w in words[:50] + [b"", b"zz"]:
        assert trie.merge(w, 1, (("x", 1),)) == (w not in want or "x" not in want[w])


def nodes(node):
    yield node
    for child in (node[1] or {}).values():
        yield from nodes(child)


def test_long_texts_are_split_between_terms(monkeypatch):
    text = ("Äpfel und BIRNEN, x" * 700 + "ä" * 5000).encode()
    [whole] = divergence.terms_of(text)
    monkeypatch.setattr(divergence, "PIECE", 50)
    pieces = list(divergence.terms_of(text))
    assert sum(pieces, []) == whole and len(pieces) > 200 and Counter(whole)["xÄpfel".encode()] == 699


def test_shares_are_exact_for_large_counts():
    rng = np.random.default_rng(1)
    over = rng.integers(10**10, 2 * 10**14, 200)
    counts = (over * rng.random(200) * 0.9).astype(np.int64)
    assert divergence.shares(counts, over).tolist() == [1 + 10**9 * (int(c) + 2) // int(o) for c, o in zip(counts, over, strict=True)]
