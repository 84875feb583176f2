import random
import re
import zlib
from collections import Counter

import pytest

from tidewatch.llm import spelling

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def plain_words(docs):
    total = Counter()
    for doc_id, text in docs:
        for m in RUN.finditer(text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in m[0])
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            total[run] += 1
    return {w: n for w, n in total.items() if len(w) >= 5 and n >= 3}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(docs):
    words = plain_words(docs)
    links = {w: [v for v in words if near(w, v)] for w in words}
    form = {}
    for w, vs in links.items():
        best = min(vs, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= 2 * words[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {(w, form[w], root(w), n, len(links[w]), words[form[w]] if form[w] else None) for w, n in words.items()}


def texts(seed, n=60):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcéÀÿz×") for _ in range(rng.randint(5, 8))) for _ in range(25)]
    rows = []
    for i in range(n):
        words = []
        for _ in range(80):
            w = rng.choice(base[: rng.randint(1, 25)])
            if rng.random() < 0.4:
                at, kind = rng.randrange(len(w)), rng.randrange(3)
                w = w[:at] + ("" if kind == 0 else rng.choice("abé")) + w[at + (kind < 2) :]
            words.append(w.upper() if rng.random() < 0.2 and w.isascii() else w)
        rows.append((i, rng.choice([" ", "-", "1", "中", "Ā"]).join(words)))
    return rows + [(None, "hello " * 4 + "hallo"), (1000, None), (1001, ""), (3, rows[3][1]), (3, rows[3][1])]


@pytest.mark.parametrize("seed,crowded", [(1, 2000), (2, 3), (3, 0)])
def test_variants_are_those_of_all_pairs(spark, seed, crowded):
    docs = texts(seed)
    got = [tuple(r) for r in spelling.variants(spark, spark.createDataFrame(docs, "doc_id long, text string").repartition(3), crowded).select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(got) == len(set(got)) and set(got) == plain_variants(docs) and any(r[1] for r in got)


def test_long_chains_end_at_the_most_frequent(spark):
    words = ["abcdefghij"[:k] + "z" * (10 - k) for k in range(11)]  # each is one letter from the next
    docs = [(i, " ".join([w] * (3 * 2**k))) for k, w in enumerate(words) for i in [k]]
    got = {r.word: r.root for r in spelling.variants(spark, spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert {w: words[-1] for w in words if w in got} == {w: r for w, r in got.items() if w in words} and len(got) >= 9


def test_ties_and_forms(spark):
    docs = [(1, "paper " * 10 + "paler " * 10 + "paver " * 3 + "pacer " * 6)]
    got = {r.word: (r.form, r.n_near, r.form_n) for r in spelling.variants(spark, spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {"paper": (None, 3, None), "paler": (None, 3, None), "paver": ("paler", 3, 10), "pacer": (None, 3, None)}


def test_empty_and_clashing_columns(spark):
    assert spelling.variants(spark, spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert spelling.variants(spark, spark.createDataFrame([(1, None), (None, " 12 中 ")], "doc_id long, text string")).count() == 0
    df = spark.createDataFrame([(1, "letter letter letter", "w", 5)], "doc_id long, text string, word string, n int")
    assert [r.word for r in spelling.variants(spark, df).collect()] == ["letter"]


def test_long_text_and_small_tables(spark, monkeypatch):
    monkeypatch.setattr(spelling, "LISTED", 100)
    monkeypatch.setattr(spelling, "HELD_WORDS", 3)
    docs = [(7, "Wörter wörtern wort-wortes " * 3000), (8, "wörter " * 2)]
    got = {r.word: r.n for r in spelling.count_words(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == plain_words(docs)


def test_one_edit_leaves_a_band(spark):
    rng = random.Random(5)
    letters = [chr(c) for c in (*range(97, 123), *range(0xC0, 0x100))]
    rows = []
    for _ in range(400):
        w = "".join(rng.choices(letters, k=rng.randint(5, 12)))
        at = rng.randrange(len(w))
        rows.append((w, rng.choice([w[:at] + w[at + 1 :], w[:at] + rng.choice(letters) + w[at + 1 :], w[:at] + rng.choice(letters) + w[at:]])))
    mask = lambda c: [spelling.parities(b).alias(f"{c}{b}") for b in range(3)]
    one = spark.createDataFrame(rows, "word string, o string").select(*mask("a"), "o").withColumnRenamed("o", "word").select("*", *mask("b")).collect()
    assert all(any(r[f"a{b}"] == r[f"b{b}"] for b in range(3)) and sum((r[f"a{b}"] ^ r[f"b{b}"]).bit_count() for b in range(3)) <= 2 for r in one)
