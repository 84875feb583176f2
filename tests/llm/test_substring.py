import random
import re

import numpy as np
import pytest

from tidewatch.llm import substring

SCHEMA = "doc_id long, text string, kept string, batch string"


def brute(rows, window=13):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t, *_ in rows]
    least = {}
    for (i, *_), w in zip(rows, words, strict=True):
        if i is not None:
            for k in range(len(w) - window + 1):
                key = tuple(w[k : k + window])
                least[key] = min(least.get(key, i), i)
    out = []
    for (i, *_), w in zip(rows, words, strict=True):
        gone = [False] * len(w)
        if i is not None:
            for k in range(len(w) - window + 1):
                if least[tuple(w[k : k + window])] < i:
                    gone[k : k + window] = [True] * window
        out.append((-1 if i is None else i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return sorted(out)


def corpus(seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)] + ["é", "日本", "\x1cx"]
    passage = [[rng.choice(vocab) for _ in range(rng.randrange(5, 60))] for _ in range(12)]
    rows = []
    for i in range(150):
        text = []
        for _ in range(rng.randrange(0, 6)):
            text += rng.choice(passage)[: rng.randrange(1, 70)] if rng.random() < 0.5 else [rng.choice(vocab) for _ in range(rng.randrange(30))]
        rows.append((i * 3, "".join(w + rng.choice([" ", "  ", "\n", "\t "]) for w in text), "k", "b"))
    rows += [(900 + i, rows[7][1] + " tail" * 40, "k", "b") for i in range(30)]
    rows += [(rows[9][0], rows[9][1], "k", "b"), (1, None, "k", "b"), (2, "", "k", "b"), (4, "a " * 30000, "k", "b"), (5000, "a " * 40, "k", "b"), (None, rows[7][1], "k", "b")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for sizes in ({}, {"batch_bytes": 4000, "group_nodes": 300}):
        got = substring.remove_repeats(spark, df, **sizes).collect()
        assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.kept) for r in got) == brute(rows)
        assert {r.row.batch for r in got} == {"b"}


def spaced(text, gone):
    """The text without its gone words: each goes with the white space before it, the first ones with that after them."""
    spans = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", text or "")]
    out, first = "", True
    for (a, b), g, before in zip(spans, gone, [0, *(b for _, b in spans)], strict=False):
        if not g:
            out += (text[a:b] if first and any(gone[: spans.index((a, b))]) else text[before:b])
            first = False
    return out + (text[spans[-1][1] :] if spans else text or "")


@pytest.mark.parametrize("seed", [3, 4])
def test_white_space_stays(spark, seed):
    rows = corpus(seed)
    got = substring.remove_repeats(spark, spark.createDataFrame(rows, SCHEMA), spaced=True, batch_bytes=9000).collect()
    plain = substring.remove_repeats(spark, spark.createDataFrame(rows, SCHEMA)).collect()
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    key = lambda r: (r.doc_id is None, r.doc_id, r.text or "")
    for a, b in zip(sorted(got, key=key), sorted(plain, key=key), strict=True):
        assert words(a.kept) == words(b.kept)
        if not a.n_removed:
            assert a.kept == (a.text or "")
    w = substring.Words(np.frombuffer(b" a b\n c  d e f\tg ", dtype=np.uint8), np.array([0, 9, 17]))
    for bits in range(1 << 7):
        gone = np.array([bits >> i & 1 for i in range(7)], dtype=bool)
        data, ends = substring.spaced_texts(w, gone)
        want = [spaced(" a b\n c  ", gone[:3].tolist()), spaced("d e f\tg ", gone[3:].tolist())]
        assert [bytes(data[a:b]).decode() for a, b in zip(ends[:-1], ends[1:], strict=True)] == want, (bits, want)


def test_batches_hold_their_bytes(spark):
    rng = random.Random(3)
    rows = [(i, "x" * (rng.randrange(30) if i < 500 else 900), "k", "b") for i in range(520)] + [(100, "y" * 700, "k", "b"), (None, "z", "k", "b"), (77, None, "k", "b")]
    bounds = substring.batch_bounds(spark.createDataFrame(rows, SCHEMA).repartition(7), 1000)
    held = {}
    for i, t, *_ in rows:
        if i is not None:
            at = int(np.searchsorted(bounds, i, side="left"))
            held.setdefault(at, []).append((i, len(t or "")))
    assert all(sum(n for _, n in b) <= 1000 or len({i for i, _ in b}) == 1 for b in held.values()) and 25 < len(held) < 60


def test_groups_hold_their_size():
    counts = np.array([5, 0, 3, 25, 4, 4, 4])
    first, parts = substring.group_plan(counts, 10)
    assert first.tolist() == [0, 0, 0, 1, 4, 4, 5] and parts.tolist() == [1, 1, 1, 3, 1, 1, 1]


def test_empty(spark):
    assert substring.remove_repeats(spark, spark.createDataFrame([], SCHEMA)).count() == 0
