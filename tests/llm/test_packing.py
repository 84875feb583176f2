import itertools
import random
import zlib

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

from tidewatch.llm import packing

ARGS = P.path("byte_bpe_50k.tiktoken"), P.PATTERN


def histogram(seed, n, draw):
    rng, out = random.Random(seed), {}
    for _ in range(n):
        x = draw(rng)
        out[x] = out.get(x, 0) + 1
    return out


DRAWS = [lambda r: r.randrange(1, 2048), lambda r: min(2047, int(r.expovariate(1 / 600)) + 1), lambda r: r.randrange(600, 1100)]


def contents_of(bins):
    out = {}
    for contents, n in bins.count.items():
        assert sum(contents) <= bins.capacity and list(contents) == sorted(contents, reverse=True) and n > 0
        for x in contents:
            out[x] = out.get(x, 0) + n
    return out


def plain_gain(bins, low):
    """The most that a bin no emptier than low can gain by a move, one for one or two for one: every bin and every choice tried."""
    best, free = 0, bins.capacity - sum(low)
    for full, n in bins.count.items():
        if sum(full) < sum(low) or sum(full) == bins.capacity or (full == low and n < 2):
            continue
        pairs = lambda b: [c for c in itertools.combinations(b, 2)]
        for gives, gets in [*(((), (x,)) for x in low), *(((y,), (x,)) for x in low for y in full), *((p, (x,)) for x in low for p in pairs(full)), *(((y,), p) for p in pairs(low) for y in full)]:
            gain = sum(gets) - sum(gives)
            if gain <= bins.capacity - sum(full) and gain <= free:
                best = max(best, gain)
    return best


def test_bins_hold_all_and_are_few():
    for seed, draw in enumerate(DRAWS):
        want = histogram(seed, 4000, draw)
        bins = packing.best_fit(want, 2048)
        before = sum(bins.count.values())
        bins = packing.local_search(bins)
        assert contents_of(bins) == want and packing.fewest(want, 2048) <= sum(bins.count.values()) <= before


def test_trades_are_the_best_of_a_plain_search():
    rng = random.Random(4)
    for _ in range(40):
        bins = packing.best_fit(histogram(rng.random(), rng.randrange(5, 40), lambda r: r.randrange(1, 40)), 60)
        for low in [b for b in bins.count if sum(b) < 60]:
            found = packing.trade(bins, low)
            assert (sum(found[2]) - sum(found[1]) if found else 0) == plain_gain(bins, low)


def test_each_trade_raises_the_squared_fill_and_none_is_left():
    want = histogram(7, 300, DRAWS[2])
    bins, last = packing.best_fit(want, 2048), -1
    start = sum(bins.count.values())
    while True:
        square = sum(sum(b) ** 2 * n for b, n in bins.count.items())
        assert square >= last and contents_of(bins) == want
        if square == last:
            break
        last, bins = square, packing.local_search(bins, steps=1)
    assert sum(bins.count.values()) < start  # the search saved bins
    assert all(plain_gain(bins, b) == 0 for b in bins.count if sum(b) < 2048)


def test_search_empties_a_bin():
    bins = packing.Bins(10)
    for b in ((6, 3), (5, 4), (2,)):
        bins.add(b, 1)
    assert sum(packing.local_search(bins).count.values()) == 2


def test_common_lengths_are_numbered_in_parts(spark, monkeypatch):
    monkeypatch.setattr(packing, "SALT_ROWS", 7)
    rows = [(i if i % 9 else None, 0, 5 if i % 3 else 6, i % 4) for i in range(200)] * 2
    found = spark.createDataFrame(rows, "doc_id long, piece int, length long, ids_crc32 long")
    got = packing.ranked(found, {5: 266, 6: 134}).groupBy("length").agg({"rank": "collect_list"}).collect()
    assert {r.length: sorted(r[1]) for r in got} == {5: list(range(266)), 6: list(range(134))}


def test_sequences(spark):
    long = "The quick brown fox, 1234. " * 1500
    texts = [None, "", "a", "x<|endoftext|>y", long, long[:9000], *("word " * (i * 13 % 700) for i in range(200)), *["same text"] * 300]
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)] + [(3, "twice", "s"), (None, "no id", "s"), (None, "no id", "s")], "doc_id long, text string, length string")
    got = packing.pack(spark, df, *ARGS).collect()
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = {}
    for i, t in enumerate(texts):
        if i == 3:
            continue
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4")
        for k, (start, n) in enumerate(packing.cut(len(ids), 2048)):
            want[i, k] = (start, n, zlib.crc32(ids[start : start + n].tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got if r.doc_id not in (3, None)} == want
    assert sum(r.doc_id is None for r in got) == 2
    ids = tok.encode("x<|endoftext|>y", add_special_tokens=False).ids
    assert {r.length for r in got if r.doc_id == 3} == {len(ids) + 1, len(tok.encode("twice").ids) + 1}
    seqs = {}
    for r in got:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in seqs.values():
        at = 0
        for offset, n in sorted(spans):
            assert offset == at
            at += n
        assert at <= 2048
    assert len(seqs) <= -(-sum(r.length for r in got) // 2048) + 1
    assert packing.pack(spark, spark.createDataFrame([], "doc_id long, text string"), *ARGS).count() == 0
