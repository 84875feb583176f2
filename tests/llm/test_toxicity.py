import random
import re

import numpy as np

from tidewatch.llm import quality, toxicity


def feats(text, **kw):
    return toxicity.Lexicon(**kw).matcher()(text)


def test_folding():
    assert toxicity.fold("ІDІΟТ 1d10t st​up1d m0r0n") == "idiot idiot stupid moron"
    assert toxicity.fold("Idïót ｉｄｉｏｔ") == "idiot idiot"
    assert toxicity.fold("costs 30$ or 5") == "costs 30$ or 5"


def test_terms_boundaries_and_exceptions():
    assert feats("you idiot.")[0] > 0 and feats("1DIOT")[0] > 0 and feats("m0r0n$$$")[0] > 0
    assert feats("idiotic videos, trashy") == (0.0, 0.0, 0.0)
    assert feats("a trash can, class clown") == (0.0, 0.0, 0.0)
    assert feats("a trash can for trash")[0] == feats("a big bin for trash")[0]
    assert feats("idiotically", weights={"idiot*": 3.0})[0] > 0
    assert feats("", weights={}) == (0.0, 0.0, 0.0)
    assert feats("idiot " + "word " * 500)[2] < feats("idiot word")[2]


def test_stand_ins_at_the_end_and_for_l():
    plain = {"assh0l3": "asshole", "imb3c1l3": "imbecile", "imbec11e": "imbecile", "worthle55": "worthless", "1oser": "loser", "1053r": "loser", "b1tch": "bitch", "5tup1d": "stupid", "MOR0N$$": "moron", "retard5": "retard"}
    for shown, word in plain.items():
        for around in ("{}", "you {}!", "a\n{}\nb", "3 {} 4"):
            assert feats(around.format(shown)) == feats(around.format(word)) != (0.0, 0.0, 0.0), (shown, around)
    assert feats("costs 30$ or 5, 1 or 11, 455 h0135 @ $5") == feats("ioser woser1 asshol morons5x") == (0.0, 0.0, 0.0)
    assert feats("c1as5 c1own, a tra5h can") == (0.0, 0.0, 0.0)
    assert feats("1oser", weights={"loser": 2.0, "ioser": 3.0}) == feats("ioser", weights={"ioser": 3.0})
    assert feats("fail fall", weights={"fail": 2.0, "fall": 3.0})[1] == 2**0.5
    assert feats("fai1 fall", weights={"fail": 2.0})[0] == feats("fail fall", weights={"fail": 2.0})[0]


def corpus():
    rng = random.Random(1)
    rows = []
    for i in range(900):
        words = [rng.choice("sel mar tun dor kep lis vam".split()) + rng.choice("a e i o u".split()) for _ in range(rng.randrange(20, 90))]
        bad = i % 5 == 0
        if bad:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["gromba" + rng.choice("aeiou") + "x", "fnork"]))
        rows.append((i, " ".join(words), int(bad)))
    return rows


def test_held_out_accuracy(spark):
    rows = corpus()
    copied = [(2000 + i, "never seen elsewhere quib quab quob " * 5, 1) for i in range(300)]
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows + copied] + [(9000, None, "x"), (9001, "", "x"), (9002, "a quib is a quab, no quob", "x")], "doc_id long, text string, toxic string")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows + copied] + [(9500, 1), (None, 0)], "doc_id long, toxic int")
    lexicon = toxicity.learn(docs, labels)
    assert "fnork" in lexicon.weights and any(t.startswith("gromba") for t in lexicon.weights)
    assert not any(t.startswith("qu") for t in lexicon.weights)  # one copied text makes no terms
    got = {r.doc_id: r for r in toxicity.score(docs, lexicon).withColumn("held", quality.held_out(3, 1)).collect()}
    held = [(got[i].predicted, q) for i, _, q in rows if got[i].held]
    assert len(held) > 200 and sum(p == q for p, q in held) >= 0.97 * len(held)
    assert got[9000].predicted == got[9001].predicted == got[9002].predicted == 0


def test_empty(spark):
    docs, labels = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.learn(docs, labels) == toxicity.Lexicon()
    assert toxicity.score(docs, toxicity.Lexicon()).count() == 0


def reading(folded, shown, start, word):
    """Whether the word can be read at a place: as it stands, or in another way."""
    end = start + len(word)
    if end > len(folded) or toxicity.coarse(folded)[start:end] != toxicity.coarse(word):
        return None
    return folded[start:end] == word or (None if not toxicity.spells(shown[start:end], word) else False)


def naive(text, lexicon):
    """The three features by trying every term and phrase at every place."""
    shown = toxicity.plain(text)
    folded = toxicity.DISGUISED.sub(toxicity.letters, shown)
    hits, spans = [], []
    for start in range(len(folded)):
        if start and toxicity.coarse(folded)[start - 1].isalpha():
            continue
        for term, weight in lexicon.weights.items():
            word = toxicity.fold(term.removesuffix("*"))
            end = start + len(word)
            same = reading(folded, shown, start, word)
            if same is not None and (term.endswith("*") or end == len(folded) or not folded[end].isalpha()):
                hits.append((start, end, word, weight, same))
        for phrase in lexicon.exceptions:
            at = start
            for i, word in enumerate(phrase.split()):
                gap = len(folded[at:]) - len(folded[at:].lstrip(" \t\n\r\x0b\f\x1c\x1d\x1e\x1f\x85\xa0-\u2010\u2014"))
                if i and not gap or reading(folded, shown, at + (gap if i else 0), toxicity.fold(word)) is None:
                    at = None
                    break
                at += (gap if i else 0) + len(word)
            if at and (at == len(folded) or not toxicity.coarse(folded)[at].isalpha()):
                spans.append((start, at))
    hits = [h for h in hits if not any(a <= h[0] and h[1] <= b for a, b in spans)]
    best = {}
    for start, _, _, weight, _ in hits:
        best[start] = max(best.get(start, 0), weight)
    plainly = {h[0] for h in hits if h[4]}
    kinds = {h[2][:4] for h in hits if h[4] or h[0] not in plainly}
    words = max(1, len(re.findall("[^\x20\x09-\x0d]+", shown)))
    return np.log1p(sum(best.values())), len(kinds) ** 0.5, np.log1p(100 * sum(best.values()) / words)


def test_white_space_between_words_changes_nothing():
    for text in ("you are an idiot", "a moron and scum here"):
        for space in (" " * 5000, "\t", "\n\r\n", "\x0b \f"):
            assert feats(text.replace(" ", space)) == feats(text) == feats(space + text + space)
    assert feats("idiot " + "word\t" * 500)[2] < feats("idiot word")[2]
    for phrase in ("trash-can", "TRASH  can", "trash\n\tcans", "tra5h \u2014 can", "class - clown"):
        assert feats(phrase) == (0.0, 0.0, 0.0)
    assert feats("trashcan idiot can")[0] > 0 and feats("trash, can")[0] > 0 and feats("trash cannot")[0] > 0


def test_matcher_is_a_naive_scan():
    rng = random.Random(8)
    weights = {t: 1.0 + i / 7 for i, t in enumerate(toxicity.SEED_TERMS)} | {"idio*": 2.0, "imbec*": 1.5, "fail": 3.0, "fall*": 2.5}
    lexicon = toxicity.Lexicon(weights=weights)
    read = lexicon.matcher()
    parts = [*toxicity.SEED_TERMS, *toxicity.EXCEPTIONS, "fail", "falling", "garden", "trash", "ioser", "30$", "1", "É", "ſ"]
    disguise = {"o": "0", "i": "1", "l": "1", "e": "3", "a": "@", "s": "$", "t": "7", "c": "с", "p": "р"}
    some = 0
    for _ in range(1500):
        text = "".join(rng.choice(parts) + rng.choice([" ", "", "s ", "!", "\n", "\u200b", "x", "  ", "-"]) for _ in range(rng.randrange(7)))
        text = "".join(disguise.get(c, c) if rng.random() < 0.2 else c.upper() if rng.random() < 0.1 else c for c in text)
        assert np.allclose(read(text), naive(text, lexicon)), text
        some += read(text)[0] > 0
    assert 300 < some < 1400


def test_repeated_rows_long_texts_and_clashing_columns(spark):
    long = "plain words here " * 60_000
    rows = [(1, long, 9.0, "p"), (1, long, 9.0, "p"), (2, long + "idiot moron scum " * 3000, 9.0, "p"), (3, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double, predicted string")
    got = toxicity.score(docs, toxicity.Lexicon()).collect()
    assert toxicity.score(docs, toxicity.Lexicon()).columns == ["doc_id", "text", "score", "predicted"] and len(got) == 4
    by = {r.doc_id: r.predicted for r in got}
    assert by == {1: 0, 2: 1, 3: 0}
    model = quality.fit(np.zeros((0, 1)), np.zeros(0))
    assert quality.score(docs, model).columns == ["doc_id", "text", "score", "predicted"] and quality.score(docs, model).count() == 4
