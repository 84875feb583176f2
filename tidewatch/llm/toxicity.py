"""Toxicity by a weighted lexicon.

Texts are folded: lower case, marks and look-alike letters to plain ones, digits and signs that stand for letters to
those letters. Digits and signs at a word's end may stand for letters or not, 1 for i or l: both readings are
tried. One Aho-Corasick pass finds terms and exception phrases; a term counts as a whole word, or as a word's
beginning if it is a stem, and not within an exception phrase. The score is a logistic function of the
weight found, of the number of different terms and of the weight for each hundred words (runs of anything but white space).

Weights are log odds, learned from labelled rows: words and word beginnings whose association with the label
is beyond doubt (a likelihood-ratio test). Near copies of a labelled text count once there, so words of one much
copied text don't become terms. Fitting takes at most `sample_rows` labelled rows, chosen by a hash of doc_id, which bounds the terms, too: one
needs several toxic texts of these rows. All terms beyond doubt are in the lexicon.

Exception phrases come from a file, a phrase a line; their words may stand apart by any white space, hyphens or dashes.

Defined results: null, empty and termless texts have the score of a text without terms. Labels that are
null or for absent documents are ignored. Without usable labels the seed lexicon and default
coefficients hold. Repeated rows are scored each. Texts are read whole; extra columns are carried, but for ones named score
or predicted, which the results replace. An empty table gives no rows.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from importlib.resources import files

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.quality import learnable
from tidewatch.llm.shelf import Shelf
from tidewatch.llm.textops import SPACE

SAMPLE_ROWS, THRESHOLD = 40_000, 0.7
SEED_TERMS = ("idiot", "moron", "stupid", "loser", "pathetic", "worthless", "scum", "trash", "disgusting", "clown", "imbecile", "vermin", "bastard", "asshole", "bitch", "retard")
EXCEPTIONS = tuple(line.strip() for line in files(__package__).joinpath("toxic_exceptions.txt").read_text(encoding="utf-8").splitlines() if line.strip() and not line.startswith("#"))
#: What may stand between an exception phrase's words.
APART = r"[\s\-\u2010-\u2015]+"
SEED_WEIGHT, STEMS, STEM_MARK = 5.0, (4, 5, 6, 7, 8), "*"
#: Least likelihood ratio (twice its logarithm) and least log odds of a term.
LEAST_RATIO, LEAST_WEIGHT = 25.0, 2.5

#: Terms that a task counts before it hands them on.
COUNTED_TERMS = 50_000

#: Letters of other scripts that look like a Latin one (or like a digit that stands for one).
LOOK_ALIKE = {
    "3": "з",
    "a": "аαɑ",
    "b": "бвβ",
    "c": "сϲ",
    "d": "ԁđ",
    "e": "еёҽεє",
    "f": "ƒ",
    "g": "ɡ",
    "h": "нһ",
    "i": "іїιıɩ",
    "j": "јϳ",
    "k": "кκ",
    "l": "łӏ",
    "m": "м",
    "n": "ηոп",
    "o": "оοøօ",
    "p": "рρ",
    "q": "ԛ",
    "r": "г",
    "s": "ѕ",
    "t": "тτ",
    "u": "ийυս",
    "v": "νѵ",
    "w": "ԝωѡ",
    "x": "хχ",
    "y": "уγү",
}
#: Digits and signs that stand for letters.
STANDS_FOR = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s"}
DISGUISED = re.compile(r"[0134578@$]+(?=[^\W\d_])")
#: The same after a letter, where no letter follows.
TRAILING = re.compile(r"[0134578@$](?<=[^\W\d_].)[0134578@$]*")
HIDDEN = dict.fromkeys([0xAD, *range(0x200B, 0x2010), 0x2060, 0xFEFF, *range(0x300, 0x370)])


def _fold_table() -> dict[int, str | None]:
    table: dict[int, str | None] = {}
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00), *range(0xFF01, 0xFF5F), *range(0x1D400, 0x1D800)]:
        plain = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c)).lower()
        if plain and plain != chr(code):
            table[code] = plain
    return table | {ord(c): letter for letter, others in LOOK_ALIKE.items() for c in others} | HIDDEN


FOLD = _fold_table()


def plain(text: str) -> str:
    """The text with case, marks and look-alikes taken back to plain letters."""
    text = text.lower()
    return text if text.isascii() else text.translate(FOLD)


def letters(m: re.Match) -> str:
    return "".join(map(STANDS_FOR.__getitem__, m[0]))


def fold(text: str) -> str:
    """The plain text with stand-ins before letters taken back to letters."""
    return DISGUISED.sub(letters, plain(text))


def coarse(folded: str) -> str:
    """A folded text with stand-ins after letters taken back too, and l as i: what any reading of it shares, at the same places."""
    return TRAILING.sub(letters, folded).replace("l", "i")


def spells(shown: str, word: str) -> bool:
    """Whether the plain text shown can be read as the word."""
    return all(c == w or STANDS_FOR.get(c) == w or (c == "1" and w == "l") for c, w in zip(shown, word, strict=True))


def count_words(text: str) -> int:
    """Runs of anything but white space (0x20, 0x09 to 0x0D)."""
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    solid = ~SPACE[data]
    return int(np.count_nonzero(solid[1:] & ~solid[:-1])) + bool(len(solid) and solid[0])


@dataclass
class Lexicon:
    """Terms (a stem ends in an asterisk) with weights, exception phrases, and the score's coefficients."""

    weights: dict[str, float] = field(default_factory=lambda: dict.fromkeys(SEED_TERMS, SEED_WEIGHT))
    exceptions: tuple[str, ...] = EXCEPTIONS
    intercept: float = -4.0
    slopes: tuple[float, float, float] = (1.2, 0.8, 0.5)

    def matcher(self):
        """A function from a text to its three features."""
        automaton = ahocorasick.Automaton()
        kinds: dict[str, list] = {}
        for term, weight in self.weights.items():
            word = fold(term.removesuffix(STEM_MARK))
            kinds.setdefault(coarse(word), []).append((word, weight, term.endswith(STEM_MARK)))
        phrases = [[fold(w) for w in re.split(APART, phrase)] for phrase in self.exceptions]
        patterns = [re.compile(APART.join(f"({re.escape(coarse(w))})" for w in words) + r"(?![^\W\d_])") for words in phrases]

        @lru_cache(maxsize=None)
        def about(term: str) -> list[int]:
            """The exception phrases that a term can stand in."""
            return [i for i, words in enumerate(phrases) if any(w.startswith(term) for w in words)]

        def excepted(shown: str, text: str, read: str, terms: set[str]) -> list[tuple[int, int]]:
            """Where exception phrases stand."""
            spans = []
            for i in {i for term in terms for i in about(term)}:
                for m in patterns[i].finditer(read):
                    start = m.start()
                    said = all(text.startswith(w, m.start(g)) or spells(shown[m.start(g) : m.end(g)], w) for g, w in enumerate(phrases[i], 1))
                    if said and not (start and read[start - 1].isalpha()):
                        spans.append(m.span())
            return spans

        for text, found in kinds.items():
            automaton.add_word(text, (len(text), found))
        if kinds:
            automaton.make_automaton()

        def features(text: str) -> tuple[float, float, float]:
            shown = plain(text)
            text = DISGUISED.sub(letters, shown)
            read = coarse(text)
            hits = []
            for end, (size, found) in automaton.iter(read) if kinds else ():
                start = end - size + 1
                if start and read[start - 1].isalpha():
                    continue
                whole = end + 1 == len(text) or not text[end + 1].isalpha()
                for word, weight, stem in found:
                    if not (whole or stem):
                        continue
                    same = text.startswith(word, start)
                    if not same and not spells(shown[start : end + 1], word):
                        continue
                    hits.append((start, end, word, weight, same))
            if hits:
                spans = excepted(shown, text, read, {h[2] for h in hits})
                hits = [h for h in hits if not any(a <= h[0] and h[1] < b for a, b in spans)]
            best: dict[int, float] = {}
            for start, _, _, weight, _ in hits:  # of a word and its stems the heaviest counts
                best[start] = max(best.get(start, 0.0), weight)
            total = sum(best.values())
            first = {h[0] for h in hits if h[4]}  # another reading of a term that is found as it stands is no second term
            different = {h[2][:4] for h in hits if h[4] or h[0] not in first}
            return float(np.log1p(total)), float(len(different)) ** 0.5, float(np.log1p(100 * total / max(1, count_words(shown)))) if total else 0.0

        return features

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.intercept + x @ np.array(self.slopes), -30, 30)))


def _terms(text: str) -> set[str]:
    words = set(re.findall(r"[^\W\d_]+", fold(text)))
    return words | {w[:n] + STEM_MARK for w in words for n in STEMS if len(w) > n}


def _marks(text: str) -> list[str]:
    """Two hashes that near copies of a text mostly have in common: the least of its word triples under two orders."""
    words = text.split()
    triples = {" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))}
    return [min(hash_text(t, seed) for t in triples) for seed in ("a", "b")]


def hash_text(text: str, seed: str) -> str:
    import hashlib

    return hashlib.blake2b((seed + text).encode(), digest_size=8).hexdigest()


def learn(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Lexicon:
    """A lexicon with weights and coefficients from the learnable labels of docs."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = [_marks(t or "") for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array([m[0] for m in marks], pa.string()), pa.array([m[1] for m in marks], pa.string())], names=["doc_id", "label", "text", "m1", "m2"])

    def counted(seen: tuple[Counter, Counter]) -> pa.RecordBatch:
        terms = list(seen[0].keys() | seen[1].keys())
        return pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), *(pa.array([c[t] for t in terms], pa.int64()) for c in seen)], names=["term", "clean", "toxic"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = (Counter(), Counter())
        for batch in batches:
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen[label].update(_terms(text or ""))
                seen[label][""] += 1
                if len(seen[0]) + len(seen[1]) > COUNTED_TERMS:  # the sums are made by Spark anyway
                    yield counted(seen)
                    seen = (Counter(), Counter())
        yield counted(seen)

    chosen = F.broadcast(learnable(labels, "toxic", 3, 1, sample_rows))  # at most sample_rows rows
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(chosen, "doc_id").select("doc_id", "label", "text")
    marked = known.mapInArrow(mark, "doc_id long, label int, text string, m1 string, m2 string")
    once = marked.groupBy("label", "m1").agg(F.min_by(F.struct("text", "m2", "doc_id"), "doc_id").alias("d")).groupBy("label", "d.m2").agg(F.min_by("d.text", "d.doc_id").alias("text"))
    counts = once.select("label", "text").mapInArrow(count, "term string, clean long, toxic long").groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    counts = Shelf(docs.sparkSession, "toxicity").put(counts.where("term = '' OR toxic > 1"))  # a term of one toxic text is never beyond doubt
    sizes = counts.where("term = ''").first()
    if sizes is None or not sizes.clean or not sizes.toxic:
        return Lexicon()
    n0, n1 = float(sizes.clean), float(sizes.toxic)
    rate = n1 / (n0 + n1)
    toxic, clean, both = F.col("toxic"), F.col("clean"), F.col("toxic") + F.col("clean")
    ratio = 2 * (toxic * F.log(toxic / (both * rate)) + F.when(clean > 0, clean * F.log(clean / (both * (1 - rate)))).otherwise(0.0))
    weight = F.log((toxic + 0.5) / (n1 + 1)) - F.log((clean + 0.5) / (n0 + 1))
    strong = counts.where("term != '' AND toxic > 0").withColumns({"ratio": ratio, "weight": weight}).where((F.col("ratio") >= LEAST_RATIO) & (F.col("weight") >= LEAST_WEIGHT))
    rows = strong.select("term", "weight", "toxic").collect()  # as many as sample_rows texts can put beyond doubt
    lexicon = Lexicon(weights=dict.fromkeys(SEED_TERMS, SEED_WEIGHT / 2) | _telling({r.term: (float(r.weight), r.toxic) for r in sorted(rows)}))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = lexicon.matcher()
        for batch in batches:
            rows = [read(t or "") for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.list_(pa.float64()))], names=["doc_id", "label", "x"])

    rows = sorted(known.mapInArrow(features, "doc_id long, label int, x array<double>").collect())
    x, y = np.array([r.x for r in rows]).reshape(-1, 3), np.array([r.label for r in rows], dtype=float)
    lexicon.intercept, lexicon.slopes = _logistic(x, y)
    return lexicon


def _telling(found: dict[str, tuple[float, int]]) -> dict[str, float]:
    """Words, and those stems that say more than a single word or a longer stem."""
    most: dict[str, float] = {}  # of each stem: the texts that one word, or nine tenths of those that a longer stem, must fall short of
    for term, (_, texts) in found.items():
        word, longer = term.removesuffix(STEM_MARK), term.endswith(STEM_MARK)
        for n in STEMS:
            if len(word) > n:
                key = word[:n] + STEM_MARK
                most[key] = max(most.get(key, 0.0), texts * (1 / 0.9 if longer else 1.5))
    return {term: weight for term, (weight, texts) in found.items() if not term.endswith(STEM_MARK) or texts > most.get(term, 0.0)}


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, steps: int = 60) -> tuple[float, tuple[float, float, float]]:
    """Damped Newton steps for a logistic regression whose slopes are kept at zero or above."""
    a = np.column_stack([np.ones(len(x)), x])
    w, penalty = np.zeros(a.shape[1]), np.diag([1e-6, *[ridge] * x.shape[1]])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        gradient = a.T @ (y - p) - penalty @ w
        w = w + 0.7 * np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + penalty + 1e-6 * np.eye(len(w)), gradient)
        w[1:] = np.maximum(w[1:], 0)
    return float(w[0]), tuple(map(float, w[1:]))


def score(docs: DataFrame, lexicon: Lexicon, threshold: float = THRESHOLD) -> DataFrame:
    """docs with score and predicted appended; columns of these names are replaced."""
    docs = docs.drop("score", "predicted")
    at, names = docs.columns.index("text"), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = lexicon.matcher()
        for batch in batches:
            s = lexicon.score(np.array([read(t or "") for t in batch.column(at).to_pylist()]).reshape(-1, 3))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=[*names, "score", "predicted"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{kinds}, score double, predicted int")
