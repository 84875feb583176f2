"""URL filtering by site rules and a weighted URL vocabulary.

Host and path are cut out with SQL functions. Rules are native column expressions. Urls without a
rule are judged by one Aho-Corasick pass over the whole url: a term counts only between characters
that are no ASCII letters or digits, and once however often it stands there. A url is rejected when its terms weigh `LIMIT`
together: one strict term does, soft ones only with other terms. An asterisk before or after a term lets anything stand on that side, for hosts that
are written together. The vocabulary is a file, a parameter, or learned from a table of judged urls (`learn_terms`); urls that a rule
has decided aren't searched, and each worker builds its automaton once.

Defined results: a null, empty or malformed url (no `://`) has an empty host and path and no rule; the
vocabulary judges what text there is, and allows null and empty ones. Urls of any length are read
whole. Repeated rows give repeated rows. Extra columns of the input are not read. An empty table gives no rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache
from pathlib import Path

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The weight that rejects a url, and the file of terms.
LIMIT, TERMS = 6, str(Path(__file__).with_name("url_terms.txt"))

Vocabulary = tuple[tuple[str, int], ...]


@lru_cache(maxsize=4)
def vocabulary(path: str = TERMS) -> Vocabulary:
    """Terms with their weights from a file of lines `weight: term term ...`; of a term given twice the greatest weight counts."""
    found: dict[str, int] = {}
    for line in Path(path).read_text(encoding="utf-8").splitlines():
        weight, colon, terms = line.partition(":")
        if colon and not line.startswith("#"):
            for term in terms.lower().split():
                found[term] = max(found.get(term, 0), int(weight))
    return tuple(sorted(found.items()))


@dataclass(frozen=True)
class Rule:
    """A site rule: `host` covers itself and its subdomains, `path` is a prefix beginning with a slash."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def parse_rule(text: str) -> Rule:
    """`allow org/` or `block example.org/es/`."""
    verdict, _, site = text.strip().partition(" ")
    if verdict not in ("allow", "block") or "/" not in site:
        raise ValueError(f"not a rule: {text!r}")
    host, _, path = site.strip().partition("/")
    return Rule(verdict, host.lower(), "/" + path)


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules: list[Rule], value: str) -> Column:
    """The `value` ("name" or "verdict") of the longest rule that fits, else null."""
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.name)):  # the longest is tested first
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        found = F.when(fits, F.lit(getattr(rule, value))).otherwise(found)
    return found


@lru_cache(maxsize=4)
def automaton(terms: Vocabulary):
    """One automaton for each worker process: words with the ways in which terms ask for them (free before, free after, weight)."""
    asked: dict[str, list[tuple[bool, bool, int]]] = {}
    for term, weight in terms:
        asked.setdefault(term.strip("*"), []).append((term.startswith("*"), term.endswith("*"), weight))
    found = ahocorasick.Automaton()
    for word, ways in asked.items():
        found.add_word(word, (word, ways))
    found.make_automaton()
    return found


def weighs(text: str, terms: Vocabulary, limit: int) -> bool:
    """Whether the different words of a text that stand as their terms ask weigh the limit; of one word's terms the heaviest counts."""
    seen: dict[str, int] = {}
    for end, (word, ways) in automaton(terms).iter(text):
        start = end - len(word)
        before = start >= 0 and text[start].isascii() and text[start].isalnum()
        after = end + 1 < len(text) and text[end + 1].isascii() and text[end + 1].isalnum()
        if weight := max((n for free, open_, n in ways if (free or not before) and (open_ or not after)), default=0):
            seen[word] = max(seen.get(word, 0), weight)
            if sum(seen.values()) >= limit:
                return True
    return False


#: Judged urls that a vocabulary is learned from at most, least likelihood ratio of a term, and rejected urls for each allowed one at least.
JUDGED_ROWS, LEAST_RATIO, LEAST_ODDS = 1_000_000, 15.0, 3.0


def learn_terms(judged: DataFrame, limit: int = LIMIT, rows: int = JUDGED_ROWS) -> Vocabulary:
    """Terms from urls (url, blocked 0 or 1), at most so many of them, chosen by a hash: words beyond doubt more frequent in blocked ones.

    A word that is hardly ever allowed is strict; the odds of others make them weigh less, at least 1. The vocabulary has as many terms as the rows put beyond doubt.
    """
    some = judged.where("url IS NOT NULL AND blocked IS NOT NULL").orderBy(F.xxhash64("url"), "url").limit(rows)
    words = F.array_distinct(F.filter(F.split(ascii_lower(F.col("url")), "[^a-z0-9]+"), lambda w: F.length(w) >= 3))
    said = some.select(F.col("blocked").cast("int").alias("b"), F.explode(F.concat(words, F.array(F.lit("")))).alias("term"))
    counts = said.groupBy("term").agg(F.sum("b").alias("bad"), F.sum(1 - F.col("b")).alias("good"))
    sizes = counts.where("term = ''").first()
    if sizes is None or not sizes.bad or not sizes.good:
        return ()
    bad, good, rate = F.col("bad"), F.col("good"), sizes.bad / (sizes.bad + sizes.good)
    both = bad + good
    ratio = 2 * (bad * F.log(bad / (both * rate)) + F.when(good > 0, good * F.log(good / (both * (1 - rate)))).otherwise(0.0))
    odds = ((bad + 0.5) / (sizes.bad + 1)) / ((good + 0.5) / (sizes.good + 1))
    weight = F.least(F.greatest(F.floor(F.log(2.0, odds)), F.lit(1)), F.lit(limit)).cast("int")
    strong = counts.where("term != '' AND bad > 1").withColumns({"ratio": ratio, "odds": odds}).where((F.col("ratio") >= LEAST_RATIO) & (F.col("odds") >= LEAST_ODDS))
    return tuple(sorted((r.term, r.weight) for r in strong.select("term", weight.alias("weight")).collect()))


def vocabulary_verdict(terms: Vocabulary, limit: int):
    """A pandas UDF: text -> allow or block by the vocabulary, null for null."""

    @F.pandas_udf("string")
    def judge(texts: pd.Series) -> pd.Series:
        return pd.Series([None if text is None else "block" if terms and weighs(text, terms, limit) else "allow" for text in texts], dtype="object")

    return judge


def filter_urls(pages: DataFrame, rules: list[Rule], url: str = "url", keep: tuple[str, ...] = ("page_id",), terms: Vocabulary | None = None, limit: int = LIMIT) -> DataFrame:
    """Columns `keep`, host, path, rule (null if none fits) and verdict, one row per input row."""
    parts = pages.select(*keep, host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"), F.coalesce(ascii_lower(F.col(url)), F.lit("")).alias("_judged"))
    ruled = parts.select(*keep, "host", "path", "_judged", matching_rule(F.col("host"), F.col("path"), rules, "name").alias("rule"), matching_rule(F.col("host"), F.col("path"), rules, "verdict").alias("_ruled"))
    judge = vocabulary_verdict(vocabulary() if terms is None else terms, limit)
    return ruled.select(*keep, "host", "path", "rule", F.coalesce("_ruled", judge(F.when(F.col("_ruled").isNull(), F.col("_judged")))).alias("verdict"))


def verdict_sql(text: str, terms: Vocabulary | None = None, limit: int = LIMIT) -> str:
    """The vocabulary's verdict on a SQL text expression, for DuckDB."""
    words: dict[str, list[tuple[int, str]]] = {}
    for term, n in vocabulary() if terms is None else terms:
        word = term.strip("*")
        pattern = ("" if term.startswith("*") else "(^|[^a-z0-9])") + re.escape(word) + ("" if term.endswith("*") else "($|[^a-z0-9])")
        words.setdefault(word, []).append((n, f"regexp_matches({text}, '{pattern}')"))
    weight = " + ".join("greatest(0, " + ", ".join(f"{n} * CAST({found} AS INTEGER)" for n, found in ways) + ")" for ways in words.values())
    return f"CASE WHEN {weight} >= {limit} THEN 'block' ELSE 'allow' END"
