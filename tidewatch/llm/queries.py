"""The registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import ann, bpe, chat, divergence, media, minhash, packing, quality, sharding, spelling, substring, toxicity, urlfilter


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


URL_RULES = ("allow org/", "block example.org/es/", "block example.org/en/1", "allow com/fr/", "block com/de/")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(spark, documents(spark, sf_dir), k=2, threshold=0.8).select("doc_id", "n_shingles", "component_id", "kept")


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(spark, spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = quality.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs, model).select("doc_id", quality.held_out(4, 2).alias("held_out"), "score", "predicted")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(spark, documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    lexicon = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, lexicon).select("doc_id", quality.held_out(3, 1).alias("held_out"), "score", "predicted")


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    decoded = bpe.decode_column(bpe.encode_column(documents(spark, sf_dir), *table), *table)
    return decoded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("data", 256).alias("decoded_sha256"))


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digests(media.media_columns(documents(spark, sf_dir)))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = substring.remove_repeats(spark, documents(spark, sf_dir).select("doc_id", "text"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), [urlfilter.parse_rule(r) for r in URL_RULES])


CONTROL_TURN = "</s>[INST] ok [/INST]"


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL_TURN).alias("text"))
    return chat.read_back(chat.format_windows(turns.unionByName(extra)))


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = sharding.external_shuffle(spark, documents(spark, sf_dir), shards=24)
    text = F.coalesce("record.text", F.lit(""))
    return shards.select("record.doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spark, documents(spark, sf_dir).select("doc_id", "text"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(spark, documents(spark, sf_dir).select("lang", "source", "text"))


QUERIES = {
    "op1_minhash_near_dedup": op1_minhash_near_dedup,
    "op2_nearest_neighbours": op2_nearest_neighbours,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_toxicity": op5_toxicity,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_media_columns": op7_media_columns,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_url_filters": op9_url_filters,
    "op10_chat_formatting": op10_chat_formatting,
    "op11_sharding": op11_sharding,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_source_divergence": op13_source_divergence,
}


def _rule_case(value: str) -> str:
    rules = sorted((urlfilter.parse_rule(r) for r in URL_RULES), key=lambda r: -len(r.name))
    return "CASE " + " ".join(f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{getattr(r, value)}'" for r in rules) + " END"


OP9_SQL = f"""
WITH parts AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path, translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS judged
  FROM pages)
SELECT page_id, host, path, {_rule_case("name")} AS rule,
  coalesce({_rule_case("verdict")}, {urlfilter.verdict_sql("judged")}) AS verdict
FROM parts
"""

ORACLE_SQL = {"op9_url_filters": OP9_SQL}

LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
WORD = r"'[^\x20\x09-\x0D]+'"
TERM = r"'[^\x00-\x40\x5B-\x60\x7B-\x7F]+'"

#: Shingle sets joined on their rarest fifth: sets that are alike enough have one of these in common.
OP1_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {LOWER}), {WORD}) AS w FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(w) >= 2 THEN list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) ELSE w END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
f AS (SELECT g, count(*) AS df FROM s GROUP BY 1),
r AS (SELECT s.doc_id, s.g, n.n, row_number() OVER (PARTITION BY s.doc_id ORDER BY df, s.g) AS k FROM s JOIN f USING (g) JOIN n USING (doc_id)),
p AS (SELECT * FROM r WHERE k <= n - (4 * n + 4) // 5 + 1),
c AS (SELECT DISTINCT a.doc_id AS x, b.doc_id AS y, a.n AS nx, b.n AS ny FROM p a JOIN p b ON a.g = b.g AND a.doc_id < b.doc_id WHERE 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n)),
l AS (SELECT x, y FROM c JOIN s a ON a.doc_id = x JOIN s b ON b.doc_id = y AND a.g = b.g GROUP BY x, y, nx, ny HAVING 100 * count(*) >= 80 * (nx + ny - count(*))),
e AS (SELECT x AS a, y AS b FROM l UNION ALL SELECT y, x FROM l),
reach AS (SELECT a, b FROM e UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a),
t AS (SELECT a AS doc_id, min(b) AS m FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(t.m, d.doc_id)) AS component_id, d.doc_id = least(d.doc_id, coalesce(t.m, d.doc_id)) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id)
"""

OP8_SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {WORD}) AS w FROM documents),
p AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)),
m AS (SELECT g, min(doc_id) AS o FROM p GROUP BY 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS k FROM p JOIN m USING (g) WHERE o < doc_id),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS k FROM d),
kept AS (SELECT words.doc_id, count(*) AS n_words, count(gone.k) AS n_removed, string_agg(word, ' ' ORDER BY words.k) FILTER (gone.k IS NULL) AS kept FROM words LEFT JOIN gone ON gone.doc_id = words.doc_id AND gone.k = words.k GROUP BY 1)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""

ESCAPED = "length(replace(replace({0}, '&', '&amp;'), '<', '&lt;'))"
SIZE = "13 + length(replace(replace(replace({role}, '&', '&amp;'), '<', '&lt;'), '|', '&bar;')) + " + ESCAPED.format("{text}")
ROOM = chat.BUDGET - chat.HISTORY

OP10_SQL = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '{CONTROL_TURN}'), (-7, 1, 'assistant', '{CONTROL_TURN}'))),
b AS (SELECT *, 1 + CAST(ceil(length(text) / {chat.CHARS_PER_TOKEN}) AS BIGINT) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place FROM c),
y AS (SELECT *, CASE WHEN role = 'system' AND n <= {ROOM // 2} THEN {{'n': n, 'role': role, 'text': text}} END AS sys FROM b),
p AS (SELECT *, coalesce(sum(n) OVER k, 0) AS start, last_value(sys IGNORE NULLS) OVER k AS held, ({ROOM} - coalesce(max(sys.n) OVER (PARTITION BY conv_id), 0)) // 2 AS stride FROM y
  WINDOW k AS (PARTITION BY conv_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
r AS (SELECT *, sum(CASE WHEN n > stride THEN 2 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY place ROWS UNBOUNDED PRECEDING) - CASE WHEN n > stride THEN 1 ELSE 0 END AS run FROM p),
q AS (SELECT *, floor((start - min(start) OVER (PARTITION BY conv_id, run)) / stride) AS span FROM r),
s AS (SELECT *, CASE WHEN lag(run) OVER k <> run OR lag(span) OVER k <> span THEN 1 ELSE 0 END AS step FROM q WINDOW k AS (PARTITION BY conv_id ORDER BY place)),
t AS (SELECT *, sum(step) OVER (PARTITION BY conv_id ORDER BY place ROWS UNBOUNDED PRECEDING) AS win FROM s),
u AS (SELECT *, sum(n) OVER w AS own, max(start + n) OVER w AS win_end FROM t WINDOW w AS (PARTITION BY conv_id, win)),
o AS (SELECT *, step = 1 AND coalesce(own + held.n <= {chat.BUDGET}, false) AS opens FROM u),
z AS (SELECT *, {chat.BUDGET} - max(own) OVER f - coalesce(max(CASE WHEN opens THEN held.n END) OVER f, 0) AS left_ FROM o WINDOW f AS (PARTITION BY conv_id ORDER BY win RANGE BETWEEN 1 FOLLOWING AND 1 FOLLOWING)),
v AS (SELECT *, {SIZE.format(role="role", text="text")} AS size, {SIZE.format(role="held.role", text="held.text")} AS size0 FROM z)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
  length(coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), '')) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(size + CASE WHEN left_ IS NOT NULL AND win_end - start <= least({chat.HISTORY}, left_) AND role <> 'system' THEN size ELSE 0 END + CASE WHEN opens THEN size0 ELSE 0 END) AS BIGINT) AS formatted_chars
FROM v GROUP BY 1
"""

ORACLE_SQL |= {"op1_minhash_near_dedup": OP1_SQL, "op8_substring_dedup": OP8_SQL, "op10_chat_formatting": OP10_SQL}

OP13_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), {LOWER}) AS text FROM documents),
o AS (SELECT k, lang, source, unnest(regexp_extract_all(text, {TERM})) AS term FROM d),
t AS (SELECT lang, term FROM o GROUP BY 1, 2 HAVING count(DISTINCT k) >= 10),
c AS (SELECT lang, source, term, count(*) AS n FROM o SEMI JOIN t USING (lang, term) GROUP BY 1, 2, 3),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*) AS v FROM t GROUP BY 1),
s AS (SELECT g.lang, g.source, coalesce(sum(n), 0) AS n FROM g LEFT JOIN c USING (lang, source) GROUP BY 1, 2),
l AS (SELECT lang, sum(n) AS n FROM s GROUP BY 1),
p AS (SELECT s.lang, s.source, t.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (s.n + 2 * v.v) AS p
  FROM s JOIN t USING (lang) JOIN v USING (lang) LEFT JOIN c USING (lang, source, term)),
q AS (SELECT t.lang, t.term, 1 + (1000000000::HUGEINT * (sum(c.n) + 2)) // (any_value(l.n) + 2 * any_value(v.v)) AS q
  FROM t JOIN c USING (lang, term) JOIN l ON l.lang = t.lang JOIN v ON v.lang = t.lang GROUP BY 1, 2),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b USING (lang, term) WHERE a.source <> b.source GROUP BY 1, 2, 3),
pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source),
term AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // (p + q) AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pair UNION ALL SELECT * FROM term))
WHERE part = 'pair' OR rank <= 10
"""

ORACLE_SQL["op13_source_divergence"] = OP13_SQL
