"""Corpus preparation: quality, toxicity, near duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and is written as Parquet and read again for the next one. A stage
judges only the documents that the one before has kept; labels come from the labels table in sf_dir.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.llm import minhash, packing, quality, substring, toxicity
from tidewatch.llm.shelf import Shelf
from tidewatch.session import ship_package


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def _whole(docs: DataFrame) -> DataFrame:
    """docs with all columns in one, so that names which an operator adds can't clash."""
    return docs.select(F.struct("*").alias("row"), "doc_id", "text")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the threshold."""
    ship_package(spark)
    model = quality.learn(docs.select("doc_id", "text"), _labels(spark, sf_dir))
    return quality.score(_whole(docs), model).where("predicted = 1").select("row.*")


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below the threshold."""
    ship_package(spark)
    lexicon = toxicity.learn(docs.select("doc_id", "text"), _labels(spark, sf_dir))
    return toxicity.score(_whole(docs), lexicon).where("predicted = 0").select("row.*")


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One text of each group linked by 0.8 similarity of five-word shingles, of its least doc_id.

    A doc_id with several texts has them judged each by itself. Of rows with equal doc_id and text one stays, by the order of their
    other columns. Rows without a doc_id stay.
    """
    ship_package(spark)
    found = minhash.near_duplicates(spark, docs.select("doc_id", "text"), k=5, threshold=0.8)
    kept = found.where("first AND doc_id IS NOT NULL").select("doc_id", "text_id").distinct()
    others = [F.col(f"row.`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    whole = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_id"))
    order = Window.partitionBy("doc_id", "text_id").orderBy(F.to_json(F.struct(*others)) if others else F.lit(0))
    once = whole.join(kept, ["doc_id", "text_id"], "left_semi").withColumn("place", F.row_number().over(order)).where("place = 1")
    return once.select("row.*").union(docs.where("doc_id IS NULL"))


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of 13 words that stand in an earlier one; what stays keeps its white space, and those with nothing left go."""
    ship_package(spark)
    done = substring.remove_repeats(spark, docs, spaced=True).where("n_removed < n_words OR n_words = 0")
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))
    done = done.withColumn("text", text)
    columns = {"doc_id": F.col("doc_id"), "text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return done.select(*((columns.get(c, F.col(f"row.`{c}`"))).cast(docs.schema[c].dataType).alias(c) for c in docs.columns))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences of 2048 tokens."""
    ship_package(spark)
    return packing.pack(spark, docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("quality", quality_stage),
    ("toxicity", toxicity_stage),
    ("near_dedup", near_dedup_stage),
    ("substring_dedup", substring_stage),
    ("packing", packing_stage),
]

#: Learned scores and tokenizers aren't SQL; tests hold each stage against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    shelf, docs = Shelf(spark, "pipeline"), spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = shelf.put(docs)
    return docs
