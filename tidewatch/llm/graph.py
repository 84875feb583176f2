"""Connected components by alternating large-star and small-star steps, as joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.shelf import Shelf


def _digest(df: DataFrame) -> tuple:
    return tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(node, component): every node of edges (u, v) but the least of each component, with that least node. Self links are ignored."""
    shelf = Shelf(spark, "components")
    now = shelf.put(edges.select(F.greatest("u", "v").alias("a"), F.least("u", "v").alias("b")).where("a > b").distinct())
    before = None
    while (digest := _digest(now)) != before and digest[0]:
        before = digest
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # the minima are dealt anew, so that Spark can split the join where a node has a great many links
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")).repartition(F.xxhash64("a"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m")).repartition(F.xxhash64("a"))
        pairs = F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))
        small = large.join(least, "a").select(F.explode(pairs).alias("p")).select("p.a", "p.b").where("a > b").distinct()
        after = shelf.put(small)
        shelf.take_off(now)
        now = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
