"""Layers, closures and expansion of run and service graphs, by joins to a fixpoint.

These graphs have a node for each service or run in view. Each round is a join and an aggregation, and its
result is checkpointed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.plans.lineage import cut


def forward_edges(edges: DataFrame) -> DataFrame:
    """Edges without loops; of two that are each other's reverse, the one with the smaller source."""
    plain = cut(edges.select("source", "target").where("source != target").distinct())  # read twice, and small beside what it is made of
    reverse = plain.select(F.col("target").alias("source"), F.col("source").alias("target")).where("source > target")
    return plain.join(reverse, ["source", "target"], "left_anti")


def layers(edges: DataFrame) -> DataFrame:
    """The longest path to each node from a node without incoming edges. edges: source, target.

    Nodes are peeled off when all edges into them have come from peeled ones, so a node's layer is its round, and a round goes through the edges of
    its own nodes and the nodes that wait. What is left waits in a cycle or behind one: a node there is below those of its
    sources that have a layer, and at 0 if none has.
    """
    plain = cut(edges.select("source", "target").distinct())
    into = plain.groupBy("target").agg(F.count("*").alias("wanted"))
    plain = cut(plain.join(into, "target"))
    now = cut(plain.select(F.col("source").alias("node")).distinct().join(plain.select(F.col("target").alias("node")), "node", "left_anti"))
    spark, layer = edges.sparkSession, 0
    waiting = spark.createDataFrame([], plain.select(F.col("target").alias("node"), "wanted", F.lit(0).cast("long").alias("got"), F.lit(0).alias("layer")).schema)
    done = now.select("node", F.lit(0).alias("layer"))
    while not now.isEmpty():
        layer += 1
        reached = plain.join(now, F.col("source") == F.col("node")).select(F.col("target").alias("node"), "wanted", F.lit(1).cast("long").alias("got"), F.lit(layer).alias("layer"))
        touched = cut(waiting.unionByName(reached).groupBy("node").agg(F.max("wanted").alias("wanted"), F.sum("got").alias("got"), F.max("layer").alias("layer")))
        waiting, now = touched.where("got < wanted").select("node", "wanted", "got", "layer"), touched.where("got = wanted").select("node")
        done = done.unionByName(touched.where("got = wanted").select("node", "layer"))
        if layer % 32 == 0:  # so that plans don't grow with the rounds
            done = cut(done)
    placed = done.unionByName(waiting.select("node", "layer"))
    left = plain.select(F.col("source").alias("node")).union(plain.select("target")).distinct().join(placed, "node", "left_anti")
    return placed.unionByName(left.withColumn("layer", F.lit(0)))


def pinned(layered: DataFrame, roles: DataFrame, edges: DataFrame) -> DataFrame:
    """Layers with sources first and sinks last, where no edge speaks against it. roles: node, role."""
    top = layered.agg(F.max("layer")).scalar()
    into, out = edges.select(F.col("target").alias("node")).distinct().withColumn("has_in", F.lit(True)), edges.select(F.col("source").alias("node")).distinct().withColumn("has_out", F.lit(True))
    rows = layered.join(roles, "node", "left").join(into, "node", "left").join(out, "node", "left")
    layer = F.when((F.col("role") == "source") & F.col("has_in").isNull(), 0).when((F.col("role") == "sink") & F.col("has_out").isNull(), top).otherwise(F.col("layer"))
    return rows.select("node", layer.alias("layer"))


def long_edge_stops(edges: DataFrame, layered: DataFrame) -> DataFrame:
    """A stop for each layer that an edge passes over."""
    at = lambda name: layered.select(F.col("node").alias(name), F.col("layer").alias(f"l_{name}"))
    rows = edges.join(at("source"), "source").join(at("target"), "target").where("l_target > l_source + 1")
    return rows.select("source", "target", F.explode(F.sequence(F.col("l_source") + 1, F.col("l_target") - 1)).alias("layer"))


def closure(edges: DataFrame) -> DataFrame:
    """Pairs of nodes of which the second can be reached from the first. Path lengths double each round."""
    known = cut(edges.select("source", "target").distinct())
    size = known.count()
    while True:
        half = known.select(F.col("source").alias("mid"), F.col("target").alias("end"))
        known = cut(known.union(known.join(half, known.target == half.mid).select("source", F.col("end").alias("target"))).distinct())
        if (after := known.count()) == size:
            return known
        size = after


def descendants(children: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    """Runs below the roots down to a depth. children: parent, child; roots: node."""
    level = roots.select(F.col("node").alias("root"), "node")
    out = level.withColumn("depth", F.lit(0))
    for d in range(1, depth + 1):
        level = level.join(children, level.node == children.parent).select("root", F.col("child").alias("node"))
        out = out.union(level.withColumn("depth", F.lit(d)))
    return out
