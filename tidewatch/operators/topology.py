"""Topology of a run, inferred from its events: pipeline rows, nodes, instances, edges and totals."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.operators.globs import glob_join

#: Pipeline states by rank; a node shows the highest of its rows.
STATES = ("NotStarted", "Completed", "Idle", "InProgress", "Active", "Errored")
RECENT_SECONDS = 15


def done() -> Column:
    return F.col("Finish").isNotNull()


def failed() -> Column:
    return F.coalesce(F.col("Error") != "", F.lit(False))


def latest_time(events: DataFrame) -> Column:
    """The latest finish or start, as a scalar subquery."""
    return events.agg(F.max(F.coalesce("Finish", "Start")).alias("t")).scalar()


def state(errors: Column, recent: Column, in_progress: Column, finished: Column) -> Column:
    return F.when(errors > 0, "Errored").when(recent > 0, "Active").when(in_progress > 0, "InProgress").when(finished > 0, "Completed").otherwise("Idle")


def state_rank(c: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, STATES)), c) - 1


def pipeline_rows(events: DataFrame) -> DataFrame:
    """Counts, progress, throughput and state of each service's pipelines."""
    marked = events.withColumn("recent", F.coalesce(F.unix_seconds(latest_time(events).cast("timestamp")) - F.unix_seconds(F.col("Finish").cast("timestamp")) <= RECENT_SECONDS, F.lit(False)))
    rows = marked.groupBy("Service", "Pipeline").agg(F.count_if(done()).alias("done"), F.count_if(~done()).alias("in_progress"), F.count_if(failed()).alias("errors"), F.count_if("recent").alias("recent"))
    ratio = lambda a, b: F.least(F.greatest(F.coalesce(F.try_divide(a, b), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    d, p = F.col("done"), F.col("in_progress")
    return rows.select("Service", "Pipeline", "done", "in_progress", "errors", F.round(ratio(d, d + p), 6).alias("progress"), F.round(ratio(F.col("recent"), d), 6).alias("throughput"), state(F.col("errors"), F.col("recent"), p, d).alias("state"))


def instances(events: DataFrame) -> DataFrame:
    """Counts and the last activity of each process in a pipeline."""
    return events.groupBy("Service", "Pipeline", "Server", "ProcessId").agg(F.count_if(done()).alias("done"), F.count_if(~done()).alias("in_progress"), F.count_if(failed()).alias("errors"), F.max(F.coalesce("Finish", "Start")).alias("last_activity"))


def nodes(events: DataFrame) -> DataFrame:
    """Services with the number of their processes and the highest state of their pipelines."""
    count = events.groupBy("Service").agg(F.countDistinct("Server", "ProcessId").alias("instances"))
    head = pipeline_rows(events).groupBy("Service").agg(F.max(state_rank(F.col("state"))).alias("r"), F.count("*").alias("pipelines"))
    return count.join(head, "Service").select("Service", "instances", "pipelines", F.element_at(F.array(*map(F.lit, STATES)), (F.col("r") + 1).cast("int")).alias("header_state"))


def hops(events: DataFrame) -> DataFrame:
    """Changes of place of each chunk: from the place of its event before to that of the next."""
    order = Window.partitionBy("Name").orderBy("Start", "Id")
    here = F.struct("Service", "Pipeline")
    moved = events.select("Name", here.alias("to"), F.lag(here).over(order).alias("from")).where("from IS NOT NULL AND from != to")
    return moved.select("Name", F.col("from.Service").alias("source"), F.col("from.Pipeline").alias("source_pipeline"), F.col("to.Service").alias("target"), F.col("to.Pipeline").alias("target_pipeline"))


EDGE = ("source", "source_pipeline", "target", "target_pipeline")


def moves_and_places(events: DataFrame) -> DataFrame:
    """For each pair of places (EDGE) the hops between them, and as `both` the chunks done at the source that were also seen at the target.

    source = target counts all chunks done there. One shuffle by chunk gives both: a chunk's places are collected, of which there are no
    more than pipelines, and go out with its first event.
    """
    order = Window.partitionBy("Name").orderBy("Start", "Id")
    here, none = F.struct("Service", "Pipeline"), F.lit(0).cast("long")
    marked = events.select(
        here.alias("to"),
        F.lag(here).over(order).alias("from"),
        F.row_number().over(order).alias("k"),
        F.collect_set(F.struct("Service", "Pipeline", done().alias("done"))).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("places"),
    )
    place = lambda p: F.struct(p["Service"].alias("Service"), p["Pipeline"].alias("Pipeline"))
    item = lambda a, b, hop: F.struct(a["Service"].alias("source"), a["Pipeline"].alias("source_pipeline"), b["Service"].alias("target"), b["Pipeline"].alias("target_pipeline"), (none + hop).alias("hops"), (none + 1 - hop).alias("both"))
    seen = F.array_distinct(F.transform("places", place))
    pairs = F.flatten(F.transform(F.filter("places", lambda p: p["done"]), lambda a: F.transform(seen, lambda b: item(a, b, 0))))
    moved = F.filter(F.array(item(F.col("from"), F.col("to"), 1)), lambda _: F.coalesce(F.col("from") != F.col("to"), F.lit(False)))
    items = F.explode(F.when(F.col("k") == 1, F.concat(moved, pairs)).otherwise(moved))
    return marked.select(items.alias("i")).select("i.*").groupBy(*EDGE).agg(F.sum("hops").alias("hops"), F.sum("both").alias("both"))


def edges(events: DataFrame) -> DataFrame:
    """Hops counted by edge, with the chunks done at the source but not seen at the target, and the source's state.

    Waiting is the source's done chunks less those also seen at the target, so the edge's chunks are never listed. What is done at a source is
    one of the counted pairs, so the chunks are gone through once.
    """
    zero = F.lit(0).cast("long")
    own = F.when((F.col("source") == F.col("target")) & (F.col("source_pipeline") == F.col("target_pipeline")), F.col("both"))
    counted = moves_and_places(events).withColumn("at_source", F.max(own).over(Window.partitionBy("source", "source_pipeline")))  # a row for each pair of places
    rows = pipeline_rows(events).select(F.col("Service").alias("source"), F.col("Pipeline").alias("source_pipeline"), "state")
    joined = counted.where("hops > 0").join(rows, ["source", "source_pipeline"], "left")
    return joined.select(*EDGE, F.col("hops").alias("done"), (F.coalesce("at_source", zero) - F.col("both")).alias("waiting"), F.coalesce("state", F.lit("NotStarted")).alias("state"))


#: Events of a bucket of chunks, and buckets of a task.
BUCKET_EVENTS, TASK_BUCKETS = 100_000, 4


def chunk_buckets(events: int) -> int:
    """Buckets for so many events, so that a bucket doesn't grow with the table."""
    return max(8, -(-events // BUCKET_EVENTS))


def chunk_bitmaps(events: DataFrame, buckets: int = 64) -> DataFrame:
    """Bitmaps of the chunks of each place: Service, Pipeline, piece, and as bits of chunk numbers seen and done.

    Chunks are numbered within buckets of their names' hashes, so no numbering goes through one task; a bitmap is 32,768 numbers of one bucket. A task has
    few buckets: with `chunk_buckets` there are as many more tasks as there are more events, and one shuffle brings events to them.
    """
    dealt = events.select("Name", "Service", "Pipeline", done().alias("done"), F.pmod(F.xxhash64("Name"), F.lit(buckets)).alias("bucket")).where(F.col("Name").isNotNull())
    dealt = dealt.repartition(max(8, -(-buckets // TASK_BUCKETS)), "bucket")
    number = F.dense_rank().over(Window.partitionBy("bucket").orderBy("Name")).cast("long")
    rows = dealt.groupBy("bucket", "Name", "Service", "Pipeline").agg(F.max("done").alias("done")).withColumn("n", number)
    at = F.bitmap_bit_position("n")
    bits = rows.groupBy("Service", "Pipeline", F.struct("bucket", F.bitmap_bucket_number("n").alias("b")).alias("piece"))
    return bits.agg(F.bitmap_construct_agg(at).alias("seen"), F.bitmap_construct_agg(F.when(F.col("done"), at)).alias("done"))


def waiting(edges: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """Edges (EDGE) with the chunks done at the source and not seen at the target, by counting bits.

    A chunk that visits many places sets a bit for each, where pairs of its places would be their square; work goes by edges and pieces of bitmaps.
    """
    bits = bitmaps.select("Service", "Pipeline", "piece", "seen", "done")
    own = edges.select(*EDGE).join(bits.select(F.col("Service").alias("source"), F.col("Pipeline").alias("source_pipeline"), "piece", F.col("done").alias("bits")), ["source", "source_pipeline"])
    other = edges.select(*EDGE).join(bits.select(F.col("Service").alias("target"), F.col("Pipeline").alias("target_pipeline"), "piece", F.col("seen").alias("bits")), ["target", "target_pipeline"])
    of_source = own.groupBy(*EDGE).agg(F.sum(F.bitmap_count("bits")).alias("at_source"))
    both = own.unionByName(other).groupBy(*EDGE, "piece").agg(F.count("*").alias("sides"), F.bitmap_count(F.bitmap_and_agg("bits")).alias("n")).where("sides = 2")
    met = both.groupBy(*EDGE).agg(F.sum("n").alias("both"))
    zero = F.lit(0).cast("long")
    return of_source.join(met, list(EDGE), "left").select(*EDGE, (F.col("at_source") - F.coalesce("both", zero)).alias("waiting"))


def summary(events: DataFrame) -> DataFrame:
    """One row: chunks, events, events done and in progress, and the estimated progress. A chunk's places are no more than pipelines."""
    per_name = events.groupBy("Name").agg(F.size(F.collect_set(F.struct("Service", "Pipeline"))).alias("hops"), F.count("*").alias("events"), F.count_if(done()).alias("done"))
    total = per_name.agg(F.count("*").alias("chunks"), F.coalesce(F.sum("events"), F.lit(0)).alias("events"), F.coalesce(F.sum("done"), F.lit(0)).alias("done"), F.max("hops").alias("hops"))
    progress = F.least(F.coalesce(F.try_divide(F.col("done"), F.col("hops") * F.col("chunks")), F.lit(0.0)), F.lit(1.0))
    return total.select("chunks", "events", "done", (F.col("events") - F.col("done")).alias("in_progress"), F.round(progress, 6).alias("progress"))


def replay(events: DataFrame, until: str) -> DataFrame:
    """The events that had begun by a moment."""
    return events.where(F.col("Start") <= F.lit(until).cast("timestamp_ntz"))


def replay_range(events: DataFrame) -> DataFrame:
    return events.agg(F.min("Start").alias("first"), F.max(F.coalesce("Finish", "Start")).alias("last"))


def declared_edges(hints: DataFrame, explicit: DataFrame) -> DataFrame:
    """Edges from what services publish and other hints subscribe to, and explicit ones; the first of equal names is kept.

    hints: idx, name, publishes, subscribes; explicit: source, target, idx. Names may be globs.
    """
    published = hints.select("idx", F.col("name").alias("source"), F.explode("publishes").alias("p"))
    subscribed = hints.select(F.col("idx").alias("j"), F.col("name").alias("target"), F.explode("subscribes").alias("s"))
    order = lambda k, *c: F.struct(F.lit(k).alias("k"), *(x.cast("long").alias(n) for x, n in zip(c, "ij", strict=True))).alias("o")
    matched = published.join(subscribed, F.lower("p") == F.lower("s")).where("idx != j").select("source", "target", order(0, F.col("idx"), F.col("j")))
    named = explicit.where("trim(source) != '' AND trim(target) != ''").select("source", "target", order(1, F.col("idx"), F.lit(0)))
    first = matched.unionByName(named).groupBy(F.lower("source").alias("a"), F.lower("target").alias("b")).agg(F.min_by(F.struct("source", "target"), "o").alias("e"))
    return first.select("e.source", "e.target")


def plain(c: Column) -> Column:
    return c


Label = Callable[[Column], Column]


def blueprint_nodes(observed: DataFrame, hints: DataFrame, label: Label = plain) -> DataFrame:
    """Observed services with the first hint whose name or glob fits their label, and declared services, no globs, that were not observed.

    Labels without regard to case. observed: id; hints: idx, name, role, grp.
    """
    ids = observed.select("id").distinct()
    found = glob_join(ids, label(F.col("id")), hints.select("idx", "name", "role", "grp"), "name").groupBy("id").agg(F.min_by(F.struct("role", "grp"), "idx").alias("h"))
    seen = ids.join(found, "id", "left").select("id", F.col("h").isNotNull().alias("is_declared"), F.lit(True).alias("is_observed"), "h.role", "h.grp")
    literal = hints.where(~F.col("name").rlike("[*?]")).groupBy(F.lower("name").alias("low")).agg(F.min_by(F.struct("name", "role", "grp"), "idx").alias("h"))
    unseen = literal.join(observed.select(F.lower(label(F.col("id"))).alias("low")), "low", "left_anti")
    return seen.unionByName(unseen.select(F.col("h.name").alias("id"), F.lit(True).alias("is_declared"), F.lit(False).alias("is_observed"), "h.role", "h.grp"))


def resolved_edges(nodes: DataFrame, declared: DataFrame, label: Label = plain) -> DataFrame:
    """Declared edges between the nodes (id) whose labels their ends' names or globs fit, without loops: source, target."""
    ends = declared.select("source").union(declared.select("target")).distinct().select(F.col("source").alias("name"))
    fit = glob_join(nodes.select("id"), label(F.col("id")), ends, "name")
    end = lambda c: fit.select(F.col("name").alias(c), F.col("id").alias(f"{c}_id"))
    pairs = declared.join(end("source"), "source").join(end("target"), "target").where("lower(source_id) != lower(target_id)")
    return pairs.groupBy(F.lower("source_id").alias("a"), F.lower("target_id").alias("b")).agg(F.min(F.struct("source_id", "target_id")).alias("e")).select(F.col("e.source_id").alias("source"), F.col("e.target_id").alias("target"))


def blueprint_edges(observed: DataFrame, nodes: DataFrame, declared: DataFrame, label: Label = plain) -> DataFrame:
    """Observed edges flagged if declared between their services, and declared edges between nodes that were not observed. nodes: id, seen or declared."""
    wanted = resolved_edges(nodes, declared, label).select(F.lower("source").alias("a"), F.lower("target").alias("b"), F.col("source").alias("from"), F.col("target").alias("to"))
    keyed = observed.select(*EDGE, F.lower("source").alias("a"), F.lower("target").alias("b"))
    both = keyed.join(wanted, ["a", "b"], "full_outer")
    ends = [F.coalesce("source", "from").alias("source"), F.coalesce("source_pipeline", F.lit("")).alias("source_pipeline"), F.coalesce("target", "to").alias("target"), F.coalesce("target_pipeline", F.lit("")).alias("target_pipeline")]
    return both.select(*ends, F.col("from").isNotNull().alias("is_declared"), F.col("source").isNotNull().alias("is_observed"))


def variant(observed: DataFrame, variants: DataFrame) -> DataFrame:
    """The first variant of which some observed service fits the glob; null, so the default, if none does. variants: idx, any_service."""
    globs = variants.where("trim(any_service) != ''").select("idx", "any_service")
    return glob_join(observed.select("id"), F.col("id"), globs, "any_service").agg(F.min("idx").alias("variant"))


def group_colours(groups: DataFrame) -> DataFrame:
    """The last colour declared for each group name, without regard to case; blank names and colours count for nothing. groups: idx, name, color."""
    return groups.where("trim(name) != '' AND trim(color) != ''").groupBy(F.lower("name").alias("grp")).agg(F.max_by("color", "idx").alias("color"))
