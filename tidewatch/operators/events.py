"""Events: upsert, resumable polling, normalising several sources, and appending to the event log."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(events: DataFrame, key: str | list[str] = "Id", time: str = "Start", arrival: str | None = None, prefer_finished: str | None = None, ties: tuple[str, ...] = ("Finish", "RecordCount")) -> DataFrame:
    """The newest row of each key by time; Spark limits each key to one row before the shuffle.

    Of rows of one time the first to arrive stays: arrival is a column that numbers them, such as a log id or `_metadata.row_index`. prefer_finished: a column;
    of rows of one time those where it isn't null come first. Without arrival ties go to the greatest values of other columns, so that results are definite.
    """
    order = [F.col(time).desc_nulls_last()]
    if prefer_finished:
        order.append(F.col(prefer_finished).isNotNull().desc())
    order += [F.col(arrival).asc()] if arrival else [F.col(c).desc_nulls_last() for c in ties]
    return events.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")


@dataclass(frozen=True)
class Cursor:
    """Where the next poll goes on."""

    last_id: int | None = None
    last_time: datetime | None = None


def since(log: DataFrame, cursor: Cursor | None, as_of: datetime | None = None, lag: timedelta = timedelta(0), id_col: str = "LogId", time_col: str = "LoggedAtUtc", time: Column | None = None) -> DataFrame:
    """Log rows after the cursor, by id or by a time, without those so young that earlier ids may still be written."""
    rows = log
    if cursor is not None and cursor.last_id is not None:
        rows = rows.where(F.col(id_col) > cursor.last_id)
    if cursor is not None and cursor.last_time is not None and time is not None:
        rows = rows.where(time > F.lit(cursor.last_time).cast("timestamp_ntz"))
    return rows.where(F.col(time_col) < F.lit(as_of - lag).cast("timestamp_ntz")) if as_of and lag else rows


def advance(batch: DataFrame, cursor: Cursor | None, id_col: str | None = "LogId", time: Column | None = None) -> Cursor:
    """The cursor after a batch; an empty batch leaves it."""
    row = batch.agg(F.max(id_col).alias("i") if id_col else F.lit(None).alias("i"), F.max(time).alias("t") if time is not None else F.lit(None).alias("t")).first()
    return cursor or Cursor() if row.i is None and row.t is None else Cursor(row.i, row.t)


def last_update(events: DataFrame) -> Column:
    """When an event last changed: its own mark if it has one, else its finish, else its start."""
    return F.coalesce(*(c for c in ("LastUpdate", "Finish", "Start") if c in events.columns))


def bridge(run_events: DataFrame) -> DataFrame:
    """Run events that describe work on a chunk, as performance events."""
    chunk = run_events.where(F.col("Kind").isin("Process", "Consume", "Produce") & F.col("CorrelationId").isNotNull())
    count = F.coalesce(F.least(F.greatest(F.col("RecordCount"), F.lit(-(2**31))), F.lit(2**31 - 1)), F.lit(0)).cast("int")
    return chunk.select(F.col("EventId").alias("Id"), F.col("CorrelationId").alias("Name"), "Service", "Pipeline", "Server", "ProcessId", F.col("TimestampUtc").alias("Start"), F.col("FinishUtc").alias("Finish"), "Error", "Source", count.alias("RecordCount"), "Info")


#: Message types of the package catalog by kind of event; others are dropped. 40 is written when a task ends.
CATALOG_KINDS = {30: "Process", 40: "Process", 120: "Error", 130: "Error", 70: "Info"}
TASK_ENDED = 40


def from_catalog(messages: DataFrame, executions: DataFrame, run_id: str = "") -> DataFrame:
    """Catalog messages of executions as run events; the messages of a task's beginning and end have one EventId, so they become one span.

    messages: event_message_id, operation_id, message_time, message_type, package_name, message_source_name, execution_path, message; executions:
    execution_id, server_name, process_id. event_message_id is carried, for the next cursor.
    """
    kind = F.lit(None).cast("string")
    for code, name in CATALOG_KINDS.items():
        kind = F.when(F.col("message_type") == code, name).otherwise(kind)
    joined = messages.join(executions, messages.operation_id == executions.execution_id).withColumn("Kind", kind).where(F.col("Kind").isNotNull())
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    ended = F.col("message_type") == TASK_ENDED
    path = F.concat_ws(":", F.col("operation_id").cast("string"), text("execution_path"))
    return joined.select(
        "event_message_id",
        F.lit(run_id).alias("RunId"),
        short_id(path).alias("EventId"),
        path.alias("CorrelationId"),
        text("package_name").alias("Service"),
        text("server_name").alias("Server"),
        F.coalesce("process_id", F.lit(0)).alias("ProcessId"),
        path_pipeline(text("execution_path")).alias("Pipeline"),
        "Kind",
        text("message_source_name").alias("Source"),
        F.col("message_time").alias("TimestampUtc"),
        F.when(ended, F.col("message_time")).alias("FinishUtc"),
        F.when(F.col("Kind") == "Error", "Failed").when(ended, "Success").otherwise("None").alias("Status"),
        F.when(F.col("Kind") == "Error", F.col("message")).alias("Error"),
        F.when(F.col("Kind") == "Info", F.col("message")).alias("Info"),
    )


def path_pipeline(path: Column) -> Column:
    """The second part of a backslash path of three parts or more; a shorter path has none, so it is empty."""
    parts = F.filter(F.split(path, r"\\"), lambda p: p != "")
    return F.when(F.size(parts) >= 3, F.get(parts, F.lit(1))).otherwise("")


def short_id(text: Column) -> Column:
    return F.upper(F.substring(F.md5(text), 1, 16))


def merge_sources(*sources: DataFrame, key: str = "Id", arrival: str | None = None) -> DataFrame:
    """Several sources of one run's events, the newest row of each key; of rows of one time that of the earlier source, then the first to arrive."""
    number = lambda i: F.struct(F.lit(i).alias("source"), (F.col(arrival) if arrival else F.lit(0)).cast("long").alias("n"))
    every = sources[0].withColumn("_arrival", number(0))
    for i, more in enumerate(sources[1:], 1):
        every = every.unionByName(more.withColumn("_arrival", number(i)), allowMissingColumns=True)
    if arrival:
        return upsert(every, key, arrival="_arrival").drop("_arrival")
    ties = [c for c in ("Finish", "RecordCount") if c in every.columns]
    order = Window.partitionBy(key).orderBy(F.desc_nulls_last("Start"), "_arrival", *(F.col(c).desc_nulls_last() for c in ties))
    return every.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n", "_arrival")


def pair_spans(run_events: DataFrame) -> DataFrame:
    """Run events whose messages of a beginning and an end are one span from the earliest to the latest moment.

    Without it such a pair stays two rows of one EventId that begin at their own times, so of an upserted pair the later one is left, with a span of no length.
    """
    span = Window.partitionBy("RunId", "EventId", "Kind")
    paired = F.col("Kind") == "Process"
    moment = lambda c, f: F.when(paired, f(c).over(span)).otherwise(F.col(c)).alias(c)
    changed = {"TimestampUtc": F.min, "FinishUtc": F.max}
    return run_events.select(*(moment(c, changed[c]) if c in changed else F.col(c) for c in run_events.columns))


def to_log(events: DataFrame) -> DataFrame:
    """Rows as the log stores them: empty texts are null."""
    return events.select(*(F.nullif(F.col(f.name), F.lit("")).alias(f.name) if f.dataType.typeName() == "string" else F.col(f.name) for f in events.schema.fields))


def append(events: DataFrame, path: str) -> None:
    to_log(events).write.mode("append").parquet(path)


def errors(events: DataFrame) -> DataFrame:
    """Events with an error text, the latest first."""
    return events.where(F.coalesce(F.col("Error"), F.lit("")) != "").orderBy(F.desc("Start"), "Id")


def target_edges(run_events: DataFrame) -> DataFrame:
    """Producing and consuming services with a target in common."""
    side = lambda kind, name: run_events.where(F.col("Kind") == kind).select("Target", F.col("Service").alias(name)).distinct()
    return side("Produce", "producer").join(side("Consume", "consumer"), "Target").where("producer != consumer").select("producer", "consumer").distinct()


def target_lag(run_events: DataFrame) -> DataFrame:
    """Records produced less records consumed at each target."""
    n = F.when(F.col("Kind") == "Produce", F.col("RecordCount")).when(F.col("Kind") == "Consume", -F.col("RecordCount"))
    return run_events.groupBy("Target").agg(F.sum(n).cast("long").alias("lag"))


def run_events_scan(log: DataFrame, run_id: str, start: datetime) -> DataFrame:
    """A run's performance events from a moment on, by start, with nulls as empty values; a chunk id stands for a missing name."""
    have = set(log.columns)
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c) if c in have else F.lit("").alias(c)
    name = F.coalesce(*[F.col(c) for c in ("Name", "ChunkId") if c in have], F.lit("")).alias("Name")
    count = F.coalesce("RecordCount", F.lit(0)).alias("RecordCount") if "RecordCount" in have else F.lit(0).alias("RecordCount")
    rows = log.where((F.col("RunId") == run_id) & (F.col("Start") >= F.lit(start).cast("timestamp_ntz")))
    return rows.select("Id", name, *(text(c) for c in ("Service", "Pipeline", "Server", "Source", "Info")), "Start", "Finish", "Error", count).orderBy("Start", "Id")
