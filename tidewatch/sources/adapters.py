"""The Parquet tables of the driver as the tables that the operators read, with the same definitions as SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators.events import upsert
from tidewatch.plans.lineage import stored
from tidewatch.session import table

RUNS_SQL = """
runs AS (
  SELECT CAST(o.o_orderkey AS VARCHAR) AS RunId, o.o_orderpriority AS Type, 'order-' || CAST(o.o_custkey AS VARCHAR) AS Description,
    CASE o.o_orderstatus WHEN 'F' THEN 'Failed' WHEN 'O' THEN 'Running' ELSE 'Completed' END AS Status,
    o.o_orderdate AS "Start", CASE WHEN o.o_orderstatus = 'O' THEN NULL ELSE x.last END AS "End", o.o_custkey AS Cust
  FROM orders o LEFT JOIN (SELECT l_orderkey, max(l_shipdate) AS last FROM lineitem GROUP BY 1) x ON x.l_orderkey = o.o_orderkey)"""

RAW_EVENTS_SQL = """
raw_events AS (
  SELECT CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) || '-' || CAST(l_partkey AS VARCHAR) || '-' || CAST(l_suppkey AS VARCHAR) AS Id,
    CAST(l_orderkey AS VARCHAR) AS Name, 'svc-' || CAST(l_suppkey % 5 AS VARCHAR) AS Service, 'pipe-' || CAST(l_partkey % 3 AS VARCHAR) AS Pipeline,
    'host-' || CAST(l_suppkey % 4 AS VARCHAR) AS Server, CAST(l_suppkey AS INTEGER) AS ProcessId,
    l_shipdate + l_linenumber * INTERVAL 1 SECOND AS "Start",
    CASE WHEN l_linestatus = 'O' AND l_shipdate >= TIMESTAMP '2001-01-01' AND l_suppkey % 5 = 1 THEN NULL
      ELSE l_shipdate + (l_linenumber + CAST(l_quantity AS INTEGER)) * INTERVAL 1 SECOND END AS Finish,
    CASE WHEN l_returnflag = 'R' AND l_discount >= 0.09 AND l_suppkey % 5 = 0 THEN 'E' END AS Error,
    CAST(l_quantity AS INTEGER) AS RecordCount
  FROM lineitem)"""

EVENTS_SQL = (
    RAW_EVENTS_SQL
    + """,
ev AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY Id ORDER BY "Start" DESC, Finish DESC NULLS LAST, RecordCount DESC) AS rn FROM raw_events) WHERE rn = 1)"""
)

MESSAGES_SQL = """
messages AS (
  SELECT event_type AS Topic, CAST(user_id % 4 AS INTEGER) AS Part, row_number() OVER (PARTITION BY event_type, user_id % 4 ORDER BY ts, event_id) - 1 AS Off,
    ts AS Ts, CAST(user_id AS VARCHAR) AS Key, props AS Payload, event_id
  FROM events)"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as runs; a run ends with its last item, or is still running."""
    last = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("last"))
    orders = table(spark, sf_dir, "orders")
    joined = orders.join(last, orders.o_orderkey == last.l_orderkey, "left")
    status = F.when(F.col("o_orderstatus") == "F", "Failed").when(F.col("o_orderstatus") == "O", "Running").otherwise("Completed")
    return joined.select(
        F.col("o_orderkey").cast("string").alias("RunId"),
        F.col("o_orderpriority").alias("Type"),
        F.concat(F.lit("order-"), F.col("o_custkey").cast("string")).alias("Description"),
        status.alias("Status"),
        F.col("o_orderdate").alias("Start"),
        F.when(F.col("o_orderstatus") != "O", F.col("last")).alias("End"),
        F.col("o_custkey").alias("Cust"),
    )


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as performance events, before upserting."""
    return as_events(table(spark, sf_dir, "lineitem"))


def as_events(lineitem: DataFrame, *more: str) -> DataFrame:
    text = lambda c: F.col(c).cast("string")
    kind = lambda prefix, c, n: F.concat(F.lit(prefix), (F.col(c) % n).cast("string"))
    after = lambda c: F.col("l_shipdate") + F.make_dt_interval(secs=c.cast("decimal(18,6)"))
    open_ = (F.col("l_linestatus") == "O") & (F.col("l_shipdate") >= F.lit("2001-01-01").cast("timestamp_ntz")) & (F.col("l_suppkey") % 5 == 1)
    failed = (F.col("l_returnflag") == "R") & (F.col("l_discount") >= 0.09) & (F.col("l_suppkey") % 5 == 0)
    return lineitem.select(
        *more,
        F.concat_ws("-", text("l_orderkey"), text("l_linenumber"), text("l_partkey"), text("l_suppkey")).alias("Id"),
        text("l_orderkey").alias("Name"),
        kind("svc-", "l_suppkey", 5).alias("Service"),
        kind("pipe-", "l_partkey", 3).alias("Pipeline"),
        kind("host-", "l_suppkey", 4).alias("Server"),
        F.col("l_suppkey").cast("int").alias("ProcessId"),
        after(F.col("l_linenumber")).alias("Start"),
        F.when(~open_, after(F.col("l_linenumber") + F.col("l_quantity").cast("int"))).alias("Finish"),
        F.when(failed, F.lit("E")).alias("Error"),
        F.col("l_quantity").cast("int").alias("RecordCount"),
    )


#: The order in which rows arrived, for tables without a number of their own.
ARRIVING_SQL = RAW_EVENTS_SQL.replace("  SELECT CAST(", "  SELECT row_number() OVER () AS Arrival, CAST(", 1)


def arriving_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as performance events with their place in the log as Arrival."""
    numbered = table(spark, sf_dir, "lineitem").withColumn("Arrival", F.struct("_metadata.file_path", "_metadata.file_block_start", "_metadata.row_index"))
    return as_events(numbered, "Arrival")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each event id."""
    return upsert(raw_events(spark, sf_dir))


def stored_events(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The same, or the columns of it that are named, written once for plans of several branches."""
    every = events(spark, sf_dir)
    return stored(every.select(*columns) if columns else every)


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as messages of topics, with partition and offset."""
    from pyspark.sql import Window

    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("Topic"), (F.col("user_id") % 4).cast("int").alias("Part"), F.col("ts").alias("Ts"), F.col("user_id").cast("string").alias("Key"), F.col("props").alias("Payload"), "event_id")
    order = Window.partitionBy("Topic", "Part").orderBy("Ts", "event_id")
    return rows.withColumn("Off", (F.row_number().over(order) - 1).cast("long"))


def services(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as services on nations as hosts, last seen some minutes before 2024-01-31."""
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    seen = F.lit("2024-01-31").cast("timestamp_ntz") - F.make_dt_interval(secs=(F.col("s_suppkey") % 61).cast("decimal(18,6)"))
    return s.join(n, s.s_nationkey == n.n_nationkey).select(F.concat(F.lit("svc-"), (F.col("s_suppkey") % 5).cast("string")).alias("ServiceName"), F.col("n_name").alias("HostName"), F.col("s_suppkey").cast("int").alias("ProcessId"), seen.alias("Updated"), F.when(F.col("s_acctbal") > 0, F.col("s_acctbal") / 10).alias("RamMb"), (seen - F.make_dt_interval(hours=(F.col("s_suppkey") % 200).cast("int"))).alias("Created"), F.when(F.col("s_acctbal") > 5000, F.col("s_acctbal") / 5).alias("PeakMb"))


SERVICES_SQL = """
services AS (
  SELECT 'svc-' || CAST(s_suppkey % 5 AS VARCHAR) AS ServiceName, n_name AS HostName, CAST(s_suppkey AS INTEGER) AS ProcessId,
    TIMESTAMP '2024-01-31' - (s_suppkey % 61) * INTERVAL 1 SECOND AS Updated, CASE WHEN s_acctbal > 0 THEN s_acctbal / 10 END AS RamMb,
    TIMESTAMP '2024-01-31' - (s_suppkey % 61) * INTERVAL 1 SECOND - (s_suppkey % 200) * INTERVAL 1 HOUR AS Created, CASE WHEN s_acctbal > 5000 THEN s_acctbal / 5 END AS PeakMb
  FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""
