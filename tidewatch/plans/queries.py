"""The registered queries of the monitoring operators and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.filters.predicates import VIEWS, And, Not, Or, Seek, Term, TimeOfDay, column, match_column, seek
from tidewatch.functions import jsonpath, text
from tidewatch.operators import events as ev
from tidewatch.operators import graph, logs, metrics, runs, timeline, topics, topology
from tidewatch.session import table
from tidewatch.sources.adapters import ARRIVING_SQL, EVENTS_SQL, MESSAGES_SQL, RUNS_SQL, SERVICES_SQL, arriving_events
from tidewatch.sources.adapters import events as event_table
from tidewatch.sources.adapters import messages as message_table
from tidewatch.sources.adapters import runs as run_table
from tidewatch.sources.adapters import services as service_table
from tidewatch.sources.adapters import stored_events

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
AS_OF, EVENT_AS_OF = "2001-08-01 00:00:00", "2024-01-31 00:00:00"


def query(name: str, sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


# --- runs ---------------------------------------------------------------------------------------------------------

R = f"WITH {RUNS_SQL} "
ENV = R[:-1] + ", envs AS (SELECT runs.*, r_name AS Env FROM runs JOIN customer ON Cust = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) "


@query("runs_filter_status_window", R + """SELECT RunId AS run_id, Type AS type, Status AS status, "Start" AS start_ts, "End" AS end_ts FROM runs
WHERE Status IN ('Failed', 'Running') AND "Start" BETWEEN TIMESTAMP '1998-01-01' AND TIMESTAMP '1998-12-31' ORDER BY "Start" DESC, RunId LIMIT 100""")
def runs_filter_status_window(spark, sf):
    v = VIEWS["runs"]
    tree = And((v.group("status", ["Failed", "Running"], "exact"), v.term("start", "between", (datetime(1998, 1, 1), datetime(1998, 12, 31)))))
    rows = runs.listing(run_table(spark, sf), datetime(2002, 1, 1), ask=runs.RunFilter(tree=tree))
    return rows.select(F.col("RunId").alias("run_id"), F.col("Type").alias("type"), F.col("Status").alias("status"), F.col("Start").alias("start_ts"), F.col("End").alias("end_ts"))


def filtered(name: str, tree: object, where: str) -> None:
    @query(name, R + f"SELECT RunId AS run_id FROM runs WHERE {where}")
    def run(spark, sf):
        rows = run_table(spark, sf)
        return rows.where(column(tree, rows.schema)).select(F.col("RunId").alias("run_id"))


filtered("runs_contains_ci", Term("Type", "contains", "URG"), "contains(lower(Type), 'urg')")
filtered("runs_contains_cs", Term("Description", "contains", "order-1", True), "contains(Description, 'order-1')")
filtered("runs_exact", Term("status", "exact", "FAILED"), "Status = 'Failed'")
filtered("runs_glob", Term("RunId", "glob", "1?5*"), "regexp_matches(RunId, '^1.5.*$')")
filtered("runs_between", Term("RunId", "between", (100, 250)), "CAST(RunId AS DOUBLE) BETWEEN 100 AND 250")
filtered("runs_isnull", Term("End", "isnull"), '"End" IS NULL')
filtered("runs_not_null_safe", Not(Term("End", "gt", datetime(1998, 1, 1))), """NOT coalesce("End" > TIMESTAMP '1998-01-01', false)""")
filtered("runs_or_group", VIEWS["runs"].group("Type", ["urgent", "low"]), "contains(lower(Type), 'urgent') OR contains(lower(Type), 'low')")
filtered("runs_bare_term", VIEWS["runs"].any_field("77"), "contains(RunId, '77') OR contains(Description, '77') OR contains(Type, '77') OR contains(Status, '77')")
filtered("runs_unknown_field", Or((Term("Nothing", "contains", "x"), Term("Status", "exact", "running"))), "Status = 'Running'")
filtered("runs_coerced_number", And((Term("Type", "lt", 5), Term("Status", "exact", "Failed"))), "Status = 'Failed'")


@query("runs_default_window", R + """SELECT RunId AS run_id, "Start" AS start_ts FROM runs WHERE "Start" < TIMESTAMP '2001-08-01' AND "Start" >= TIMESTAMP '2001-04-01' ORDER BY "Start" DESC, RunId LIMIT 1000""")
def runs_default_window(spark, sf):
    return runs.listing(run_table(spark, sf), datetime(2001, 8, 1), 5000).select(F.col("RunId").alias("run_id"), F.col("Start").alias("start_ts"))


@query("runs_legacy_filter", R + """SELECT RunId AS run_id FROM runs WHERE "Start" < TIMESTAMP '2001-08-01' AND "Start" >= TIMESTAMP '2001-04-01' AND (contains(lower(RunId), '1') OR contains(lower(Description), '1'))
AND Status IN ('Completed', 'Running') AND Type IN ('1-URGENT', '2-HIGH') ORDER BY Type, RunId LIMIT 50""")
def runs_legacy_filter(spark, sf):
    ask = runs.RunFilter(text="1", statuses=("Completed", "Running"), types=("1-URGENT", "2-HIGH"), sort="type", descending=False)
    return runs.listing(run_table(spark, sf), datetime(2001, 8, 1), 50, ask).select(F.col("RunId").alias("run_id"))


@query("runs_page", R + """SELECT RunId AS run_id, "Start" AS start_ts FROM runs ORDER BY "Start" DESC, RunId LIMIT 25 OFFSET 50""")
def runs_page(spark, sf):
    return runs.page(run_table(spark, sf), [F.desc("Start"), "RunId"], 3, 25).select(F.col("RunId").alias("run_id"), F.col("Start").alias("start_ts"))


def env_runs(spark, sf):
    return runs.environments(run_table(spark, sf), *(table(spark, sf, t) for t in ("customer", "nation", "region")))


@query("runs_multi_env_union", ENV + """SELECT Env AS env, RunId AS run_id, "Start" AS start_ts FROM (SELECT *, row_number() OVER (PARTITION BY Env ORDER BY "Start" DESC, RunId) AS n FROM envs) WHERE n <= 40""")
def runs_multi_env_union(spark, sf):
    return runs.newest_per_environment(env_runs(spark, sf), 40).select(F.col("Env").alias("env"), F.col("RunId").alias("run_id"), F.col("Start").alias("start_ts"))


def stats_sql(bucket: str, env: bool = True) -> str:
    return ENV + f"""SELECT {bucket} AS bucket, {"Env AS env," if env else ""} round(avg(CAST(epoch(coalesce("End", TIMESTAMP '{AS_OF}')) - epoch("Start") AS DOUBLE)), 3) AS avg_seconds,
count(*) AS runs, count(*) FILTER (Status = 'Failed') AS failed, round(count(*) FILTER (Status = 'Failed') / count(*), 6) AS fail_rate FROM envs GROUP BY ALL"""


for unit, bucket in (("day", """strftime("Start", '%Y-%m-%d')"""), ("week", """strftime(date_trunc('week', "Start"), '%Y-%m-%d')"""), ("month", """strftime("Start", '%Y-%m')""")):
    query(f"runstats_{unit}", stats_sql(bucket))(lambda spark, sf, unit=unit: runs.statistics(env_runs(spark, sf), unit, AS_OF))
query("runstats_line", stats_sql("""strftime("Start", '%Y-%m')""", False))(lambda spark, sf: runs.statistics(env_runs(spark, sf), "month", AS_OF, by_env=False))
query("runstats_numbered", R + """SELECT RunId, strftime("Start", '%Y-%m') AS bucket, row_number() OVER (PARTITION BY strftime("Start", '%Y-%m') ORDER BY "Start", RunId) AS place FROM runs""")(lambda spark, sf: runs.numbered(run_table(spark, sf), "month"))
query("run_status_codes", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'Failed' WHEN 'O' THEN 'Running' WHEN 'P' THEN 'Completed' ELSE 'Unknown' END AS status FROM orders")(
    lambda spark, sf: table(spark, sf, "orders").select("o_orderkey", runs.status_name(F.col("o_orderstatus")).alias("status"))
)

# --- events -------------------------------------------------------------------------------------------------------

E = f"WITH {EVENTS_SQL} "


ARRIVED_SQL = f"WITH {ARRIVING_SQL}, keyed AS (SELECT split_part(Id, '-', 1) || '-' || split_part(Id, '-', 2) AS Key, date_trunc('month', \"Start\") AS Month, * FROM raw_events) "
NEWEST = {
    "events_upsert": ("Key", '"Start" DESC, Arrival'),
    "events_upsert_ties": ("Name", "Month DESC, Arrival"),
    "events_upsert_finished": ("Name", "Month DESC, Finish IS NULL, Arrival"),
}


def newest_sql(name: str) -> str:
    key, order = NEWEST[name]
    return ARRIVED_SQL + f"""SELECT {key} AS id, "Start" AS start_ts, Finish AS finish_ts, RecordCount AS records FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {order}) AS rn FROM keyed) WHERE rn = 1"""


def newest_rows(events: DataFrame, key: str, time: str, prefer_finished: str | None = None) -> DataFrame:
    rows = ev.upsert(events, key, time, arrival="Arrival", prefer_finished=prefer_finished)
    return rows.select(F.col(key).alias("id"), F.col("Start").alias("start_ts"), F.col("Finish").alias("finish_ts"), F.col("RecordCount").alias("records"))


@query("events_upsert", newest_sql("events_upsert"))
def events_upsert(spark, sf):
    return newest_rows(arriving_events(spark, sf).withColumn("Key", F.substring_index("Id", "-", 2)), "Key", "Start")


@query("events_upsert_ties", newest_sql("events_upsert_ties"))
def events_upsert_ties(spark, sf):
    """Many rows of one key have equal times: the first to arrive stays."""
    return newest_rows(arriving_events(spark, sf).withColumn("Month", F.date_trunc("month", "Start")), "Name", "Month")


@query("events_upsert_finished", newest_sql("events_upsert_finished"))
def events_upsert_finished(spark, sf):
    return newest_rows(arriving_events(spark, sf).withColumn("Month", F.date_trunc("month", "Start")), "Name", "Month", "Finish")


@query("events_poll_cursor", E + """SELECT Id AS id, coalesce(Finish, "Start") AS last_update FROM ev WHERE coalesce(Finish, "Start") > TIMESTAMP '2000-06-01'""")
def events_poll_cursor(spark, sf):
    rows = event_table(spark, sf)
    changed = ev.last_update(rows)
    return ev.since(rows, ev.Cursor(last_time=datetime(2000, 6, 1)), time=changed).select(F.col("Id").alias("id"), changed.alias("last_update"))


RUN_EVENTS_SQL = E[:-1] + """, run_events AS (SELECT Id AS EventId, CASE WHEN l_partkey % 7 = 0 THEN NULL ELSE CAST(l_orderkey AS VARCHAR) END AS CorrelationId, 'svc-' || CAST(l_suppkey % 5 AS VARCHAR) AS Service, 'pipe-' || CAST(l_partkey % 3 AS VARCHAR) AS Pipeline,
CASE l_linestatus WHEN 'F' THEN 'Produce' ELSE 'Consume' END AS Kind, 't-' || CAST(l_partkey % 20 AS VARCHAR) AS Target, CAST(l_quantity AS BIGINT) AS RecordCount
FROM (SELECT *, CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) || '-' || CAST(l_partkey AS VARCHAR) || '-' || CAST(l_suppkey AS VARCHAR) AS Id FROM lineitem)) """


def run_events(spark, sf):
    t = lambda c: F.col(c).cast("string")
    return table(spark, sf, "lineitem").select(
        F.concat_ws("-", t("l_orderkey"), t("l_linenumber"), t("l_partkey"), t("l_suppkey")).alias("EventId"),
        F.when(F.col("l_partkey") % 7 != 0, t("l_orderkey")).alias("CorrelationId"),
        F.concat(F.lit("svc-"), (F.col("l_suppkey") % 5).cast("string")).alias("Service"),
        F.concat(F.lit("pipe-"), (F.col("l_partkey") % 3).cast("string")).alias("Pipeline"),
        F.when(F.col("l_linestatus") == "F", "Produce").otherwise("Consume").alias("Kind"),
        F.concat(F.lit("t-"), (F.col("l_partkey") % 20).cast("string")).alias("Target"),
        F.col("l_quantity").cast("long").alias("RecordCount"),
        F.lit("host").alias("Server"),
        F.col("l_suppkey").cast("int").alias("ProcessId"),
        F.col("l_shipdate").alias("TimestampUtc"),
        F.col("l_shipdate").alias("FinishUtc"),
        F.lit(None).cast("string").alias("Error"),
        F.lit("db").alias("Source"),
        F.lit("").alias("Info"),
    )


@query("events_bridge", RUN_EVENTS_SQL + "SELECT EventId AS id, CorrelationId AS name, Service AS service, Pipeline AS pipeline, CAST(RecordCount AS INTEGER) AS records FROM run_events WHERE CorrelationId IS NOT NULL")
def events_bridge(spark, sf):
    return ev.bridge(run_events(spark, sf)).select(F.col("Id").alias("id"), F.col("Name").alias("name"), F.col("Service").alias("service"), F.col("Pipeline").alias("pipeline"), F.col("RecordCount").alias("records"))


query("target_edges", RUN_EVENTS_SQL + "SELECT DISTINCT p.Service AS producer, c.Service AS consumer FROM run_events p JOIN run_events c ON p.Target = c.Target WHERE p.Kind = 'Produce' AND c.Kind = 'Consume' AND p.Service <> c.Service")(
    lambda spark, sf: ev.target_edges(run_events(spark, sf))
)
query("target_lag", RUN_EVENTS_SQL + "SELECT Target, CAST(sum(CASE Kind WHEN 'Produce' THEN RecordCount ELSE -RecordCount END) AS BIGINT) AS lag FROM run_events GROUP BY 1")(lambda spark, sf: ev.target_lag(run_events(spark, sf)))
query("errors_list", E + """SELECT Id AS id, "Start" AS start_ts, Error AS error FROM ev WHERE coalesce(Error, '') <> ''""")(
    lambda spark, sf: ev.errors(event_table(spark, sf)).select(F.col("Id").alias("id"), F.col("Start").alias("start_ts"), F.col("Error").alias("error"))
)


CATALOG_SQL = r"""WITH m AS (SELECT event_id AS event_message_id, 1 + event_id % 50 AS operation_id, ts, CASE event_type WHEN 'click' THEN 30 WHEN 'view' THEN 40 WHEN 'error' THEN 120 WHEN 'signup' THEN 70 ELSE 10 END AS message_type,
'\pkg\task' || CAST(event_id % 5 AS VARCHAR) || CASE WHEN event_id % 2 = 0 THEN '\step' ELSE '' END AS execution_path FROM events), x AS (SELECT 1 + event_id % 40 AS execution_id, max(user_id) AS process_id FROM events GROUP BY 1),
c AS (SELECT *, CASE message_type WHEN 30 THEN 'Process' WHEN 40 THEN 'Process' WHEN 120 THEN 'Error' WHEN 70 THEN 'Info' END AS Kind, CAST(operation_id AS VARCHAR) || ':' || execution_path AS path FROM m JOIN x ON operation_id = execution_id WHERE message_type <> 10) """


def catalog_events(spark, sf):
    e, i = table(spark, sf, "events"), F.col("event_id")
    kind = F.when(F.col("event_type") == "click", 30).when(F.col("event_type") == "view", 40).when(F.col("event_type") == "error", 120).when(F.col("event_type") == "signup", 70).otherwise(10)
    path = F.concat(F.lit("\\pkg\\task"), (i % 5).cast("string"), F.when(i % 2 == 0, "\\step").otherwise(""))
    said = F.concat(F.lit("said "), i.cast("string"))
    m = e.select(i.alias("event_message_id"), (1 + i % 50).alias("operation_id"), F.col("ts").alias("message_time"), kind.alias("message_type"), path.alias("execution_path"), F.lit("pkg").alias("package_name"), F.lit("src").alias("message_source_name"), said.alias("message"))
    x = e.groupBy((1 + i % 40).alias("execution_id")).agg(F.max("user_id").alias("process_id")).withColumn("server_name", F.lit("host"))
    return ev.from_catalog(m, x, "run")


query("ssis_kinds", CATALOG_SQL + "SELECT event_message_id, Kind, CASE WHEN event_message_id % 2 = 0 THEN 'task' || CAST(event_message_id % 5 AS VARCHAR) ELSE '' END AS Pipeline, upper(substring(md5(path), 1, 16)) AS EventId FROM c")(
    lambda spark, sf: catalog_events(spark, sf).select("event_message_id", "Kind", "Pipeline", "EventId")
)
query("ssis_events", CATALOG_SQL + """SELECT event_message_id, path AS CorrelationId, 'pkg' AS Service, 'host' AS Server, process_id AS ProcessId, ts AS TimestampUtc, CASE WHEN message_type = 40 THEN ts END AS FinishUtc,
CASE WHEN Kind = 'Error' THEN 'Failed' WHEN message_type = 40 THEN 'Success' ELSE 'None' END AS Status, CASE WHEN Kind = 'Error' THEN 'said ' || CAST(event_message_id AS VARCHAR) END AS Error, CASE WHEN Kind = 'Info' THEN 'said ' || CAST(event_message_id AS VARCHAR) END AS Info FROM c""")(
    lambda spark, sf: catalog_events(spark, sf).drop("RunId", "EventId", "Pipeline", "Kind", "Source")
)


@query(
    "ssis_spans",
    CATALOG_SQL
    + """SELECT event_message_id, CASE WHEN Kind = 'Process' THEN min(ts) OVER w ELSE ts END AS TimestampUtc, CASE WHEN Kind = 'Process' THEN max(CASE WHEN message_type = 40 THEN ts END) OVER w END AS FinishUtc FROM c WINDOW w AS (PARTITION BY path, Kind)""",
)
def ssis_spans(spark, sf):
    return ev.pair_spans(catalog_events(spark, sf)).select("event_message_id", "TimestampUtc", "FinishUtc")


# --- topology -----------------------------------------------------------------------------------------------------

ROW_COLUMNS = ("Service", "Pipeline", "Start", "Finish", "Error")
EDGE_COLUMNS = ("Id", "Name", *ROW_COLUMNS)
TOPO = E[:-1] + """, t AS (SELECT max(coalesce(Finish, "Start")) AS t FROM ev), rows_ AS (
SELECT Service, Pipeline, count(Finish) AS done, count(*) - count(Finish) AS in_progress, count(*) FILTER (coalesce(Error <> '', false)) AS errors, count(*) FILTER (Finish IS NOT NULL AND epoch(t.t) - epoch(Finish) <= 15) AS recent FROM ev, t GROUP BY 1, 2),
topo AS (SELECT Service, Pipeline, done, in_progress, errors, round(CASE WHEN done + in_progress = 0 THEN 0 ELSE done / (done + in_progress) END, 6) AS progress, round(CASE WHEN done = 0 THEN 0 ELSE least(recent / done, 1) END, 6) AS throughput,
CASE WHEN errors > 0 THEN 'Errored' WHEN recent > 0 THEN 'Active' WHEN in_progress > 0 THEN 'InProgress' WHEN done > 0 THEN 'Completed' ELSE 'Idle' END AS state FROM rows_) """

query("topo_rows", TOPO + "SELECT * FROM topo")(lambda spark, sf: topology.pipeline_rows(stored_events(spark, sf, *ROW_COLUMNS)))
query("topo_nodes", TOPO + """SELECT Service, n AS instances, pipelines, CASE r WHEN 5 THEN 'Errored' WHEN 4 THEN 'Active' WHEN 3 THEN 'InProgress' WHEN 2 THEN 'Idle' WHEN 1 THEN 'Completed' ELSE 'NotStarted' END AS header_state
FROM (SELECT Service, count(*) AS pipelines, max(CASE state WHEN 'Errored' THEN 5 WHEN 'Active' THEN 4 WHEN 'InProgress' THEN 3 WHEN 'Idle' THEN 2 WHEN 'Completed' THEN 1 ELSE 0 END) AS r FROM topo GROUP BY 1) JOIN (SELECT Service, count(DISTINCT Server || ':' || ProcessId) AS n FROM ev GROUP BY 1) USING (Service)""")(
    lambda spark, sf: topology.nodes(stored_events(spark, sf, *ROW_COLUMNS, "Server", "ProcessId"))
)
query("topo_instances", E + """SELECT Service, Pipeline, Server, ProcessId, count(Finish) AS done, count(*) - count(Finish) AS in_progress, count(*) FILTER (coalesce(Error <> '', false)) AS errors, max(coalesce(Finish, "Start")) AS last_activity FROM ev GROUP BY 1, 2, 3, 4""")(
    lambda spark, sf: topology.instances(event_table(spark, sf))
)
EDGES_SQL = TOPO[:-1] + """, h AS (SELECT Name, lag(Service) OVER w AS source, lag(Pipeline) OVER w AS source_pipeline, Service AS target, Pipeline AS target_pipeline FROM ev WINDOW w AS (PARTITION BY Name ORDER BY "Start", Id)),
e AS (SELECT source, source_pipeline, target, target_pipeline, count(*) AS done FROM h WHERE source IS NOT NULL AND (source <> target OR source_pipeline <> target_pipeline) GROUP BY 1, 2, 3, 4),
place AS (SELECT Name, Service, Pipeline, bool_or(Finish IS NOT NULL) AS fin FROM ev GROUP BY 1, 2, 3),
both_ AS (SELECT a.Service AS source, a.Pipeline AS source_pipeline, b.Service AS target, b.Pipeline AS target_pipeline, count(*) AS n FROM place a JOIN place b USING (Name) WHERE a.fin GROUP BY 1, 2, 3, 4),
tot AS (SELECT Service, Pipeline, count(*) AS n FROM place WHERE fin GROUP BY 1, 2),
edges AS (SELECT e.*, coalesce(tot.n, 0) - coalesce(both_.n, 0) AS waiting, coalesce(topo.state, 'NotStarted') AS state FROM e LEFT JOIN both_ USING (source, source_pipeline, target, target_pipeline)
LEFT JOIN tot ON tot.Service = e.source AND tot.Pipeline = e.source_pipeline LEFT JOIN topo ON topo.Service = e.source AND topo.Pipeline = e.source_pipeline) """
query("topo_edges", EDGES_SQL + "SELECT * FROM edges")(lambda spark, sf: topology.edges(stored_events(spark, sf, *EDGE_COLUMNS)))
query("topo_summary", E + """SELECT count(*) AS chunks, CAST(sum(n) AS BIGINT) AS events, CAST(sum(d) AS BIGINT) AS done, CAST(sum(n) - sum(d) AS BIGINT) AS in_progress, round(least(sum(d) / (max(hops) * count(*)), 1), 6) AS progress
FROM (SELECT Name, count(*) AS n, count(Finish) AS d, count(DISTINCT Service || '|' || Pipeline) AS hops FROM ev GROUP BY 1)""")(lambda spark, sf: topology.summary(event_table(spark, sf)))
query("topo_replay", TOPO.replace("ev AS (", "ev0 AS (").replace(", t AS (", """, ev AS (SELECT * FROM ev0 WHERE "Start" <= TIMESTAMP '1999-01-01'), t AS (""", 1) + "SELECT * FROM topo")(
    lambda spark, sf: topology.pipeline_rows(topology.replay(stored_events(spark, sf, *ROW_COLUMNS), "1999-01-01"))
)
query("topo_replay_range", E + """SELECT min("Start") AS first, max(coalesce(Finish, "Start")) AS last FROM ev""")(lambda spark, sf: topology.replay_range(event_table(spark, sf)))

#: Nations as hints: literal names, other spellings, globs with ? and *, and names that nobody has.
HINTS_SQL = """hints AS (SELECT CAST(n_nationkey AS INTEGER) AS idx, CASE n_nationkey % 5 WHEN 0 THEN 'svc-' || CAST(n_regionkey AS VARCHAR) WHEN 1 THEN n_name WHEN 2 THEN 'SVC-' || CAST(n_nationkey * 3 % 7 AS VARCHAR)
  WHEN 3 THEN 's?c-' || CAST(n_regionkey AS VARCHAR) ELSE CASE WHEN n_nationkey = 24 THEN 'svc-*' ELSE lower(n_name) || '*' END END AS name,
  CASE WHEN n_regionkey < 2 THEN 'source' ELSE 'sink' END AS role, 'g' || CAST(n_regionkey AS VARCHAR) AS grp, 't' || CAST(n_nationkey % 9 AS VARCHAR) AS pub, 'T' || CAST(n_nationkey % 7 AS VARCHAR) AS sub FROM nation)"""
EXPLICIT_SQL = "explicit AS (SELECT 'svc-' || CAST(r_regionkey AS VARCHAR) AS source, CASE WHEN r_regionkey % 2 = 0 THEN 'SVC-*' ELSE '' END AS target, CAST(r_regionkey AS INTEGER) AS idx FROM region)"
DECLARED_SQL = f"""{HINTS_SQL}, {EXPLICIT_SQL}, wanted AS (SELECT p.name AS source, c.name AS target, (0, p.idx, c.idx) AS o FROM hints p JOIN hints c ON lower(p.pub) = lower(c.sub) AND p.idx <> c.idx
  UNION ALL SELECT source, target, (1, idx, 0) FROM explicit WHERE target <> ''), declared AS (SELECT arg_min(source, o) AS source, arg_min(target, o) AS target FROM wanted GROUP BY lower(source), lower(target))"""
LIKE_SQL = "lower({0}) LIKE replace(replace(lower({1}), '*', '%'), '?', '_')"


def hints(spark, sf):
    n, r = F.col("n_nationkey"), F.col("n_regionkey").cast("string")
    loose = F.when(n == 24, "svc-*").otherwise(F.concat(F.lower("n_name"), F.lit("*")))
    name = F.when(n % 5 == 0, F.concat(F.lit("svc-"), r)).when(n % 5 == 1, F.col("n_name")).when(n % 5 == 2, F.concat(F.lit("SVC-"), (n * 3 % 7).cast("string"))).when(n % 5 == 3, F.concat(F.lit("s?c-"), r)).otherwise(loose)
    role = F.when(F.col("n_regionkey") < 2, "source").otherwise("sink")
    token = lambda prefix, m: F.array(F.concat(F.lit(prefix), (n % m).cast("string")))
    return table(spark, sf, "nation").select(n.cast("int").alias("idx"), name.alias("name"), role.alias("role"), F.concat(F.lit("g"), r).alias("grp"), token("t", 9).alias("publishes"), token("T", 7).alias("subscribes"))


def declared(spark, sf):
    r = F.col("r_regionkey")
    explicit = table(spark, sf, "region").select(F.concat(F.lit("svc-"), r.cast("string")).alias("source"), F.when(r % 2 == 0, "SVC-*").otherwise("").alias("target"), r.cast("int").alias("idx"))
    return topology.declared_edges(hints(spark, sf), explicit)


def seen_services(events):
    return events.select(F.col("Service").alias("id")).distinct()


query("topo_declared_edges", f"WITH {DECLARED_SQL} SELECT * FROM declared")(declared)
NODES_SQL = f"""obs AS (SELECT DISTINCT Service AS id FROM ev), m AS (SELECT id, idx, role, grp, row_number() OVER (PARTITION BY id ORDER BY idx) AS n FROM obs LEFT JOIN hints ON {LIKE_SQL.format("id", "name")}),
nodes AS (SELECT id, idx IS NOT NULL AS is_declared, true AS is_observed, role, grp FROM m WHERE n = 1 UNION ALL
SELECT arg_min(name, idx), true, false, arg_min(role, idx), arg_min(grp, idx) FROM hints WHERE NOT regexp_matches(name, '[*?]') AND lower(name) NOT IN (SELECT lower(id) FROM obs) GROUP BY lower(name))"""
query("topo_blueprint_nodes", E[:-1] + f", {HINTS_SQL}, {NODES_SQL} SELECT * FROM nodes")(lambda spark, sf: topology.blueprint_nodes(seen_services(event_table(spark, sf)), hints(spark, sf)))


@query(
    "topo_blueprint_edges",
    EDGES_SQL[:-1] + f""", {DECLARED_SQL}, {NODES_SQL}, want AS (SELECT DISTINCT a.id AS source, b.id AS target FROM declared d JOIN nodes a ON {LIKE_SQL.format("a.id", "d.source")} JOIN nodes b ON {LIKE_SQL.format("b.id", "d.target")} WHERE lower(a.id) <> lower(b.id))
SELECT source, source_pipeline, target, target_pipeline, EXISTS (SELECT 1 FROM want d WHERE d.source = edges.source AND d.target = edges.target) AS is_declared, true AS is_observed FROM edges
UNION ALL SELECT source, '', target, '', true, false FROM want d WHERE NOT EXISTS (SELECT 1 FROM edges WHERE d.source = edges.source AND d.target = edges.target)""",
)
def topo_blueprint_edges(spark, sf):
    events, given = stored_events(spark, sf, *EDGE_COLUMNS), hints(spark, sf)
    return topology.blueprint_edges(topology.edges(events), topology.blueprint_nodes(seen_services(events), given).select("id"), declared(spark, sf))


@query("topo_variant", E[:-1] + f""", variants AS (SELECT r_regionkey AS idx, CASE WHEN r_regionkey = 0 THEN '' WHEN r_regionkey = 1 THEN lower(r_name) || '*' ELSE '?VC-' || CAST(r_regionkey AS VARCHAR) END AS g FROM region)
SELECT CAST(min(idx) AS INTEGER) AS variant FROM variants WHERE g <> '' AND EXISTS (SELECT 1 FROM ev WHERE {LIKE_SQL.format("Service", "g")})""")
def topo_variant(spark, sf):
    r = F.col("r_regionkey")
    named = F.when(r == 0, "").when(r == 1, F.concat(F.lower("r_name"), F.lit("*"))).otherwise(F.concat(F.lit("?VC-"), r.cast("string")))
    return topology.variant(seen_services(event_table(spark, sf)), table(spark, sf, "region").select(r.cast("int").alias("idx"), named.alias("any_service")))


query("topo_group_colours", "SELECT lower(n) AS grp, arg_max(n_name, n_nationkey) AS color FROM (SELECT *, CASE WHEN n_nationkey % 2 = 0 THEN r_name ELSE lower(r_name) END AS n FROM nation JOIN region ON n_regionkey = r_regionkey) GROUP BY 1")(
    lambda spark, sf: topology.group_colours(table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("idx"), F.when(F.col("n_nationkey") % 2 == 0, F.col("r_name")).otherwise(F.lower("r_name")).alias("name"), F.col("n_name").alias("color")))
)
FORWARD_SQL = EDGES_SQL[:-1] + ", p AS (SELECT DISTINCT source, target FROM edges WHERE source <> target), fwd AS (SELECT * FROM p WHERE NOT (source > target AND EXISTS (SELECT 1 FROM p q WHERE q.source = p.target AND q.target = p.source))) "
query("layout_layers", FORWARD_SQL.replace("WITH ", "WITH RECURSIVE ", 1)[:-1] + """, walk(node, layer) AS (SELECT DISTINCT source, 0 FROM fwd UNION SELECT fwd.target, walk.layer + 1 FROM walk JOIN fwd ON walk.node = fwd.source) SELECT node, max(layer) AS layer FROM walk GROUP BY 1""")(
    lambda spark, sf: graph.layers(graph.forward_edges(topology.edges(stored_events(spark, sf, *EDGE_COLUMNS))))
)
query("closure", FORWARD_SQL.replace("WITH ", "WITH RECURSIVE ", 1)[:-1] + ", reach AS (SELECT source, target FROM fwd UNION SELECT reach.source, fwd.target FROM reach JOIN fwd ON reach.target = fwd.source) SELECT * FROM reach")(
    lambda spark, sf: graph.closure(graph.forward_edges(topology.edges(stored_events(spark, sf, *EDGE_COLUMNS))))
)


CHILDREN_SQL = "WITH c AS (SELECT CASE WHEN o_orderkey % 4 <> 0 THEN o_orderkey - o_orderkey % 4 ELSE o_orderkey - o_orderkey % 16 END AS parent, o_orderkey AS child FROM orders WHERE o_orderkey % 16 <> 0)"


@query("run_descendants", CHILDREN_SQL + ", a AS (SELECT o_orderkey AS root, o_orderkey AS node, 0 AS depth FROM orders WHERE o_orderkey NOT IN (SELECT child FROM c)), b AS (SELECT root, child AS node, 1 AS depth FROM a JOIN c ON node = parent), d AS (SELECT root, child AS node, 2 AS depth FROM b JOIN c ON node = parent) SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM d")
def run_descendants(spark, sf):
    """All runs that have no parent, with what is below them: every fourth run has the three after it, every sixteenth the three fourths after it."""
    orders, k = table(spark, sf, "orders"), F.col("o_orderkey")
    children = orders.where(k % 16 != 0).select(F.when(k % 4 != 0, k - k % 4).otherwise(k - k % 16).alias("parent"), k.alias("child"))
    roots = orders.select(k.alias("node")).join(children.select(F.col("child").alias("node")), "node", "left_anti")
    return graph.descendants(children, roots, 2)


# --- timeline -----------------------------------------------------------------------------------------------------

query("tl_lanes", E + """, l AS (SELECT Service || '/' || Pipeline AS lane, Service, min(("Start", Id)) AS f, count(*) AS events FROM ev WHERE Finish IS NOT NULL GROUP BY 1, 2)
SELECT lane, row_number() OVER (ORDER BY f0, f) AS lane_order, events FROM (SELECT *, min(f) OVER (PARTITION BY Service) AS f0 FROM l)""".replace(", l AS", ", l AS", 1).strip())(lambda spark, sf: timeline.lanes(event_table(spark, sf)))
ORACLE_SQL["tl_lanes"] = ORACLE_SQL["tl_lanes"].replace(") , l AS", "), l AS")
MS = """epoch_ms(Finish) - epoch_ms("Start")"""
query("tl_stack", E + f"""SELECT Name, Id, CAST(coalesce(sum({MS}) OVER w, 0) AS BIGINT) AS x_start, CAST(coalesce(sum({MS}) OVER w, 0) + {MS} AS BIGINT) AS x_end FROM ev WHERE Finish IS NOT NULL
WINDOW w AS (PARTITION BY Name ORDER BY "Start", Id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")(lambda spark, sf: timeline.stack(event_table(spark, sf)))
query("tl_stack_domain", E + f"SELECT CAST(max(t) AS BIGINT) AS domain FROM (SELECT sum({MS}) AS t FROM ev WHERE Finish IS NOT NULL GROUP BY Name)")(lambda spark, sf: timeline.stack_domain(event_table(spark, sf)))
query("tl_heatmap", E + """, d AS (SELECT min(epoch_ms("Start")) AS a, greatest(max(epoch_ms(coalesce(Finish, "Start"))) - min(epoch_ms("Start")), 1000) AS s FROM ev), c AS (SELECT CAST(floor((epoch_ms("Start") - a) / s * 499) AS BIGINT) AS bucket, count(*) AS n FROM ev, d GROUP BY 1)
SELECT bucket, n, round(0.12 + 0.88 * n / (SELECT max(n) FROM c), 6) AS opacity FROM c""")(lambda spark, sf: timeline.heatmap(stored_events(spark, sf, "Start", "Finish")))


SPANS_SQL = E[:-1] + """, f AS (SELECT Service || '/' || Pipeline AS lane, epoch_ms("Start") AS a, coalesce(epoch_ms(Finish), epoch_ms("Start") + 5000) AS b FROM ev),
p AS (SELECT lane, a AS t, 1 AS d FROM f UNION ALL SELECT lane, b, -1 FROM f), rows_ AS (SELECT lane, CAST(max(n) AS BIGINT) AS sub_rows FROM (SELECT lane, sum(d) OVER (PARTITION BY lane ORDER BY t, d ROWS UNBOUNDED PRECEDING) AS n FROM p) GROUP BY 1) """
query("tl_packing", SPANS_SQL + "SELECT lane, sub_rows, events FROM rows_ JOIN (SELECT lane, count(*) AS events FROM f GROUP BY 1) USING (lane)")(
    lambda spark, sf: timeline.sub_rows(stored_events(spark, sf, "Id", "Service", "Pipeline", "Start", "Finish")).groupBy("lane").agg((F.max("sub_row") + 1).cast("long").alias("sub_rows"), F.count("*").alias("events"))
)
query("tl_sub_row_counts", SPANS_SQL + "SELECT * FROM rows_")(lambda spark, sf: timeline.sub_row_counts(stored_events(spark, sf, "Id", "Service", "Pipeline", "Start", "Finish")))
query("tl_wall_clock", E + """SELECT min(epoch_ms("Start")) AS low, greatest(max(epoch_ms(coalesce(Finish, "Start"))) - min(epoch_ms("Start")), 1000) AS span FROM ev""")(lambda spark, sf: timeline.wall_clock(event_table(spark, sf)))
query("tl_duration_filter", E + """SELECT Id AS id, strftime("Start", '%Y-%m-%dT%H:%M:%S.') || lpad(CAST(epoch_ms("Start") % 1000 AS VARCHAR), 3, '0') || 'Z' AS start_utc FROM ev WHERE epoch(Finish) - epoch("Start") > 30""")(
    lambda spark, sf: (lambda e: e.where(column(Term("Duration", "gt", TimeOfDay(30)), e.schema)).select(F.col("Id").alias("id"), F.col("StartUtc").alias("start_utc")))(timeline.enriched(event_table(spark, sf), AS_OF))
)

# --- services and memory ------------------------------------------------------------------------------------------

S = f"WITH {SERVICES_SQL} "
query("svc_liveness", S + "SELECT ProcessId, ServiceName, HostName, Updated >= TIMESTAMP '2024-01-31' - INTERVAL 30 SECOND AS IsOnline FROM services WHERE Updated >= TIMESTAMP '2024-01-31' - INTERVAL 30 MINUTE")(
    lambda spark, sf: metrics.heartbeats(service_table(spark, sf), EVENT_AS_OF).select("ProcessId", "ServiceName", "HostName", "IsOnline")
)
query("svc_groups", S + "SELECT HostName AS grp, count(*) AS n, round(sum(coalesce(RamMb, 0)), 4) AS sum_mb, round(avg(coalesce(RamMb, 0)), 4) AS avg_mb FROM services GROUP BY 1")(lambda spark, sf: metrics.groups(service_table(spark, sf), "HostName"))
query("svc_sort", S + "SELECT ProcessId, RamMb FROM services ORDER BY coalesce(RamMb, 0) DESC, ServiceName, HostName, ProcessId LIMIT 20")(lambda spark, sf: metrics.sorted_services(service_table(spark, sf), "mem", True).limit(20).select("ProcessId", "RamMb"))
query("mem_treemap", S + "SELECT HostName AS host, CAST(row_number() OVER (PARTITION BY HostName ORDER BY coalesce(RamMb, 0) DESC, ProcessId) - 1 AS INTEGER) AS rank, ProcessId AS pid, ServiceName AS service, round(RamMb, 4) AS ram FROM services")(
    lambda spark, sf: metrics.treemap_rows(service_table(spark, sf))
)
SAMPLES_SQL = "WITH samples AS (SELECT CAST(user_id AS VARCHAR) AS key, event_type AS grp, ts, event_id AS id, CAST(value * 1000000 AS BIGINT) AS current, CAST(event_id % 1000 AS BIGINT) * 1000 AS child, value FROM events) "


def samples(spark, sf):
    return table(spark, sf, "events").select(F.col("user_id").cast("string").alias("key"), F.col("event_type").alias("grp"), "ts", F.col("event_id").alias("id"), F.round(F.col("value") * 1000000).cast("long").alias("current"), ((F.col("event_id") % 1000) * 1000).cast("long").alias("child"), "value")


query("mem_latest", SAMPLES_SQL + "SELECT key, ts, id, current FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts DESC, id DESC) AS n FROM samples) WHERE n = 1")(lambda spark, sf: metrics.latest(samples(spark, sf)).select("key", "ts", "id", "current"))
query("mem_history_cap", SAMPLES_SQL + "SELECT key, ts, current, child FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts DESC) AS m FROM (SELECT *, row_number() OVER (PARTITION BY key, ts ORDER BY id DESC) AS n FROM samples) WHERE n = 1) WHERE m <= 30")(
    lambda spark, sf: metrics.history(samples(spark, sf), 30)
)
query("mem_series", SAMPLES_SQL + "SELECT grp, ts, round(CAST(sum(current) + sum(child) AS DOUBLE) / 1e6, 6) AS mb, round(CAST(sum(child) AS DOUBLE) / 1e6, 6) AS child_mb FROM samples GROUP BY 1, 2")(lambda spark, sf: metrics.series(samples(spark, sf), "grp"))
query("mem_legend", SAMPLES_SQL + "SELECT grp, count(*) AS members, round(sum((current + child) / 1e6), 6) AS sum_mb, round(avg((current + child) / 1e6), 6) AS avg_mb FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts DESC, id DESC) AS n FROM samples) WHERE n = 1 GROUP BY 1")(
    lambda spark, sf: metrics.legend(samples(spark, sf), "grp")
)
POINTS_SQL = SAMPLES_SQL[:-1] + ", points AS (SELECT key AS series, epoch_ms(date_trunc('hour', ts)) AS ts, avg(CAST(id AS DOUBLE)) AS value FROM samples GROUP BY 1, 2) "


@query("mem_interpolated", POINTS_SQL[:-1] + """, g AS (SELECT s.series, t.ts, p.value FROM (SELECT DISTINCT series FROM points) s CROSS JOIN (SELECT DISTINCT ts FROM points) t LEFT JOIN points p ON p.series = s.series AND p.ts = t.ts),
n AS (SELECT *, last_value(CASE WHEN value IS NOT NULL THEN ts END IGNORE NULLS) OVER a AS t1, last_value(value IGNORE NULLS) OVER a AS v1, first_value(CASE WHEN value IS NOT NULL THEN ts END IGNORE NULLS) OVER b AS t2, first_value(value IGNORE NULLS) OVER b AS v2 FROM g
WINDOW a AS (PARTITION BY series ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b AS (PARTITION BY series ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT series, ts, round(CASE WHEN t1 IS NULL THEN v2 WHEN t2 IS NULL OR t1 = t2 THEN v1 ELSE v1 + (v2 - v1) * ((ts - t1) / (t2 - t1)) END, 6) AS value FROM n""")
def mem_interpolated(spark, sf):
    return metrics.interpolated(hourly(spark, sf))


def hourly(spark, sf):
    """Points of each key by hour; a key isn't seen in every hour."""
    return samples(spark, sf).groupBy(F.col("key").alias("series"), F.unix_millis(F.date_trunc("hour", "ts").cast("timestamp")).alias("ts")).agg(F.avg(F.col("id").cast("double")).alias("value"))


query("spark_points", SAMPLES_SQL + """, w AS (SELECT *, epoch_us(ts) AS t, min(epoch_us(ts)) OVER k AS a, max(epoch_us(ts)) OVER k AS b, max(value) OVER k AS top, count(*) OVER k AS n FROM samples WINDOW k AS (PARTITION BY key))
SELECT key, id, round((t - a) / (b - a) * 100, 6) AS x, round(40 - value / top * 40, 6) AS y FROM w WHERE n >= 2 AND b > a AND top > 0""".strip())(lambda spark, sf: metrics.spark_points(samples(spark, sf).select("key", "ts", "id", "value")))
query("health_streak", SAMPLES_SQL + """, i AS (SELECT key, ts, id, grp <> 'error' AS ok, sum(CASE WHEN grp <> 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS island FROM samples),
s AS (SELECT key, ts, id, CAST(sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER (PARTITION BY key, island ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS streak FROM i)
SELECT *, CASE WHEN streak = 0 THEN 'Healthy' WHEN streak = 1 THEN 'Degraded' WHEN streak >= 3 THEN 'Down' ELSE 'DegradedEscalating' END AS status FROM s""".strip())(
    lambda spark, sf: metrics.streaks(samples(spark, sf).select("key", "ts", "id", (F.col("grp") != "error").alias("ok")))
)
query("svc_with_latest", f"WITH {SERVICES_SQL}, samples AS (SELECT CAST(user_id AS INTEGER) AS pid, ts, event_id AS id, CAST(value * 1000000 AS BIGINT) AS current, CAST(event_id % 1000 AS BIGINT) * 1000 AS child FROM events) SELECT ProcessId, ServiceName, HostName, round((current + child) / 1048576, 6) AS latest_mib FROM services LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY ts DESC, id DESC) AS n FROM samples) x ON pid = ProcessId AND n = 1")(
    lambda spark, sf: metrics.with_latest(service_table(spark, sf), samples(spark, sf)).select("ProcessId", "ServiceName", "HostName", F.col("LatestMiB").alias("latest_mib"))
)
for name in ("spark_points", "health_streak"):
    ORACLE_SQL[name] = ORACLE_SQL[name].replace(") , ", "), ")

# --- topics -------------------------------------------------------------------------------------------------------

M = f"WITH {MESSAGES_SQL} "
SEEK_TREE = And((Term("partition", "exact", 1), Term("timestamp", "between", (datetime(2024, 1, 5), datetime(2024, 1, 9))), Term("k", "gt", 40)))


@query("topic_seek", M + """SELECT Topic AS topic, Part AS part, Off AS off, Ts AS ts FROM messages WHERE Part = 1 AND Ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-09' AND CAST(json_extract_string(Payload, '$.k') AS DOUBLE) > 40""")
def topic_seek(spark, sf):
    where, rest = seek(SEEK_TREE)
    rows = topics.read(message_table(spark, sf), where, cap=None)
    return rows.where(column(rest, rows.schema, payload="Payload")).select(F.col("Topic").alias("topic"), F.col("Part").alias("part"), F.col("Off").alias("off"), F.col("Ts").alias("ts"))


query("topic_offsets_capped", M + "SELECT Topic AS topic, Part AS part, Off AS off FROM messages WHERE Topic = 'view' AND Off BETWEEN 10 AND 200 ORDER BY Ts, Topic, Part, Off LIMIT 100")(
    lambda spark, sf: topics.read(message_table(spark, sf), Seek(offset_from=10, offset_to=200), "view", 100).select(F.col("Topic").alias("topic"), F.col("Part").alias("part"), F.col("Off").alias("off"))
)
query("topic_latest_n", M + "SELECT Topic AS topic, Part AS part, Off AS off FROM (SELECT *, row_number() OVER (PARTITION BY Topic ORDER BY Ts DESC, Part DESC, Off DESC) AS n FROM messages) WHERE n <= 25")(
    lambda spark, sf: topics.latest(message_table(spark, sf), 25).select(F.col("Topic").alias("topic"), F.col("Part").alias("part"), F.col("Off").alias("off"))
)
query("topic_residual_json", M + "SELECT event_id FROM messages WHERE CAST(json_extract_string(Payload, '$.k') AS BIGINT) BETWEEN 10 AND 20 AND contains(Key, '1')")(
    lambda spark, sf: (lambda m: m.where(column(And((Term("k", "between", (10, 20)), Term("Key", "contains", "1"))), m.schema, payload="Payload")).select("event_id"))(message_table(spark, sf))
)
query("topic_fields", M + "SELECT event_id, CAST(json_extract_string(Payload, '$.k') AS BIGINT) AS k FROM messages")(lambda spark, sf: topics.named_fields(message_table(spark, sf), {"k": "$.k long"}).select("event_id", "k"))
query("topic_partition_stats", M + "SELECT Topic, Part, min(Off) AS low, max(Off) + 1 AS high, arg_min(Ts, Off) AS first_ts, arg_max(Ts, Off) AS last_ts, max(Off) + 1 - min(Off) AS n FROM messages GROUP BY 1, 2")(lambda spark, sf: topics.partition_stats(message_table(spark, sf)))
query("topic_stats", M + "SELECT Topic, count(DISTINCT Part) AS partitions, count(*) AS messages FROM messages GROUP BY 1")(lambda spark, sf: topics.topic_stats(message_table(spark, sf)))
COMMITS_SQL = """commits AS (SELECT 'g' || CAST(event_id % 3 AS VARCHAR) AS grp, Topic, Part, max(Off) - count(*) % 7 AS Committed FROM messages WHERE NOT (event_id % 3 = 1 AND Topic = 'view') AND NOT (event_id % 3 = 2 AND Part = 1) GROUP BY 1, 2, 3),
high AS (SELECT Topic, Part, max(Off) + 1 AS high FROM messages GROUP BY 1, 2)"""


def commits(messages: DataFrame) -> DataFrame:
    """Three groups that have read a third of the messages each; one hasn't begun a topic, one a partition."""
    third = F.col("event_id") % 3
    read = messages.where(~((third == 1) & (F.col("Topic") == "view")) & ~((third == 2) & (F.col("Part") == 1)))
    return read.groupBy(F.concat(F.lit("g"), third.cast("string")).alias("grp"), "Topic", "Part").agg((F.max("Off") - F.count("*") % 7).alias("Committed"))


LAG_SQL = M[:-1] + f""", {COMMITS_SQL}, lag AS (SELECT a.grp, a.Topic, CAST(sum(greatest(high - coalesce(Committed, 0), 0)) AS BIGINT) AS lag, count(*) AS partitions
FROM (SELECT DISTINCT grp, Topic FROM commits) a JOIN high USING (Topic) LEFT JOIN commits c ON c.grp = a.grp AND c.Topic = a.Topic AND c.Part = high.Part GROUP BY 1, 2) """
query("group_lag", LAG_SQL + "SELECT * FROM lag")(lambda spark, sf: (lambda m: topics.group_lag(m, commits(m)))(message_table(spark, sf)))
query("group_lag_all_topics", M[:-1] + f""", {COMMITS_SQL} SELECT a.grp, high.Topic, CAST(sum(greatest(high - coalesce(Committed, 0), 0)) AS BIGINT) AS lag, count(*) AS partitions
FROM (SELECT DISTINCT grp FROM commits) a CROSS JOIN high LEFT JOIN commits c ON c.grp = a.grp AND c.Topic = high.Topic AND c.Part = high.Part GROUP BY 1, 2""")(lambda spark, sf: (lambda m: topics.group_lag(m, commits(m), False))(message_table(spark, sf)))
query("group_overview", LAG_SQL + "SELECT grp, CAST(sum(lag) AS BIGINT) AS lag, count(*) AS n_topics, string_agg(Topic, ',' ORDER BY Topic) AS topics FROM lag GROUP BY 1")(lambda spark, sf: (lambda m: topics.group_overview(m, commits(m)))(message_table(spark, sf)))

# --- logs ---------------------------------------------------------------------------------------------------------

LINES_SQL = """WITH lines AS (SELECT event_type AS file, event_id AS line_no, CASE WHEN event_id % 5 IN (3, 4) THEN '  at step ' || CAST(event_id AS VARCHAR) ELSE
strftime(ts, '%Y-%m-%d %H:%M:%S') || '|' || CASE WHEN event_id % 3 = 0 THEN 'ERROR' ELSE 'INFO' END || '|host' || CAST(user_id % 4 AS VARCHAR) || '|' || CAST(user_id AS VARCHAR) || '|7|did ' || event_type || '|Caller' END AS line FROM events) """


def lines(spark, sf):
    e, i = table(spark, sf, "events"), F.col("event_id")
    full = F.concat_ws("|", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.when(i % 3 == 0, "ERROR").otherwise("INFO"), F.concat(F.lit("host"), (F.col("user_id") % 4).cast("string")), F.col("user_id").cast("string"), F.lit("7"), F.concat(F.lit("did "), "event_type"), F.lit("Caller"))
    return e.select(F.col("event_type").alias("file"), i.alias("line_no"), F.when((i % 5).isin(3, 4), F.concat(F.lit("  at step "), i.cast("string"))).otherwise(full).alias("line"))


PARSED = "split_part(line, '|', 2) AS level, split_part(line, '|', 3) AS host, coalesce(TRY_CAST(split_part(line, '|', 4) AS INTEGER), 0) AS pid, split_part(line, '|', 6) AS message"
query("log_parse_pipe", LINES_SQL + f"SELECT file, line_no, {PARSED} FROM lines WHERE contains(line, '|')")(lambda spark, sf: logs.parse(lines(spark, sf)).where("level IS NOT NULL").select("file", "line_no", "level", "host", "pid", "message"))
query("log_parse_template", LINES_SQL + f"SELECT file, line_no, {PARSED} FROM lines WHERE contains(line, '|')")(
    lambda spark, sf: logs.parse(lines(spark, sf), [logs.template("{timestamp}|{level}|{host}|{pid}|{thread}|{message}|{caller}")]).where("level IS NOT NULL").select("file", "line_no", "level", "host", "pid", "message")
)
ENTRIES_SQL = LINES_SQL[:-1] + """, n AS (SELECT *, CAST(sum(CASE WHEN regexp_matches(line, '^\\d{4}-\\d{2}-\\d{2} ') THEN 1 ELSE 0 END) OVER (PARTITION BY file ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS BIGINT) AS entry_no FROM lines),
entries AS (SELECT file, entry_no, arg_min(line, line_no) AS line, coalesce(string_agg(CASE WHEN starts_with(line, '  at') THEN line END, chr(10) ORDER BY line_no), '') AS continuation, CAST(count(*) AS INTEGER) AS n_lines FROM n WHERE entry_no > 0 GROUP BY 1, 2) """
query("log_entries", ENTRIES_SQL + "SELECT * FROM entries")(lambda spark, sf: logs.entries(lines(spark, sf)))
query("log_search_files", ENTRIES_SQL + "SELECT DISTINCT file FROM entries WHERE contains(lower(line), 'error') AND contains(continuation, '77')")(
    lambda spark, sf: logs.search_files(lines(spark, sf).select("file").distinct(), (lambda e: e.where(column(And((Term("line", "contains", "error"), Term("continuation", "contains", "77"))), e.schema)))(logs.entries(lines(spark, sf))))
)
METRIC_LINE = "strftime(ts, '%Y-%m-%d %H:%M:%S') || '|INFO|m|' || CAST(user_id AS VARCHAR) || '|1|Sending Metrics Tracker message now, current usage: ' || CAST(event_id * 10 AS VARCHAR) || ' byte, peak usage: ' || CAST(event_id * 20 AS VARCHAR) || ' byte, child usage: ' || CAST(event_id AS VARCHAR) || ', child peak usage: ' || CAST(event_id * 2 AS VARCHAR) || '|c'"


@query("metrics_line_parse", "SELECT event_id, date_trunc('second', ts) AS ts, event_id * 10 AS current_bytes, event_id * 20 AS peak_bytes, event_id AS child_bytes, event_id * 2 AS child_peak_bytes FROM events")
def metrics_line_parse(spark, sf):
    n = lambda k: (F.col("event_id") * k).cast("string")
    said = F.concat(F.lit("Sending Metrics Tracker message now, current usage: "), n(10), F.lit(" byte, peak usage: "), n(20), F.lit(" byte, child usage: "), n(1), F.lit(", child peak usage: "), n(2))
    line = F.concat_ws("|", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit("INFO"), F.lit("m"), F.col("user_id").cast("string"), F.lit("1"), said, F.lit("c"))
    return metrics.parse_metrics_lines(table(spark, sf, "events").select("event_id", line.alias("line")))


# --- scalars, JSON, documents -------------------------------------------------------------------------------------

query("labels_strip", """SELECT p_partkey, p_name AS raw, CASE WHEN s = '' THEN p_name ELSE s END AS label FROM (SELECT p_partkey, p_name, trim(regexp_replace(regexp_replace(replace(p_name, ' ', '__') || '-dev1', '(?i)dev1', '', 'g'), '([_-])[_-]+', '\\1', 'g'), ' -_') AS s FROM part)""")(
    lambda spark, sf: table(spark, sf, "part").select("p_partkey", F.col("p_name").alias("raw"), text.strip_label(F.concat(F.replace("p_name", F.lit(" "), F.lit("__")), F.lit("-dev1")), ["{EnvID}"], "Dev1").alias("label"))
)
query("topic_name", "SELECT p_partkey, replace(lower(p_type), ' ', '-') || '-events' AS topic FROM part")(lambda spark, sf: table(spark, sf, "part").select("p_partkey", text.topic_name(F.col("p_type")).alias("topic")))


@query(
    "formats",
    """SELECT p_partkey, CASE WHEN s >= 3600 THEN CAST(s // 3600 AS VARCHAR) || ':' || lpad(CAST(s % 3600 // 60 AS VARCHAR), 2, '0') ELSE CAST(s // 60 AS VARCHAR) END || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') AS clock,
CASE WHEN s < 60 THEN CAST(s AS VARCHAR) || 's ago' WHEN s < 3600 THEN CAST(s // 60 AS VARCHAR) || 'm ago' WHEN s < 86400 THEN CAST(s // 3600 AS VARCHAR) || 'h ago' ELSE CAST(s // 86400 AS VARCHAR) || 'd ago' END AS age,
CASE WHEN p_size < 1000 THEN CAST(p_size AS VARCHAR) || ' MB' END AS memory FROM (SELECT *, p_partkey * 37 AS s FROM part)""",
)
def formats(spark, sf):
    s = F.col("p_partkey") * 37
    return table(spark, sf, "part").select("p_partkey", text.clock(s).alias("clock"), text.age(s).alias("age"), text.memory(F.col("p_size").cast("double")).alias("memory"))


query("json_path_simple", "SELECT event_id, '[' || json_extract_string(props, '$.k') || ']' AS result, 1 AS n FROM events")(
    lambda spark, sf: table(spark, sf, "events").select("event_id", jsonpath.query(F.col("props"), "$.k").alias("q")).select("event_id", "q.result", "q.n")
)


@query("json_path_filter", "SELECT event_id, CASE WHEN CAST(json_extract_string(props, '$.k') AS INTEGER) < 50 THEN '[' || json_extract_string(props, '$.k') || ']' ELSE '[]' END AS result, CASE WHEN CAST(json_extract_string(props, '$.k') AS INTEGER) < 50 THEN 1 ELSE 0 END AS n FROM events")
def json_path_filter(spark, sf):
    doc = F.concat(F.lit('{"items":['), "props", F.lit("]}"))
    return table(spark, sf, "events").select("event_id", jsonpath.query(doc, "$.items[?(@.k < 50)].k").alias("q")).select("event_id", "q.result", "q.n")


@query("docs_page", "SELECT doc_id, n_chars, (SELECT count(*) FROM documents WHERE lang = 'en' AND n_chars > 500) AS total FROM documents WHERE lang = 'en' AND n_chars > 500 ORDER BY n_chars DESC, doc_id LIMIT 20 OFFSET 40")
def docs_page(spark, sf):
    d = table(spark, sf, "documents").where("lang = 'en' AND n_chars > 500").select("doc_id", "n_chars")
    return runs.page(d, [F.desc("n_chars"), "doc_id"], 3, 20).select("doc_id", "n_chars", d.agg(F.count("*")).scalar().alias("total"))


@query("docs_raw_match", "SELECT event_id FROM events WHERE (event_type IN ('click', 'view') AND value >= 50) OR NOT (user_id <> 7) OR regexp_matches(event_type, '^sig')")
def docs_raw_match(spark, sf):
    e = table(spark, sf, "events")
    match = {"$or": [{"event_type": {"$in": ["click", "view"]}, "value": {"$gte": 50}}, {"user_id": {"$not": {"$ne": 7}}}, {"event_type": {"$regex": "^sig"}}]}
    return e.where(match_column(match, e.schema)).select("event_id")


from tidewatch.plans import further as _further  # noqa: E402, F401  their queries register themselves
from tidewatch.plans import more as _more  # noqa: E402, F401
