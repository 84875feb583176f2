"""Further registered queries: sources, filters, sorts, caps, scalars and states that `queries` doesn't use on its way."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewatch.filters.predicates import And, Not, Or, Term, TimeOfDay, collection_filter, column, document_column, from_json, glob_pattern, moment, to_json
from tidewatch.functions import protobuf, text
from tidewatch.operators import events as ev
from tidewatch.operators import graph, logs, metrics, runs, topics, topology
from tidewatch.plans.queries import AS_OF, EDGE_COLUMNS, EVENT_AS_OF, FORWARD_SQL, LINES_SQL, POINTS_SQL, RUN_EVENTS_SQL, SAMPLES_SQL, E, M, R, S, env_runs, filtered, lines, query, run_events, samples
from tidewatch.session import table
from tidewatch.sources import catalog, config
from tidewatch.sources.adapters import events as event_table
from tidewatch.sources.adapters import messages as message_table
from tidewatch.sources.adapters import services, stored_events
from tidewatch.sources.adapters import runs as run_table
from tidewatch.streaming import events as streams

# --- filters ------------------------------------------------------------------------------------------------------

NOW = datetime(1998, 6, 15, 13, 30)
filtered("runs_contains_number", Term("RunId", "contains", 42), "contains(RunId, '42')")
filtered("runs_time_of_day", Or((Term("Start", "ge", TimeOfDay(1)), Term("End", "between", (TimeOfDay(0), TimeOfDay(0))))), """epoch("Start") % 86400 >= 1 OR epoch("End") % 86400 = 0""")
filtered("runs_date_words", And((Term("Start", "ge", moment("-30d", NOW)), Term("Start", "lt", moment("2d", NOW)))), """"Start" >= TIMESTAMP '1998-05-16 13:30:00' AND "Start" < TIMESTAMP '1998-06-17'""")
filtered("runs_filter_json", from_json(to_json(And((Term("Type", "contains", "low"), Not(Or((Term("Status", "exact", "Failed"), Term("End", "gt", datetime(1997, 1, 1))))))))), """contains(lower(Type), 'low') AND NOT (Status = 'Failed' OR coalesce("End" > TIMESTAMP '1997-01-01', false))""")


@query("runs_sql_mode", R + """SELECT RunId AS run_id FROM runs WHERE "Start" = TIMESTAMP '1998-01-01' OR NOT ("End" > TIMESTAMP '1996-01-01')""")
def runs_sql_mode(spark, sf):
    """Dates compare equal there, and a negated comparison with null is no match."""
    rows = run_table(spark, sf)
    return rows.where(column(Or((Term("Start", "exact", datetime(1998, 1, 1)), Not(Term("End", "gt", datetime(1996, 1, 1))))), rows.schema, mode="sql")).select(F.col("RunId").alias("run_id"))


query("parts_unanchored_glob", "SELECT p_partkey FROM part WHERE regexp_matches(lower(p_name), 'a.*e')")(lambda spark, sf: table(spark, sf, "part").where(F.col("p_name").rlike(glob_pattern("A*e", anchored=False))).select("p_partkey"))
query("collections_filter", "SELECT n_nationkey FROM nation WHERE contains(lower(n_name), 'n_1')")(
    lambda spark, sf: (lambda d: d.where(column(collection_filter(" N_1 "), d.schema)).select("n_nationkey"))(table(spark, sf, "nation").withColumnRenamed("n_name", "name"))
)
query("documents_key_pattern", "SELECT event_id FROM events WHERE regexp_matches(CAST(event_id AS VARCHAR), '7.*7') OR contains(CAST(user_id AS VARCHAR), '[')")(
    lambda spark, sf: (lambda d: d.where(document_column("7.*7", d.schema) | document_column("[", d.schema, key="user_id")).select("event_id"))(table(spark, sf, "events").withColumn("_id", F.col("event_id")))
)
query("folders_kept", "WITH p AS (SELECT DISTINCT n_regionkey AS a, n_name AS b FROM nation), l AS (SELECT 'r' || a AS path FROM p UNION SELECT 'r' || a || '/' || b FROM p), h AS (SELECT path FROM l WHERE contains(path, 'N_1')) SELECT path FROM l WHERE EXISTS (SELECT 1 FROM h WHERE h.path = l.path OR starts_with(h.path, l.path || '/'))")(
    lambda spark, sf: (lambda n: logs.kept_folders(n.select("top").union(n.select(F.concat_ws("/", "top", "n_name"))).distinct().withColumnRenamed("top", "path"), F.contains("path", F.lit("N_1"))))(table(spark, sf, "nation").withColumn("top", F.concat(F.lit("r"), F.col("n_regionkey").cast("string"))))
)

# --- runs and documents -------------------------------------------------------------------------------------------


@query("docs_time", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_orderdate WHEN o_orderstatus = 'O' THEN o_orderdate + INTERVAL 1 DAY END AS at FROM orders")
def docs_time(spark, sf):
    o = table(spark, sf, "orders")
    at = F.col("o_orderdate")
    d = o.select("o_orderkey", F.when(F.col("o_orderstatus") == "F", at).alias("timestamp"), at.cast("string").alias("createdAt"), F.when(F.col("o_orderstatus") == "O", at + F.make_dt_interval(days=F.lit(1))).alias("updatedAt"))
    return d.select("o_orderkey", runs.document_time(d).alias("at"))


@query("runs_document_scan", R + """SELECT RunId AS run_id, "End" AS end_ts FROM runs WHERE "Start" < TIMESTAMP '2001-08-01' AND (regexp_matches(RunId, '7.$|ORDER-1.*5$', 'i') OR regexp_matches(Description, '7.$|ORDER-1.*5$', 'i')) AND Status IN ('Failed', 'Completed') ORDER BY "End" DESC NULLS LAST, RunId LIMIT 200""")
def runs_document_scan(spark, sf):
    documents = run_table(spark, sf).withColumn("RequestId", F.col("Description"))
    ask = runs.RunFilter(text="7.$|ORDER-1.*5$", statuses=("Failed", "Completed"), sort="EndTime")
    return runs.document_listing(documents, datetime(2001, 8, 1), 200, ask).select(F.col("RunId").alias("run_id"), F.col("End").alias("end_ts"))


query("runstats_local_day", R + f"""SELECT strftime("Start" AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York', '%Y-%m-%d') AS bucket, round(avg(CAST(epoch(coalesce("End", TIMESTAMP '{AS_OF}')) - epoch("Start") AS DOUBLE)), 3) AS avg_seconds,
count(*) AS runs, count(*) FILTER (Status = 'Failed') AS failed, round(count(*) FILTER (Status = 'Failed') / count(*), 6) AS fail_rate FROM runs JOIN customer ON Cust = c_custkey GROUP BY 1""")(
    lambda spark, sf: runs.statistics(env_runs(spark, sf), "day", AS_OF, by_env=False, zone="America/New_York")
)
query("jobs_matching", "SELECT p_partkey FROM part WHERE p_brand = 'Brand#12' AND (contains(lower(p_name), 'bolt') OR contains(lower(p_type), 'bolt') OR contains(lower(CAST(p_size AS VARCHAR)), 'bolt'))")(
    lambda spark, sf: config.matching_jobs(table(spark, sf, "part").select("p_partkey", F.col("p_name").alias("name"), F.col("p_type").alias("description"), F.col("p_brand").alias("category"), F.array(F.col("p_size").cast("string")).alias("tags")), "BRAND#12", "Bolt").select("p_partkey")
)
query("jobs_categories", "SELECT DISTINCT p_brand AS category FROM part")(lambda spark, sf: config.categories(table(spark, sf, "part").select(F.col("p_brand").alias("category"))))

# --- events -------------------------------------------------------------------------------------------------------

@query("events_safety_lag", """SELECT event_id FROM events WHERE event_id > 100 AND ts < TIMESTAMP '2024-01-20' - INTERVAL 1 HOUR""")
def events_safety_lag(spark, sf):
    log = table(spark, sf, "events").select("event_id", "ts")
    return ev.since(log, ev.Cursor(100), datetime(2024, 1, 20), timedelta(hours=1), "event_id", "ts").select("event_id")


@query(
    "events_of_run",
    E + """SELECT Id AS id, Name AS name, "Start" AS start_ts, coalesce(RecordCount, 0) AS records, '' AS source FROM ev WHERE Service = 'svc-3' AND "Start" >= TIMESTAMP '1998-03-01'""",
)
def events_of_run(spark, sf):
    """One of five runs, from a moment on."""
    rows = ev.run_events_scan(event_table(spark, sf).withColumn("RunId", F.col("Service")), "svc-3", datetime(1998, 3, 1))
    return rows.select(F.col("Id").alias("id"), F.col("Name").alias("name"), F.col("Start").alias("start_ts"), F.col("RecordCount").alias("records"), F.col("Source").alias("source"))


query("events_log_rows", E + "SELECT Id AS id, Error AS error, NULLIF(CASE WHEN RecordCount % 2 = 0 THEN '' ELSE Service END, '') AS service FROM ev")(
    lambda spark, sf: ev.to_log(event_table(spark, sf).select(F.col("Id").alias("id"), F.coalesce("Error", F.lit("")).alias("error"), F.when(F.col("RecordCount") % 2 == 0, "").otherwise(F.col("Service")).alias("service")))
)
query("events_merged_sources", E + """SELECT Id AS id, CASE WHEN RecordCount % 2 = 0 THEN "Start" + INTERVAL 1 DAY ELSE "Start" END AS start_ts, CASE WHEN RecordCount % 2 = 0 THEN 'b' ELSE 'a' END AS origin FROM ev""")(
    lambda spark, sf: (
        lambda e: ev.merge_sources(e.withColumn("origin", F.lit("a")), e.where("RecordCount % 2 = 0").withColumns({"Start": F.col("Start") + F.make_dt_interval(days=F.lit(1)), "origin": F.lit("b")}).drop("Error")).select(
            F.col("Id").alias("id"), F.col("Start").alias("start_ts"), "origin"
        )
    )(stored_events(spark, sf))
)
query("event_keys", E + "SELECT Id AS id, Service || ':' || Pipeline || ':' || CAST(ProcessId AS VARCHAR) AS key, CASE WHEN coalesce(Error, '') <> '' THEN 'error' WHEN Finish IS NOT NULL THEN 'done' ELSE 'inprogress' END AS state FROM ev")(
    lambda spark, sf: event_table(spark, sf).select(F.col("Id").alias("id"), text.composite_key(F.col("Service"), F.col("Pipeline"), F.col("ProcessId").cast("string")).alias("key"), text.progress_text(F.col("Finish"), F.col("Error")).alias("state"))
)
query("target_kinds", RUN_EVENTS_SQL + "SELECT Target, count(*) FILTER (Kind = 'Produce') AS produced, count(*) FILTER (Kind = 'Consume') AS consumed FROM run_events GROUP BY 1")(
    lambda spark, sf: run_events(spark, sf).groupBy("Target").agg(F.count_if(F.col("Kind") == "Produce").alias("produced"), F.count_if(F.col("Kind") == "Consume").alias("consumed"))
)
query("slider_positions", E + """SELECT Id AS id, round(least(greatest((epoch("Start") - epoch(TIMESTAMP '1995-01-01')) / (epoch(TIMESTAMP '1999-01-01') - epoch(TIMESTAMP '1995-01-01')), 0), 1), 6) AS at FROM ev""")(
    lambda spark, sf: event_table(spark, sf).select(
        F.col("Id").alias("id"), F.round(text.position(*(F.unix_seconds(c.cast("timestamp")) for c in (F.col("Start"), F.lit("1995-01-01").cast("timestamp_ntz"), F.lit("1999-01-01").cast("timestamp_ntz")))), 6).alias("at")
    )
)

# --- graphs -------------------------------------------------------------------------------------------------------

LAYERS_SQL = FORWARD_SQL.replace("WITH ", "WITH RECURSIVE ", 1)[:-1] + """, walk(node, layer) AS (SELECT DISTINCT source, 0 FROM fwd UNION SELECT fwd.target, walk.layer + 1 FROM walk JOIN fwd ON walk.node = fwd.source), layers AS (SELECT node, max(layer) AS layer FROM walk GROUP BY 1) """


def forward(spark, sf):
    return graph.forward_edges(topology.edges(stored_events(spark, sf, *EDGE_COLUMNS)))


query("layout_stops", LAYERS_SQL + "SELECT f.source, f.target, CAST(unnest(range(a.layer + 1, b.layer)) AS INTEGER) AS layer FROM fwd f JOIN layers a ON a.node = f.source JOIN layers b ON b.node = f.target WHERE b.layer > a.layer + 1")(
    lambda spark, sf: (lambda f: graph.long_edge_stops(f, graph.layers(f)))(forward(spark, sf))
)


@query("layout_pinned", LAYERS_SQL + """, roles AS (SELECT 'svc-' || CAST(r_regionkey AS VARCHAR) AS node, CASE WHEN r_regionkey % 2 = 0 THEN 'sink' ELSE 'source' END AS role FROM region)
SELECT node, CAST(CASE WHEN role = 'source' AND node NOT IN (SELECT target FROM fwd) THEN 0 WHEN role = 'sink' AND node NOT IN (SELECT source FROM fwd) THEN (SELECT max(layer) FROM layers) ELSE layer END AS INTEGER) AS layer FROM layers LEFT JOIN roles USING (node)""")
def layout_pinned(spark, sf):
    f, r = forward(spark, sf), F.col("r_regionkey")
    roles = table(spark, sf, "region").select(F.concat(F.lit("svc-"), r.cast("string")).alias("node"), F.when(r % 2 == 0, "sink").otherwise("source").alias("role"))
    return graph.pinned(graph.layers(f), roles, f)


# --- services and memory ------------------------------------------------------------------------------------------

query("svc_oldest_start", S + "SELECT min(Created) AS oldest FROM services")(lambda spark, sf: metrics.oldest_start(services(spark, sf)))
query("svc_sort_peak", S + "SELECT ProcessId, PeakMb FROM services ORDER BY coalesce(PeakMb, 0) DESC, ServiceName, HostName, ProcessId LIMIT 15")(lambda spark, sf: metrics.sorted_services(services(spark, sf), "peak", True).limit(15).select("ProcessId", "PeakMb"))
query("svc_sort_started", S + "SELECT ProcessId, Created FROM services ORDER BY Created, ServiceName, HostName, ProcessId LIMIT 15")(lambda spark, sf: metrics.sorted_services(services(spark, sf), "started").limit(15).select("ProcessId", "Created"))
query("svc_alive", S + "SELECT ProcessId, epoch(TIMESTAMP '2024-01-31') - epoch(Updated) <= 30 AS IsOnline FROM services")(lambda spark, sf: streams.alive(services(spark, sf), EVENT_AS_OF).select("ProcessId", "IsOnline"))
query("mem_trailing", SAMPLES_SQL + "SELECT key, id, ts FROM samples WHERE ts >= TIMESTAMP '2024-01-31' - INTERVAL 36 HOUR")(lambda spark, sf: metrics.trailing(samples(spark, sf), EVENT_AS_OF, 36).select("key", "id", "ts"))
query("mem_matched", S[:-1] + """, m AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN upper(HostName) ELSE lower(HostName) END AS host, CASE WHEN event_id % 7 = 0 THEN 'none' ELSE ServiceName END AS service, CAST(ProcessId AS VARCHAR) AS instance FROM events JOIN services ON ProcessId = user_id)
SELECT event_id, s.ProcessId FROM m JOIN services s ON lower(host) = lower(s.HostName) AND lower(service) = lower(s.ServiceName) AND instance = CAST(s.ProcessId AS VARCHAR)""")(
    lambda spark, sf: (
        lambda s, e: metrics.matched_samples(
            e.join(s, F.col("user_id") == F.col("ProcessId")).select("event_id", F.when(F.col("event_id") % 3 == 0, F.upper("HostName")).otherwise(F.lower("HostName")).alias("host"), F.when(F.col("event_id") % 7 == 0, "none").otherwise(F.col("ServiceName")).alias("service"), F.col("ProcessId").cast("string").alias("instance")),
            s.withColumn("ServiceInstanceId", F.col("ProcessId").cast("string")),
        ).select("event_id", "ProcessId")
    )(services(spark, sf), table(spark, sf, "events"))
)
query("mem_stacked", POINTS_SQL.replace("SELECT key AS series,", "SELECT grp AS series,")[:-1] + """, g AS (SELECT s.series, t.ts, p.value FROM (SELECT DISTINCT series FROM points) s CROSS JOIN (SELECT DISTINCT ts FROM points) t LEFT JOIN points p ON p.series = s.series AND p.ts = t.ts),
n AS (SELECT *, last_value(CASE WHEN value IS NOT NULL THEN ts END IGNORE NULLS) OVER a AS t1, last_value(value IGNORE NULLS) OVER a AS v1, first_value(CASE WHEN value IS NOT NULL THEN ts END IGNORE NULLS) OVER b AS t2, first_value(value IGNORE NULLS) OVER b AS v2 FROM g
WINDOW a AS (PARTITION BY series ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b AS (PARTITION BY series ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
i AS (SELECT series, ts, round(CASE WHEN t1 IS NULL THEN v2 WHEN t2 IS NULL OR t1 = t2 THEN v1 ELSE v1 + (v2 - v1) * ((ts - t1) / (t2 - t1)) END, 6) AS value FROM n)
SELECT series, ts, round(sum(value) OVER (PARTITION BY ts ORDER BY series) - value, 6) AS low, round(sum(value) OVER (PARTITION BY ts ORDER BY series), 6) AS high, round(sum(value) OVER (PARTITION BY ts), 6) AS top FROM i""")(
    lambda spark, sf: metrics.stacked(
        metrics.interpolated(samples(spark, sf).groupBy(F.col("grp").alias("series"), F.unix_millis(F.date_trunc("hour", "ts").cast("timestamp")).alias("ts")).agg(F.avg(F.col("id").cast("double")).alias("value")))
    )
)
query("mem_backfilled", SAMPLES_SQL[:-1] + """, live AS (SELECT key, ts, id FROM samples WHERE ts >= TIMESTAMP '2024-01-10' AND grp <> 'view'), f AS (SELECT key, min(ts) AS first FROM live GROUP BY 1),
a AS (SELECT key, ts, id FROM live UNION ALL SELECT s.key, s.ts, s.id FROM samples s LEFT JOIN f ON f.key = s.key WHERE first IS NULL OR s.ts < first) SELECT key, count(DISTINCT ts) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM a GROUP BY 1""")(
    lambda spark, sf: (
        lambda s: streams.with_backfill(s.where("ts >= TIMESTAMP_NTZ '2024-01-10' AND grp != 'view'").select("key", "ts", "id"), s.select("key", "ts", "id")).groupBy("key").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    )(samples(spark, sf))
)
query("broker_status", SAMPLES_SQL[:-1] + """, c AS (SELECT key, ts, id, CAST(id % 4 AS INTEGER) AS online FROM samples), i AS (SELECT *, sum(CASE WHEN online > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS island FROM c),
s AS (SELECT *, sum(CASE WHEN online > 0 THEN 0 ELSE 1 END) OVER (PARTITION BY key, island ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS streak FROM i)
SELECT key, ts, id, CASE WHEN online BETWEEN 1 AND 2 THEN 'Degraded' WHEN streak = 0 THEN 'Healthy' WHEN streak = 1 THEN 'Degraded' WHEN streak >= 3 THEN 'Down' ELSE 'DegradedEscalating' END AS status FROM s""")(
    lambda spark, sf: metrics.broker_health(samples(spark, sf).select("key", "ts", "id", (F.col("id") % 4).alias("online"), F.lit(3).alias("total")))
)
query("payload_values", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")(lambda spark, sf: table(spark, sf, "events").select("event_id", metrics.payload_value(F.col("props"), "K", "long").alias("k")))

# --- topics -------------------------------------------------------------------------------------------------------

query("topic_fetch", M + "SELECT event_id, Payload AS payload FROM messages WHERE Topic = 'click' AND Part = 2 AND Off = 7")(lambda spark, sf: topics.fetch(message_table(spark, sf), "click", 2, 7).select("event_id", F.col("Payload").alias("payload")))
query("topic_sort", M + "SELECT Topic, count(DISTINCT Part) AS partitions, count(*) AS messages FROM messages GROUP BY 1 ORDER BY messages DESC, Topic LIMIT 3")(lambda spark, sf: topics.sorted_topics(topics.topic_stats(message_table(spark, sf)), "MessageCount", True).limit(3))
query("topic_configs", M + "SELECT Topic, count(DISTINCT Part) AS partitions, CASE WHEN Topic < 'm' THEN 'delete' END AS policy, CASE WHEN Topic < 'm' THEN CAST(length(Topic) AS VARCHAR) END AS retention FROM messages GROUP BY 1")(
    lambda spark, sf: (
        lambda t: topics.with_configs(t, t.where("Topic < 'm'").select("Topic", F.explode(F.create_map(F.lit("policy"), F.lit("delete"), F.lit("retention"), F.length("Topic").cast("string"))).alias("name", "value"))).select(
            "Topic", "partitions", F.col("config")["policy"].alias("policy"), F.col("config")["retention"].alias("retention")
        )
    )(topics.topic_stats(message_table(spark, sf)))
)
query("topic_buffer", M + "SELECT event_id, Ts AS ts FROM messages ORDER BY Ts DESC, Topic DESC, Part DESC, Off DESC LIMIT 500")(lambda spark, sf: topics.buffered(message_table(spark, sf), 500).select("event_id", F.col("Ts").alias("ts")))
query("topic_payload_types", M + "SELECT CASE WHEN Topic <> 'view' THEN Topic END AS payload_type, count(*) AS n, coalesce(CASE WHEN Topic <> 'view' THEN Topic END = 'click', false) AS wanted FROM messages GROUP BY 1, 3")(
    lambda spark, sf: topics.payload_types(message_table(spark, sf), "CLICK", F.when(F.col("Topic") != "view", F.col("Topic")))
)
query("topic_decoded", M + """SELECT event_id, CASE WHEN starts_with(Topic, 'c') THEN CASE WHEN Part = 0 THEN 'first' WHEN Part < 3 THEN 'second' ELSE '{"type":"unknown","sizeBytes":' || CAST(strlen(Payload) AS VARCHAR) || '}' END WHEN Topic = 'view' THEN 'view' ELSE '{"type":"unknown","sizeBytes":' || CAST(strlen(Payload) AS VARCHAR) || '}' END AS json FROM messages""")(
    lambda spark, sf: protobuf.by_topic(
        message_table(spark, sf).withColumn("Value", F.col("Payload").cast("binary")),
        [("c%", [F.when(F.col("Part") == 0, "first"), F.when(F.col("Part") < 3, "second")]), ("view", [F.lit("view")])],
    ).select("event_id", F.col("Json").alias("json"))
)

# --- logs and files -----------------------------------------------------------------------------------------------

FILES_SQL = "WITH files AS (SELECT event_type || '/' || CAST(user_id AS VARCHAR) || '.log' AS FullPath, 'host-' || CAST(user_id % 3 AS VARCHAR) AS Server, CAST(user_id AS VARCHAR) || '.log' AS FileName, count(*) AS SizeBytes, min(ts) AS CreatedUtc, max(ts) AS ModifiedUtc FROM events GROUP BY event_type, user_id) "


def files(spark, sf):
    u = F.col("user_id").cast("string")
    name = F.concat(u, F.lit(".log"))
    grouped = table(spark, sf, "events").groupBy(F.concat_ws("/", "event_type", name).alias("FullPath"), F.concat(F.lit("host-"), (F.col("user_id") % 3).cast("string")).alias("Server"), name.alias("FileName"))
    return grouped.agg(F.count("*").alias("SizeBytes"), F.min("ts").alias("CreatedUtc"), F.max("ts").alias("ModifiedUtc"))


query("files_sorted", FILES_SQL + "SELECT FullPath, SizeBytes FROM files ORDER BY SizeBytes DESC, FullPath LIMIT 40")(lambda spark, sf: logs.sorted_files(files(spark, sf), "size", True, 40).select("FullPath", "SizeBytes"))
query("files_newest", FILES_SQL + "SELECT FullPath, ModifiedUtc FROM files ORDER BY ModifiedUtc DESC, FullPath LIMIT 40")(lambda spark, sf: logs.sorted_files(files(spark, sf), most=40).select("FullPath", "ModifiedUtc"))
query("files_found_capped", FILES_SQL + "SELECT FullPath, (SELECT count(*) FROM files WHERE SizeBytes > 5) > 30 AS capped FROM files WHERE SizeBytes > 5 ORDER BY FullPath LIMIT 30")(
    lambda spark, sf: (lambda f: logs.found_files(f, f.where("SizeBytes > 5").select(F.col("FullPath").alias("file")), 30).select("FullPath", "capped"))(files(spark, sf))
)
query("files_of_servers", FILES_SQL + "SELECT arg_min(FileName, Server) AS name FROM files GROUP BY lower(FileName)")(
    lambda spark, sf: (lambda f: logs.merge_folders(*(f.where(F.col("Server") == h).select(F.col("Server").alias("server"), F.col("FileName").alias("name")) for h in ("host-0", "host-1", "host-2"))))(files(spark, sf))
)


@query(
    "files_newest_by_pattern",
    FILES_SQL[:-1] + """, p AS (SELECT r_regionkey AS key, 0 AS idx, 'none-' || CAST(r_regionkey AS VARCHAR) || '*' AS g FROM region UNION ALL SELECT r_regionkey, 1, 'V?EW/' || CAST(r_regionkey AS VARCHAR) || '*.log' FROM region UNION ALL SELECT r_regionkey, 2, '*' FROM region)
SELECT key, arg_max(FullPath, (-idx, ModifiedUtc, FullPath)) AS FullPath FROM p JOIN files ON lower(FullPath) LIKE replace(replace(lower(g), '*', '%'), '?', '_') GROUP BY 1""",
)
def files_newest_by_pattern(spark, sf):
    key = F.col("r_regionkey")
    globs = [F.concat(F.lit("none-"), key.cast("string"), F.lit("*")), F.concat(F.lit("V?EW/"), key.cast("string"), F.lit("*.log")), F.lit("*")]
    patterns = table(spark, sf, "region").select(key.alias("key"), F.posexplode(F.array(*globs)).alias("idx", "pattern"))
    return logs.newest_file(files(spark, sf), patterns)


query("log_match_counts", LINES_SQL + "SELECT file, count(*) AS n FROM lines WHERE contains(lower(line), 'did') AND contains(lower(line), 'error|host1') GROUP BY 1")(
    lambda spark, sf: logs.match_counts(lines(spark, sf).where(F.contains("line", F.lit("did"))), "line", "error|HOST1")
)
query("log_searched", LINES_SQL + "SELECT file, line_no, replace(line, 'ERROR', '«ERROR»') AS highlighted FROM lines WHERE contains(line, 'ERROR')")(
    lambda spark, sf: logs.search(lines(spark, sf), "line", "ERROR", case_sensitive=True).select("file", "line_no", "highlighted")
)


@query("log_parse_spaced", LINES_SQL + "SELECT file, line_no, split_part(line, '|', 2) AS level, CASE WHEN line_no % 2 = 0 THEN '' ELSE split_part(line, '|', 6) END AS message FROM lines WHERE contains(line, '|')")
def log_parse_spaced(spark, sf):
    """Lines of two shapes, with blanks around their fields."""
    given, part = lines(spark, sf).where(F.contains("line", F.lit("|"))), lambda i: F.get(F.split("line", r"\|"), F.lit(i))
    bracketed = F.concat(F.lit("["), part(1), F.lit(" ] <"), part(2), F.lit("> rest"))
    mixed = given.withColumn("line", F.when(F.col("line_no") % 2 == 0, bracketed).otherwise(F.replace("line", F.lit("|"), F.lit(" | "))))
    return logs.parse(mixed, [logs.template("[{level}] <{host}> {*}{$}")]).select("file", "line_no", "level", "message")


# --- scalars ------------------------------------------------------------------------------------------------------

query("column_nulls", S + "SELECT 'RamMb' AS column, count(*) FILTER (RamMb IS NULL) AS nulls FROM services UNION ALL SELECT 'PeakMb', count(*) FILTER (PeakMb IS NULL) FROM services UNION ALL SELECT 'ProcessId', 0")(
    lambda spark, sf: catalog.column_stats(services(spark, sf)).where(F.col("column").isin("RamMb", "PeakMb", "ProcessId")).select("column", "nulls")
)
query("palette", "SELECT n_nationkey, CAST(abs(list_reduce(list_prepend(0::BIGINT, list_transform(string_split(n_name, ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda h, c: (((h * 31 + c + 2147483648) % 4294967296 + 4294967296) % 4294967296) - 2147483648)) % 12 AS BIGINT) AS place FROM nation")(
    lambda spark, sf: table(spark, sf, "nation").select("n_nationkey", text.palette_index(F.col("n_name"), 12).alias("place"))
)
query("natural_order", "SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS place FROM customer")(
    lambda spark, sf: table(spark, sf, "customer").select("c_nationkey", "c_custkey", F.row_number().over(Window.partitionBy("c_nationkey").orderBy(text.natural_key(F.concat(F.lit("Customer "), F.col("c_custkey").cast("string"), F.lit(" end"))))).cast("long").alias("place"))
)
query("memory_texts", "SELECT p_partkey, CASE WHEN p_partkey * 3 < 1000 THEN printf('%.0f MB', CAST(p_partkey * 3 AS DOUBLE)) ELSE printf('%.1f GB', round(p_partkey * 3 / 1024, 1)) END AS memory, round(p_partkey / 1048576, 9) AS mib, round(p_partkey / 1e6, 9) AS mb FROM part")(
    lambda spark, sf: table(spark, sf, "part").select("p_partkey", text.memory((F.col("p_partkey") * 3).cast("double")).alias("memory"), F.round(text.mib(F.col("p_partkey")), 9).alias("mib"), F.round(text.mb(F.col("p_partkey")), 9).alias("mb"))
)
