"""Service liveness and memory metrics.

Samples have: key, ts, current and child (bytes), and an id that orders samples of one moment by arrival.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HISTORY, INTERVAL_SECONDS = 1000, 15


def online(updated: Column, as_of: str, threshold_seconds: int = 0) -> Column:
    """Seen within the threshold, or within two intervals if that is 0."""
    age = F.unix_seconds(F.lit(as_of).cast("timestamp")) - F.unix_seconds(updated.cast("timestamp"))
    return age <= (threshold_seconds or 2 * INTERVAL_SECONDS)


def heartbeats(services: DataFrame, as_of: str, minutes: int = 30) -> DataFrame:
    """Services seen since some minutes ago, the latest first, with whether they are online."""
    start = F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(mins=F.lit(minutes))
    return services.where(F.col("Updated") >= start).withColumn("IsOnline", online(F.col("Updated"), as_of)).orderBy(F.desc("Updated"), "ProcessId")


def sorted_services(services: DataFrame, key: str, descending: bool = False) -> DataFrame:
    """By name, host, pid, updated, started, memory or peak (null counts as 0), else by name."""
    columns = {"host": "HostName", "pid": "ProcessId", "updated": "Updated", "started": "Created", "mem": "RamMb", "peak": "PeakMb"}
    c = F.col(columns.get(key, "ServiceName"))
    by = F.coalesce(c, F.lit(0.0)) if key in ("mem", "peak") else F.upper(c) if key not in ("pid", "updated", "started") else c
    return services.orderBy(by.desc() if descending else by.asc(), "ServiceName", "HostName", "ProcessId")


def oldest_start(services: DataFrame) -> DataFrame:
    """One row: the earliest process start, from which metrics are read; null without services."""
    return services.agg(F.min("Created").alias("oldest"))


def groups(services: DataFrame, by: str) -> DataFrame:
    """Services counted by a column with the sum and mean of their memory, null as 0."""
    ram = F.coalesce("RamMb", F.lit(0.0))
    return services.groupBy(F.col(by).alias("grp")).agg(F.count("*").alias("n"), F.round(F.sum(ram), 4).alias("sum_mb"), F.round(F.avg(ram), 4).alias("avg_mb"))


def treemap(services: DataFrame) -> DataFrame:
    """Each host with its services as an array, the largest first."""
    ram = F.coalesce("RamMb", F.lit(0.0))
    item = F.struct((-ram).alias("order"), F.col("ProcessId").alias("pid"), F.col("ServiceName").alias("service"), F.col("RamMb").alias("ram"))
    return services.groupBy(F.col("HostName").alias("host")).agg(F.sort_array(F.collect_list(item)).alias("items"))


def treemap_rows(services: DataFrame) -> DataFrame:
    """The treemap's leaves, numbered within their host."""
    leaf = treemap(services).select("host", F.posexplode("items").alias("rank", "item"))
    return leaf.select("host", "rank", "item.pid", "item.service", F.round("item.ram", 4).alias("ram"))


def latest(samples: DataFrame) -> DataFrame:
    """The last sample of each key; of one moment, the last to arrive."""
    order = Window.partitionBy("key").orderBy(F.desc("ts"), F.desc("id"))
    return samples.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def history(samples: DataFrame, keep: int = HISTORY) -> DataFrame:
    """The newest samples of each key, one for each moment."""
    return newest_samples(samples, keep).drop("id")


def newest_samples(samples: DataFrame, keep: int, *key: str) -> DataFrame:
    """The columns of key (`key`), ts, id, current and child of each key's newest samples; of one moment the last to arrive (id)."""
    key = key or ("key",)
    once = samples.groupBy(*key, "ts").agg(F.max("id").alias("id"), F.max_by("current", "id").alias("current"), F.max_by("child", "id").alias("child"))
    order = Window.partitionBy(*key).orderBy(F.desc("ts"))
    return once.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= keep).drop("_n")


def series(samples: DataFrame, group: str) -> DataFrame:
    """Memory of a group at each moment that any of its members reports, in MB."""
    rows = samples.groupBy(F.col(group).alias("grp"), "ts").agg(F.sum("current").alias("main"), F.sum("child").alias("child"))
    return rows.select("grp", "ts", F.round((F.col("main") + F.col("child")) / 1e6, 6).alias("mb"), F.round(F.col("child") / 1e6, 6).alias("child_mb"))


def legend(samples: DataFrame, group: str | None = None) -> DataFrame:
    """Members, sum and mean of the latest values of each group, in MB; without a group each process is one."""
    group = group or "key"
    mb = (F.col("current") + F.col("child")) / 1e6
    return latest(samples).groupBy(F.col(group).alias("grp")).agg(F.count("*").alias("members"), F.round(F.sum(mb), 6).alias("sum_mb"), F.round(F.avg(mb), 6).alias("avg_mb"))


def interpolated(points: DataFrame) -> DataFrame:
    """Each series at the moments of all series: linear between its own points, its end values beyond them.

    points: series, ts (milliseconds), value, one row for each series and moment. The moments are joined by hour, with
    the points before and after carried along, so a series' moments needn't stand in one window; a gap is carried only to hours that have a moment.
    """
    own = Window.partitionBy("series").orderBy("ts")
    spans = points.select("series", "ts", "value", F.lead("ts").over(own).alias("ts2"), F.lead("value").over(own).alias("value2"), F.lag("ts").over(own).alias("ts0"))
    hour = 3_600_000
    times = points.select(F.col("ts").alias("t")).distinct().withColumn("h", F.floor(F.col("t") / hour))
    hours = times.select("h").distinct().withColumn("k", F.row_number().over(Window.orderBy("h")))  # a row for each hour that has a moment
    place = lambda c, name: hours.select(F.col("h").alias(c), F.col("k").alias(name))
    placed = spans.withColumns({"h1": F.floor(F.col("ts") / hour), "h2": F.floor(F.coalesce("ts2", "ts") / hour)}).join(place("h1", "k1"), "h1").join(place("h2", "k2"), "h2")
    first, last = F.when(F.col("ts0").isNull(), 1).otherwise(F.col("k1")), F.when(F.col("ts2").isNull(), hours.agg(F.max("k")).scalar()).otherwise(F.col("k2"))
    own = (F.col("ts0").isNull() | (F.col("t") >= F.col("ts"))) & (F.col("ts2").isNull() | (F.col("t") < F.col("ts2")))
    joined = placed.withColumn("k", F.explode(F.sequence(first, last))).join(times.join(hours, "h").select("t", "k"), "k").where(own)
    linear = F.col("value") + (F.col("value2") - F.col("value")) * F.coalesce(F.try_divide(F.col("t") - F.col("ts"), F.col("ts2") - F.col("ts")), F.lit(0.0))
    return joined.select("series", F.col("t").alias("ts"), F.round(F.when(F.col("ts2").isNull() | (F.col("t") <= F.col("ts")), F.col("value")).otherwise(linear), 6).alias("value"))


def stacked(values: DataFrame) -> DataFrame:
    """Interpolated series (series, ts, value) laid on each other in the order of their names: low and high of each, and top, the sum at that moment."""
    order = Window.partitionBy("ts").orderBy("series")
    high = F.sum("value").over(order)  # a row for each series
    return values.select("series", "ts", F.round(high - F.col("value"), 6).alias("low"), F.round(high, 6).alias("high"), F.round(F.sum("value").over(Window.partitionBy("ts")), 6).alias("top"))


def trailing(samples: DataFrame, as_of: str, hours: float) -> DataFrame:
    """Samples of the last hours, six for a small chart."""
    return samples.where(F.col("ts") >= F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(secs=F.lit(hours * 3600).cast("decimal(18,6)")))


def spark_points(points: DataFrame) -> DataFrame:
    """Points of a small chart of each key: x from 0 to 100, y from 40 (zero) to 0 (the greatest value)."""
    rows = points.select("key", "ts", "id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), "value")
    bounds = rows.groupBy("key").agg(F.min("t").alias("a"), F.max("t").alias("b"), F.max("value").alias("top"), F.count("*").alias("n"))  # a row for each key, so a busy key can be split
    fit = rows.join(bounds.where("n >= 2 AND b > a AND top > 0"), "key")
    return fit.select("key", "id", F.round((F.col("t") - F.col("a")) / (F.col("b") - F.col("a")) * 100, 6).alias("x"), F.round(40 - F.col("value") / F.col("top") * 40, 6).alias("y"))


def streaks(checks: DataFrame) -> DataFrame:
    """Consecutive failures up to each check and the status that follows. checks: key, ts, id, ok; other columns are carried."""
    order = Window.partitionBy("key").orderBy("ts", "id")
    island = F.sum(F.when(F.col("ok"), 1).otherwise(0)).over(order)
    rows = checks.withColumn("island", island)
    bad = F.sum(F.when(F.col("ok"), 0).otherwise(1)).over(Window.partitionBy("key", "island").orderBy("ts", "id"))
    rows = rows.withColumn("streak", bad)
    s = F.col("streak")
    others = [c for c in checks.columns if c not in ("key", "ts", "id", "ok")]
    return rows.select("key", "ts", "id", *others, s.cast("long").alias("streak"), F.when(s == 0, "Healthy").when(s == 1, "Degraded").when(s >= 3, "Down").otherwise("DegradedEscalating").alias("status"))


def with_latest(services: DataFrame, samples: DataFrame) -> DataFrame:
    """Services with the memory of their latest sample in MiB, by process id; null without one."""
    last = latest(samples).select(F.col("key").cast("int").alias("ProcessId"), F.round((F.col("current") + F.col("child")) / (1024 * 1024), 6).alias("LatestMiB"))
    return services.join(last, "ProcessId", "left")


#: The mark of a metrics line and the patterns of its numbers ("usage" alone isn't part of "child usage").
METRICS_MARK = "Sending Metrics Tracker message"
METRICS_NUMBERS = {"current_bytes": r"current usage:\s*(\d+)", "peak_bytes": r"(?<!child )peak usage:\s*(\d+)", "child_bytes": r"child usage:\s*(\d+)", "child_peak_bytes": r"child peak usage:\s*(\d+)"}


def parse_metrics_lines(lines: DataFrame, line: str = "line") -> DataFrame:
    """Samples from log lines of seven fields or more that hold the mark; the sixth has the numbers. Lines without a current usage are left out, other numbers are 0."""
    parts = F.split(line, r"\|")
    good = lines.where(F.contains(F.col(line), F.lit(METRICS_MARK)) & (F.size(parts) >= 7))
    said = F.get(parts, F.lit(5))
    numbers = {n: F.regexp_extract(said, p, 1).try_cast("long") for n, p in METRICS_NUMBERS.items()}
    found = [c if n == "current_bytes" else F.coalesce(c, F.lit(0).cast("long")) for n, c in numbers.items()]
    return good.select(*[c for c in lines.columns if c != line], F.get(parts, F.lit(0)).try_cast("timestamp_ntz").alias("ts"), *(c.alias(n) for n, c in zip(numbers, found, strict=True))).where("current_bytes IS NOT NULL")


def matched_samples(messages: DataFrame, heartbeats: DataFrame) -> DataFrame:
    """Metric messages (host, service, instance, ...) with the process id of their heartbeat, names in any case; others are dropped."""
    low = lambda *cols: [F.lower(c) for c in cols]
    beat = heartbeats.groupBy(*(c.alias(n) for c, n in zip(low("HostName", "ServiceName", "ServiceInstanceId"), ("h", "s", "i"), strict=True))).agg(F.min("ProcessId").alias("ProcessId"))
    m = messages.withColumns(dict(zip(("h", "s", "i"), low("host", "service", "instance"), strict=True)))
    return m.join(beat, ["h", "s", "i"]).drop("h", "s", "i")


def broker_health(checks: DataFrame) -> DataFrame:
    """Brokers online at each check: all Healthy, some Degraded, none by the streak of such checks. checks: key, ts, id, online, total."""
    rows = streaks(checks.select("key", "ts", "id", (F.col("online") > 0).alias("ok"), ((F.col("online") > 0) & (F.col("online") < F.col("total"))).alias("some")))
    return rows.select("key", "ts", "id", F.when(F.col("some"), "Degraded").otherwise(F.col("status")).alias("status"))


def payload_value(document: Column, name: str, kind: str = "string") -> Column:
    """A member of a JSON object by its name in any case."""
    fields = F.from_json(document, "map<string,string>")
    found = F.filter(F.map_entries(fields), lambda e: F.lower(e["key"]) == name.lower())
    return F.get(found, F.lit(0))["value"].try_cast(kind)
