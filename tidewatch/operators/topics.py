"""Message topics: seeking, watermarks, lag, and payload fields.

Messages have Topic, Part, Off, Ts, Key, Payload. Commits have grp, Topic, Part and Committed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.filters.predicates import Seek

MAX_FETCH = 2000


def read(messages: DataFrame, where: Seek, topic: str | None = None, cap: int | None = MAX_FETCH) -> DataFrame:
    """Messages within the bounds; `latest` beats a first time, and that a first offset. Bounds hold for each partition.

    Bounds are plain comparisons, so they reach the scan of a table that has offsets. The cap keeps the first messages in order of time.
    """
    rows = messages if topic is None else messages.where(F.col("Topic") == topic)
    if where.partitions is not None:
        rows = rows.where(F.col("Part").isin(*where.partitions))
    if where.latest is not None:
        return latest(rows, where.latest)
    if where.time_from is not None:
        rows = rows.where(F.col("Ts") >= F.lit(where.time_from).cast("timestamp_ntz"))
    elif where.offset_from is not None:
        rows = rows.where(F.col("Off") >= where.offset_from)
    if where.offset_to is not None:
        rows = rows.where(F.col("Off") <= where.offset_to)
    if where.time_to is not None:
        rows = rows.where(F.col("Ts") <= F.lit(where.time_to).cast("timestamp_ntz"))
    return rows if cap is None else rows.orderBy("Ts", "Topic", "Part", "Off").limit(cap)


def latest(messages: DataFrame, n: int) -> DataFrame:
    """The n last messages of each partition, and of these the n last of each topic."""
    part = Window.partitionBy("Topic", "Part").orderBy(F.desc("Off"))
    whole = Window.partitionBy("Topic").orderBy(F.desc("Ts"), F.desc("Part"), F.desc("Off"))
    few = messages.withColumn("_n", F.row_number().over(part)).where(F.col("_n") <= n)
    return few.withColumn("_n", F.row_number().over(whole)).where(F.col("_n") <= n).drop("_n")


def buffered(messages: DataFrame, most: int) -> DataFrame:
    """The last messages that a viewer keeps, the newest first."""
    return messages.orderBy(F.desc("Ts"), F.desc("Topic"), F.desc("Part"), F.desc("Off")).limit(most)


def sorted_topics(topics: DataFrame, key: str = "Name", descending: bool = False) -> DataFrame:
    """Topics by PartitionCount, MessageCount or else Name, in any case. topics: Topic, partitions, messages."""
    by = F.col({"PartitionCount": "partitions", "MessageCount": "messages"}[key]) if key in ("PartitionCount", "MessageCount") else F.upper("Topic")
    return topics.orderBy(by.desc() if descending else by.asc(), "Topic")


def payload_types(messages: DataFrame, wanted: str, kind: Column) -> DataFrame:
    """Messages of each payload type (null counts as a type) and whether it is the wanted one, in any case."""
    return messages.groupBy(kind.alias("payload_type")).agg(F.count("*").alias("n")).withColumn("wanted", F.coalesce(F.lower("payload_type") == wanted.lower(), F.lit(False)))


def fetch(messages: DataFrame, topic: str, part: int, off: int) -> DataFrame:
    return messages.where((F.col("Topic") == topic) & (F.col("Part") == part) & (F.col("Off") == off))


def partition_stats(messages: DataFrame) -> DataFrame:
    """Watermarks and first and last times of each partition; the high one is the next offset."""
    rows = messages.groupBy("Topic", "Part").agg(F.min("Off").alias("low"), (F.max("Off") + 1).alias("high"), F.min_by("Ts", "Off").alias("first_ts"), F.max_by("Ts", "Off").alias("last_ts"))
    return rows.withColumn("n", F.greatest(F.col("high") - F.col("low"), F.lit(0)))


def topic_stats(messages: DataFrame) -> DataFrame:
    """Partitions and messages of each topic; internal topics (beginning with __) are left out."""
    return partition_stats(messages).where(~F.col("Topic").startswith("__")).groupBy("Topic").agg(F.count("*").alias("partitions"), F.sum("n").alias("messages"))


def with_configs(topics: DataFrame, configs: DataFrame) -> DataFrame:
    """Topics with their settings as a map (empty without any). configs: Topic, name, value, a few for each topic."""
    each = configs.groupBy("Topic").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("name", "value")))).alias("config"))
    return topics.join(each, "Topic", "left").withColumn("config", F.coalesce("config", F.create_map().cast("map<string,string>")))


def group_lag(messages: DataFrame, commits: DataFrame, assigned_only: bool = True) -> DataFrame:
    """Messages of each topic that a group hasn't committed; a missing commit counts from 0.

    assigned_only: topics of which the group has committed anything; else all that aren't internal.
    """
    high = partition_stats(messages).where(~F.col("Topic").startswith("__")).select("Topic", "Part", "high")
    if assigned_only:
        every = commits.select("grp", "Topic").distinct().join(high, "Topic")
    else:  # each partition once for each consumer group, of which there are few
        every = high.withColumn("grp", F.explode(commits.agg(F.collect_set("grp")).scalar()))
    every = every.join(commits, ["grp", "Topic", "Part"], "left")
    return every.groupBy("grp", "Topic").agg(F.sum(F.greatest(F.col("high") - F.coalesce("Committed", F.lit(0)), F.lit(0))).alias("lag"), F.count("*").alias("partitions"))


def group_overview(messages: DataFrame, commits: DataFrame) -> DataFrame:
    """Total lag and topics of each group."""
    return group_lag(messages, commits).groupBy("grp").agg(F.sum("lag").alias("lag"), F.count("*").alias("n_topics"), F.array_join(F.array_sort(F.collect_set("Topic")), ",").alias("topics"))


def named_fields(messages: DataFrame, fields: dict[str, str]) -> DataFrame:
    """Messages with fields of their JSON payload as columns (name -> JSON path and type, as in "$.k long")."""
    out = messages
    for name, spec in fields.items():
        path, _, kind = spec.partition(" ")
        out = out.withColumn(name, F.get_json_object("Payload", path).try_cast(kind or "string"))
    return out
