"""Run listings and run statistics."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.filters.predicates import column, references

#: Columns by which runs may be sorted.
SORTABLE = {"runid": "RunId", "type": "Type", "description": "Description", "status": "Status", "starttime": "Start", "endtime": "End"}
PAGE_SIZE, MAX_RESULTS, DEFAULT_MONTHS = 100, 1000, 4
#: Status codes of the run table by name.
STATUS_CODES = {"F": "Failed", "O": "Running", "P": "Completed"}


@dataclass(frozen=True)
class RunFilter:
    """What a listing asks for. tree is a filter; text, statuses and types count only without one."""

    tree: object = None
    text: str = ""
    statuses: tuple[str, ...] = ()
    types: tuple[str, ...] = ()
    sort: str = "StartTime"
    descending: bool = True


def status_name(code: Column) -> Column:
    """The status that a code stands for, Unknown for others."""
    out = F.lit("Unknown")
    for k, name in STATUS_CODES.items():
        out = F.when(F.upper(F.trim(code)) == k, name).otherwise(out)
    return out


def listing(runs: DataFrame, before: datetime, count: int = 0, ask: RunFilter = RunFilter()) -> DataFrame:
    """The runs that began before a moment, within four months unless the filter speaks of the start, sorted, at most MAX_RESULTS."""
    end = F.lit(before).cast("timestamp_ntz")
    rows = runs.where(F.col("Start") < end)
    if ask.tree is None or not (references(ask.tree, "StartTime") or references(ask.tree, "Start")):
        rows = rows.where(F.col("Start") >= F.add_months(end, -DEFAULT_MONTHS).cast("timestamp_ntz"))
    if ask.tree is not None:
        rows = rows.where(column(ask.tree, runs.schema))
    else:
        if ask.text:
            rows = rows.where(F.contains(F.lower("RunId"), F.lit(ask.text.lower())) | F.contains(F.lower("Description"), F.lit(ask.text.lower())))
        if ask.statuses:
            rows = rows.where(F.col("Status").isin(*ask.statuses))
        if ask.types:
            rows = rows.where(F.col("Type").isin(*ask.types))
    key = F.col(SORTABLE.get(ask.sort.lower(), "Start"))
    return rows.orderBy(key.desc_nulls_last() if ask.descending else key.asc_nulls_first(), "RunId").limit(min(count if count > 0 else PAGE_SIZE, MAX_RESULTS))


def document_listing(documents: DataFrame, before: datetime, count: int = 0, ask: RunFilter = RunFilter()) -> DataFrame:
    """Runs kept as documents that began before a moment; text is a pattern of RunId or RequestId in any case, and any column sorts."""
    rows = documents.where(F.col("Start") < F.lit(before).cast("timestamp_ntz"))
    if text := ask.text.strip():
        rows = rows.where(F.col("RunId").rlike(f"(?i){text}") | F.col("RequestId").rlike(f"(?i){text}"))
    if ask.statuses:
        rows = rows.where(F.col("Status").isin(*ask.statuses))
    if ask.types:
        rows = rows.where(F.col("Type").isin(*ask.types))
    key = F.col({"StartTime": "Start", "EndTime": "End"}.get(ask.sort, f"`{ask.sort}`"))
    return rows.orderBy(key.desc_nulls_last() if ask.descending else key.asc_nulls_first(), "RunId").limit(min(count if count > 0 else PAGE_SIZE, MAX_RESULTS))


def page(rows: DataFrame, order: list, number: int, size: int) -> DataFrame:
    """A page (from 1) of rows in a total order."""
    return rows.orderBy(*order).offset((max(1, number) - 1) * size).limit(size)


def page_count(total: int, size: int) -> int:
    return max(1, -(-total // size))


def document_time(documents: DataFrame) -> Column:
    """A document's time: the first of timestamp, createdAt and updatedAt that is a time, else null. Other kinds of value don't count."""
    fields = {f.name: f.dataType for f in documents.schema.fields}
    times = [F.col(f"`{n}`").cast("timestamp_ntz") for n in ("timestamp", "createdAt", "updatedAt") if isinstance(fields.get(n), (T.TimestampType, T.TimestampNTZType))]
    return F.coalesce(*times) if times else F.lit(None).cast("timestamp_ntz")


def environments(runs: DataFrame, customer: DataFrame, nation: DataFrame, region: DataFrame) -> DataFrame:
    """Runs with the region of their customer as environment."""
    place = customer.join(F.broadcast(nation), customer.c_nationkey == nation.n_nationkey).join(F.broadcast(region), nation.n_regionkey == region.r_regionkey)  # tables of a fixed size
    return runs.join(place.select(F.col("c_custkey").alias("Cust"), F.col("r_name").alias("Env")), "Cust")


def newest_per_environment(runs: DataFrame, n: int) -> DataFrame:
    """The n newest runs of each environment, all together newest first."""
    order = Window.partitionBy("Env").orderBy(F.desc("Start"), "RunId")
    return runs.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= n).drop("_n").orderBy(F.desc("Start"), "RunId")


def bucket(day: Column, unit: str) -> Column:
    """day, week (its Monday) or month, as text."""
    return {"day": F.date_format(day, "yyyy-MM-dd"), "week": F.date_format(F.date_trunc("WEEK", day), "yyyy-MM-dd"), "month": F.date_format(day, "yyyy-MM")}[unit]


def duration(as_of: str) -> Column:
    """Seconds that a run has taken, up to as_of if it still runs."""
    end = F.coalesce("End", F.lit(as_of).cast("timestamp_ntz"))
    return (F.unix_seconds(end.cast("timestamp")) - F.unix_seconds(F.col("Start").cast("timestamp"))).cast("double")


def statistics(runs: DataFrame, unit: str, as_of: str, by_env: bool = True, zone: str = "UTC") -> DataFrame:
    """Mean duration, runs, failures and failure rate of each bucket, and of each environment in it."""
    local = F.from_utc_timestamp(F.col("Start"), zone)
    keys = [bucket(local, unit).alias("bucket"), *([F.col("Env").alias("env")] if by_env else [])]
    failures = F.count_if(F.col("Status") == "Failed")
    return runs.groupBy(*keys).agg(F.round(F.avg(duration(as_of)), 3).alias("avg_seconds"), F.count("*").alias("runs"), failures.alias("failed"), F.round(failures / F.count("*"), 6).alias("fail_rate"))


def numbered(runs: DataFrame, unit: str) -> DataFrame:
    """Runs with their place by start in their bucket: places within an hour, after the runs of the bucket's earlier hours, of which there is a row each."""
    b = bucket(F.col("Start"), unit)
    rows = runs.select("RunId", "Start", b.alias("bucket"), F.struct(b.alias("bucket"), F.date_trunc("HOUR", "Start").alias("hour")).alias("slice"))
    earlier = Window.partitionBy("slice.bucket").orderBy("slice.hour").rowsBetween(Window.unboundedPreceding, -1)
    slices = rows.groupBy("slice").agg(F.count("*").alias("n")).select("slice", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("slice").orderBy("Start", "RunId"))
    return rows.withColumn("own", own).join(slices, "slice").select("RunId", "bucket", (F.col("own") + F.col("before")).alias("place"))
