"""Timeline analytics: lanes, stacks, start-time heatmap, sub-rows, and the CSV form."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Buckets of the heatmap, the length an open event is taken for, and the slices into which lanes are cut.
BUCKETS, OPEN_MS, SLICE_MS = 500, 5000, 3_600_000


def ms(c: Column) -> Column:
    return F.unix_millis(c.cast("timestamp"))


def lane_key(kind: str) -> list[Column]:
    """The levels of a lane: service_pipeline, service_process_pipeline, service, pipeline or process."""
    process = F.concat_ws(":", "Server", F.col("ProcessId").cast("string"))
    return {"service_pipeline": [F.col("Service"), F.col("Pipeline")], "service_process_pipeline": [F.col("Service"), process, F.col("Pipeline")], "service": [F.col("Service")], "pipeline": [F.col("Pipeline")], "process": [process]}[kind]


def lanes(events: DataFrame, kind: str = "service_pipeline") -> DataFrame:
    """Lanes of finished events with their number of events, ordered level by level by what came first."""
    levels = lane_key(kind)
    rows = events.where("Finish IS NOT NULL").groupBy(*(c.alias(f"l{i}") for i, c in enumerate(levels))).agg(F.min(F.struct("Start", "Id")).alias("first"), F.count("*").alias("events"))
    names = [f"l{i}" for i in range(len(levels))]
    order = [F.min("first").over(Window.partitionBy(*names[: i + 1])).alias(f"f{i}") for i in range(len(names) - 1)]
    ranked = rows.select("*", *order)
    by = [*(f"f{i}" for i in range(len(names) - 1)), "first"]
    return ranked.select(F.concat_ws("/", *names).alias("lane"), F.row_number().over(Window.orderBy(*by)).alias("lane_order"), "events")  # a row for each lane, not for each event


def stack(events: DataFrame) -> DataFrame:
    """Finished events of a chunk laid end to end by start: where each begins and ends, in milliseconds."""
    order = Window.partitionBy("Name").orderBy("Start", "Id").rowsBetween(Window.unboundedPreceding, -1)
    took = ms(F.col("Finish")) - ms(F.col("Start"))
    begin = F.coalesce(F.sum("took").over(order), F.lit(0).cast("long"))
    return events.where("Finish IS NOT NULL").withColumn("took", took).select("Name", "Id", begin.alias("x_start"), (begin + F.col("took")).alias("x_end"))


def stack_domain(events: DataFrame) -> DataFrame:
    took = F.sum(ms(F.col("Finish")) - ms(F.col("Start")))
    return events.where("Finish IS NOT NULL").groupBy("Name").agg(took.alias("t")).agg(F.max("t").alias("domain"))


def wall_clock(events: DataFrame) -> DataFrame:
    """One row: low, the first start, and span, the milliseconds from there to the last end or start, 1000 at least."""
    low = F.min(ms(F.col("Start")))
    return events.agg(low.alias("low"), F.greatest(F.max(ms(F.coalesce("Finish", "Start"))) - low, F.lit(1000).cast("long")).alias("span"))


def heatmap(events: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Starts counted in equal parts of the time from the first start to the last end. Events are read twice: give a table rather than a plan."""
    domain = wall_clock(events).select(F.struct("low", "span").alias("d")).scalar()
    counted = events.groupBy(F.floor((ms(F.col("Start")) - domain["low"]) / domain["span"] * (buckets - 1)).alias("bucket")).agg(F.count("*").alias("n"))
    return counted.select("bucket", "n", F.round(0.12 + 0.88 * F.col("n") / F.max("n").over(Window.partitionBy()), 6).alias("opacity"))  # at most `buckets` rows


def spans(events: DataFrame, kind: str = "service_pipeline") -> DataFrame:
    """Id, lane, and from a to b in milliseconds; an open event counts as OPEN_MS long."""
    begin = ms(F.col("Start"))
    return events.select("Id", F.concat_ws("/", *lane_key(kind)).alias("lane"), begin.alias("a"), F.coalesce(ms(F.col("Finish")), begin + OPEN_MS).alias("b"))


def stretches(rows: DataFrame, slice_ms: int = SLICE_MS) -> DataFrame:
    """rows (Id, lane, a, b) with stretch, a lane's time between two moments at which nothing runs in it.

    A lane is cut into slices of time. Of each only its latest end and its last stretch's beginning are carried on to later ones,
    so no task holds a lane but for these few numbers.
    """
    sliced = rows.withColumn("slice", F.floor(F.col("a") / slice_ms))
    later = Window.partitionBy("lane").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)  # a row for each slice of a lane
    ends = sliced.groupBy("lane", "slice").agg(F.max("b").alias("end")).select("lane", "slice", F.max("end").over(later).alias("busy_before"))
    order = Window.partitionBy("lane", "slice").orderBy("a", "Id")
    busy = F.greatest("busy_before", F.max("b").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    marked = sliced.join(ends, ["lane", "slice"]).withColumn("new", F.when(F.coalesce(F.col("a") >= busy, F.lit(True)), F.struct("a", "Id")))
    begun = marked.groupBy("lane", "slice").agg(F.max("new").alias("new")).select("lane", "slice", F.last("new", ignorenulls=True).over(later).alias("begun_before"))
    own = F.last("new", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn("own", own).join(begun, ["lane", "slice"]).select("Id", "lane", "a", "b", F.coalesce("own", "begun_before").alias("stretch"))


def sub_rows(events: DataFrame, kind: str = "service_pipeline", slice_ms: int = SLICE_MS) -> DataFrame:
    """The sub-row of each event in its lane: the first that is free when it starts. Open events count as OPEN_MS long.

    Where nothing runs in a lane every sub-row is free, so each stretch between such moments is packed by itself: stretches are
    dealt to tasks, which go through them in order and hold no more than the events that run at one moment.
    """

    def first_fit(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, busy, free = None, [], []  # ends with their rows, and rows that are free, both as heaps
        for part in parts:
            out = []
            for lane, s, t, a, b in zip(part["lane"], part["s"].tolist(), part["t"], part["a"].tolist(), part["b"].tolist(), strict=True):
                if now != (lane, s, t):
                    now, busy, free = (lane, s, t), [], []
                while busy and busy[0][0] <= a:
                    heapq.heappush(free, heapq.heappop(busy)[1])
                row = heapq.heappop(free) if free else len(busy)
                heapq.heappush(busy, (b, row))
                out.append(row)
            yield pd.DataFrame({"lane": part["lane"], "Id": part["Id"], "sub_row": out})

    rows = stretches(spans(events, kind), slice_ms).select("lane", F.col("stretch.a").alias("s"), F.col("stretch.Id").alias("t"), "Id", "a", "b")
    return rows.repartition("lane", "s", "t").sortWithinPartitions("lane", "s", "t", "a", "Id").mapInPandas(first_fit, "lane string, Id string, sub_row int")


def sub_row_counts(events: DataFrame, kind: str = "service_pipeline", slice_ms: int = SLICE_MS) -> DataFrame:
    """lane and sub_rows, the sub-rows that first fit needs: as many as events run at once, counted by sums over slices of time."""
    moved = spans(events, kind).select("lane", F.explode(F.array(F.struct(F.col("a").alias("t"), F.lit(1).alias("d")), F.struct(F.col("b").alias("t"), F.lit(-1).alias("d")))).alias("m"))
    step = F.sum("m.d").alias("d")
    steps = moved.groupBy("lane", F.col("m.t").alias("t"), (F.col("m.d") > 0).alias("up")).agg(step).withColumn("slice", F.floor(F.col("t") / slice_ms))
    later = Window.partitionBy("lane").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = steps.groupBy("lane", "slice").agg(F.sum("d").alias("d")).select("lane", "slice", F.coalesce(F.sum("d").over(later), F.lit(0)).alias("before"))
    running = F.sum("d").over(Window.partitionBy("lane", "slice").orderBy("t", "up"))  # what ends at a moment goes first
    return steps.withColumn("n", running).join(carried, ["lane", "slice"]).groupBy("lane").agg(F.max(F.col("n") + F.col("before")).cast("long").alias("sub_rows"))


def enriched(events: DataFrame, as_of: str) -> DataFrame:
    """events with StartUtc and FinishUtc as ISO texts and Duration, the day of as_of plus the time taken, so that times of day filter it; null while open."""
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    midnight = F.date_trunc("day", F.lit(as_of).cast("timestamp_ntz"))
    return events.withColumns({"StartUtc": iso(F.col("Start")), "FinishUtc": iso(F.col("Finish")), "Duration": (midnight + (F.col("Finish") - F.col("Start"))).cast("timestamp_ntz")})


#: Columns of the CSV form, in order.
CSV_COLUMNS = ("RunId", "Id", "Name", "Service", "Pipeline", "Server", "ProcessId", "Start", "Finish", "Error", "RecordCount")


def write_csv(events: DataFrame, path: str) -> None:
    """The CSV form: ISO times, quoted where needed, lines ended by line feeds as Spark writes them."""
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias(c)
    cols = [iso(c) if c in ("Start", "Finish") else F.col(c) if c in events.columns else F.lit(None).cast("string").alias(c) for c in CSV_COLUMNS]
    events.select(*cols).write.option("header", True).option("escape", '"').csv(path)


def read_csv(spark, path: str, as_of: str) -> DataFrame:
    """Events of a CSV file; headers in any case, a missing start is as_of."""
    raw = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).csv(path)
    known = {c.lower(): c for c in raw.columns}
    cell = lambda c: F.col(f"`{known[c.lower()]}`") if c.lower() in known else F.lit(None).cast("string")
    at = lambda c: cell(c).try_cast("timestamp").cast("timestamp_ntz")
    text = [cell(c).alias(c) for c in ("RunId", "Id", "Name", "Service", "Pipeline", "Server")]
    return raw.select(*text, cell("ProcessId").try_cast("int").alias("ProcessId"), F.coalesce(at("Start"), F.lit(as_of).cast("timestamp_ntz")).alias("Start"), at("Finish").alias("Finish"), cell("Error").alias("Error"), cell("RecordCount").try_cast("int").alias("RecordCount"))
