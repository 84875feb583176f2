"""What tables there are and how large they are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.sources.tables import EventLog


def parquet_tables(spark: SparkSession, folder: str) -> DataFrame:
    """Name, files and bytes of the Parquet tables below a folder, from file listings alone."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(folder).select("path", "length")
    name = F.regexp_extract("path", r"/([^/]+)\.parquet(?:/|$)", 1)
    return files.groupBy(name.alias("name")).agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))


def page_of_tables(tables: DataFrame, search: str, number: int, size: int) -> DataFrame:
    """Tables whose name holds the text, a page of them by name; only these need statistics."""
    found = tables.where(F.contains(F.lower("name"), F.lit(search.lower())))
    return found.orderBy(F.upper("name"), "name").offset((max(1, number) - 1) * size).limit(size)


def table_stats(spark: SparkSession, folder: str, page: list[str]) -> DataFrame:
    """Rows and mean bytes of a row of the tables of one page, from the tables' footers."""
    sizes = parquet_tables(spark, folder).where(F.col("name").isin(page))
    counts = [spark.read.parquet(f"{folder}/{name}.parquet").agg(F.count("*").alias("rows")).select(F.lit(name).alias("name"), "rows") for name in page]
    rows = counts[0]
    for more in counts[1:]:
        rows = rows.union(more)
    return sizes.join(rows, "name").withColumn("row_bytes", F.floor(F.coalesce(F.try_divide(F.col("bytes"), F.col("rows")), F.lit(0.0))))


def column_stats(table: DataFrame, exact: bool = False) -> DataFrame:
    """Each column's type, nulls and different values (estimated by a sketch, or counted)."""
    different = F.countDistinct if exact else F.approx_count_distinct
    kinds = {f.name: f.dataType.simpleString() for f in table.schema.fields}
    one = table.agg(*(F.struct(F.count_if(F.col(f"`{c}`").isNull()).alias("nulls"), different(F.col(f"`{c}`")).alias("distinct")).alias(c) for c in kinds))
    return one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.lit(k).alias("kind"), F.col(f"`{c}`.nulls").alias("nulls"), F.col(f"`{c}`.distinct").alias("distinct")) for c, k in kinds.items()))).alias("s")).select("s.*")


# --- statistics that are kept -------------------------------------------------------------------------------------

SKETCHES = "file string, bytes long, modified timestamp, column string, kind string, rows long, nulls long, distinct binary, quantiles binary"


def _as_double(kind: str) -> bool:
    return kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal")


def sketch_files(table: DataFrame) -> DataFrame:
    """A row for each file and column of a Parquet table: rows, nulls, and sketches of different values and, for numbers, of quantiles."""
    kinds = {f.name: f.dataType.simpleString() for f in table.schema.fields}

    def column(name: str, kind: str) -> Column:
        c = F.col(f"`{name}`")
        text = c.cast("string") if kind not in ("array", "map", "struct") and not kind.startswith(("array", "map", "struct")) else F.to_json(F.struct(c))
        quantiles = F.kll_sketch_agg_double(c.cast("double")) if _as_double(kind) else F.lit(None).cast("binary")
        return F.struct(F.lit(name).alias("column"), F.lit(kind).alias("kind"), F.count("*").alias("rows"), F.count_if(c.isNull()).alias("nulls"), F.hll_sketch_agg(text).alias("distinct"), quantiles.alias("quantiles"))

    parts = [column(name, kind).alias(f"_c{i}") for i, (name, kind) in enumerate(kinds.items())]
    file = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("bytes"), F.col("_metadata.file_modification_time").alias("modified"))
    each = table.select("*", file.alias("_file")).groupBy("_file").agg(*parts)
    return each.select("_file.*", F.explode(F.array(*(F.col(f"_c{i}") for i in range(len(kinds))))).alias("s")).select("file", "bytes", "modified", "s.*")


def refresh(spark: SparkSession, path: str, store: EventLog) -> int:
    """Sketch the files of a table that the store doesn't have as they are now; how many they are. Others aren't read."""
    schema = spark.read.parquet(path).schema
    now = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(path).select(F.col("path").alias("file"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))
    known = store.read().select(_plain(F.col("file")).alias("key"), "bytes", "modified").distinct()
    new = now.withColumn("key", _plain(F.col("file"))).join(known, ["key", "bytes", "modified"], "left_anti")
    files = [r.file for r in new.select("file").collect()]  # names of new files, as any reader of them has on the driver
    if files:
        store.append(sketch_files(spark.read.schema(schema).parquet(*files)), store.manifest()["number"], "catalog")
    return len(files)


def _plain(path: Column) -> Column:
    """A path without the slashes that differ between listings."""
    return F.regexp_replace(path, "^([a-z0-9]+):/+", "$1:/")


def kept_stats(spark: SparkSession, path: str, store: EventLog) -> DataFrame:
    """Each column's rows, nulls, different values (estimated) and median (estimated, of numbers), united from the stored sketches of the files that are there now."""
    now = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(path).select(_plain(F.col("path")).alias("key"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))
    rows = store.read().withColumn("key", _plain(F.col("file"))).join(now, ["key", "bytes", "modified"], "left_semi")
    united = rows.groupBy("column", "kind").agg(F.sum("rows").alias("rows"), F.sum("nulls").alias("nulls"), F.hll_sketch_estimate(F.hll_union_agg("distinct")).alias("distinct"), F.kll_merge_agg_double("quantiles").alias("q"))
    median = F.when(F.kll_sketch_get_n_double("q") > 0, F.kll_sketch_get_quantile_double("q", F.lit(0.5)))
    return united.select("column", "kind", "rows", "nulls", "distinct", median.alias("median"))
