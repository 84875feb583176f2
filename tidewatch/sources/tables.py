"""Tables that streams write batch by batch, where a batch that is run again changes nothing.

A table is a folder of data folders and numbered manifests. A manifest names the data folders that are the table, and the last batch of each writer; it
appears by one rename, so readers see all of a batch or nothing. A batch that a manifest already counts is passed over; what a
broken run has written is in no manifest. One writer at a time may commit: a second one finds its number taken and fails.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators.events import to_log, upsert


class Table:
    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        jvm = spark._jvm
        self._new = jvm.org.apache.hadoop.fs.Path
        self._fs = self._new(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._io = jvm.org.apache.commons.io.IOUtils

    def manifest(self) -> dict:
        """The newest manifest: number, parts (name -> data folder) and writers (name -> last batch)."""
        folder = self._new(f"{self.path}/_manifests")
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        newest = max((int(n.removesuffix(".json")) for n in names if n.endswith(".json")), default=0)
        if not newest:
            return {"number": 0, "parts": {}, "writers": {}}
        stream = self._fs.open(self._new(f"{self.path}/_manifests/{newest}.json"))
        try:
            return json.loads(self._io.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def commit(self, before: dict, parts: dict, writers: dict) -> None:
        number = before["number"] + 1
        temporary, final = self._new(f"{self.path}/_manifests/.{uuid.uuid4().hex}"), self._new(f"{self.path}/_manifests/{number}.json")
        stream = self._fs.create(temporary)
        stream.write(bytearray(json.dumps({"number": number, "parts": parts, "writers": writers}).encode()))
        stream.close()
        if self._fs.exists(final) or not self._fs.rename(temporary, final):
            self._fs.delete(temporary, False)
            raise RuntimeError(f"another writer has committed {final}")

    def rows(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.path}/{f}" for f in folders))

    def read(self) -> DataFrame:
        """The table as of its newest manifest."""
        return self.rows(sorted(set(self.manifest()["parts"].values())))

    def vacuum(self, keep: int = 2) -> None:
        """Delete data folders that none of the newest manifests names, and older manifests. Readers of what goes must be done."""
        newest, used = self.manifest()["number"], set()
        for number in range(max(1, newest - keep + 1), newest + 1):
            stream = self._fs.open(self._new(f"{self.path}/_manifests/{number}.json"))
            used |= set(json.loads(self._io.toString(stream, "UTF-8"))["parts"].values())
            stream.close()
        for number in range(newest - keep, 0, -1):
            if not self._fs.delete(self._new(f"{self.path}/_manifests/{number}.json"), False):
                break
        for top in ("data", "packed"):
            folder = self._new(f"{self.path}/{top}")
            for status in self._fs.listStatus(folder) if self._fs.exists(folder) else []:
                name = f"{top}/{status.getPath().getName()}"
                if not any(u == name or u.startswith(name + "/") for u in used):
                    self._fs.delete(status.getPath(), True)


class EventLog(Table):
    """Rows as they come, a data folder for each batch until they are packed."""

    def append(self, batch: DataFrame, number: int, writer: str = "stream") -> bool:
        """Add a batch once; whether it was new. Use as `lambda batch, n: log.append(batch, n)` with foreachBatch."""
        now = self.manifest()
        if now["writers"].get(writer, -1) >= number:
            return False
        folder = f"data/{uuid.uuid4().hex}"
        names = self.rows([]).columns
        to_log(batch).select(*names).write.parquet(f"{self.path}/{folder}")
        self.commit(now, now["parts"] | {folder: folder}, now["writers"] | {writer: number})
        return True

    def pack(self) -> None:
        """Bring the batches into one data folder."""
        now = self.manifest()
        if len(now["parts"]) > 1:
            folder = f"packed/{uuid.uuid4().hex}"
            self.rows(sorted(now["parts"].values())).write.parquet(f"{self.path}/{folder}")
            self.commit(now, {folder: folder}, now["writers"])


class KeyedTable(Table):
    """The newest row of each key, in buckets of keys; a batch writes the buckets that it touches anew and leaves the others."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str, time: str, arrival: str, buckets: int = 64, prefer_finished: str | None = None):
        super().__init__(spark, path, schema)
        self.key, self.time, self.arrival, self.buckets, self.prefer_finished = key, time, arrival, buckets, prefer_finished

    def upsert(self, batch: DataFrame, number: int, writer: str = "stream") -> bool:
        """Take a batch in once; whether it was new. Ties of time go to the first to arrive."""
        now = self.manifest()
        if now["writers"].get(writer, -1) >= number:
            return False
        names = self.rows([]).columns
        bucket = F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int").alias("bucket")
        touched = [r.bucket for r in batch.select(bucket).distinct().collect()]  # no more than buckets
        parts = dict(now["parts"])
        if touched:
            known = self.rows(sorted(parts[str(b)] for b in touched if str(b) in parts))
            # one shuffle, by bucket, serves both the upsert and the write
            both = known.select(*names).unionByName(batch.select(*names)).withColumn("bucket", bucket).repartition("bucket")
            newest = upsert(both, ["bucket", self.key], self.time, self.arrival, self.prefer_finished)
            folder = f"data/{uuid.uuid4().hex}"
            newest.write.partitionBy("bucket").parquet(f"{self.path}/{folder}")
            parts |= {str(b): f"{folder}/bucket={b}" for b in touched}
        self.commit(now, parts, now["writers"] | {writer: number})
        return True
