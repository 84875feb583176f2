"""Tables in the shared checkpoint folder, to cut lineage and to survive lost executors."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tidewatch.plans.lineage import delete, folder


#: Folders of this process' shelves.
FOLDERS: list[str] = []


def clear(spark: SparkSession) -> None:
    """Delete all intermediate tables of this process; call it when no result that reads them is needed any more."""
    while FOLDERS:
        delete(spark, FOLDERS.pop())


class Shelf:
    """Writes intermediate tables; what is no longer needed can be taken off."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder, self.count = spark, f"{folder(spark)}/{name}-{uuid.uuid4().hex}", 0
        FOLDERS.append(self.folder)

    def put(self, df: DataFrame, compression: str = "snappy") -> DataFrame:
        """df as a table that is read back from the shared folder."""
        path = f"{self.folder}/{self.count}"
        self.count += 1
        df.write.parquet(path, compression=compression)
        kept = self.spark.read.schema(df.schema).parquet(path)
        kept._shelf_path = path
        return kept

    def take_off(self, df: DataFrame) -> None:
        if path := getattr(df, "_shelf_path", None):
            delete(self.spark, path)
