"""Cutting the lineage of iterative plans, and keeping what several branches of a plan read."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The folder that the session names for checkpoints, else the context's; in a local session without either a temporary one."""
    context, named = spark.sparkContext, spark.conf.get("spark.checkpoint.dir", None)
    if not context.getCheckpointDir():
        if not named and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors can reach")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="tidewatch-"))
    return named or context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df as a reliable checkpoint."""
    folder(df.sparkSession)
    return df.checkpoint()


#: Folders of tables that this process has stored.
FOLDERS: list[str] = []


def stored(df: DataFrame) -> DataFrame:
    """df written once to the checkpoint folder as a table, so that each branch of a plan reads only its columns of it. `clear` or `scratch` delete such tables."""
    path = f"{folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    FOLDERS.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def clear(spark: SparkSession, upto: int = 0) -> None:
    """Delete stored tables but the first `upto`; call it when no result that reads them is needed any more."""
    while len(FOLDERS) > upto:
        delete(spark, FOLDERS.pop())


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are stored within go when it ends."""
    before = len(FOLDERS)
    try:
        yield
    finally:
        clear(spark, before)
