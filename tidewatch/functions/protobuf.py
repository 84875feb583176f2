"""Protobuf payloads by Spark's own decoder, which needs the spark-protobuf package on the session's classpath."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def decoded(payload: Column, message: str, descriptor: str) -> Column:
    """The payload as JSON, null where it isn't such a message. descriptor: a file of a FileDescriptorSet."""
    from pyspark.sql.protobuf.functions import from_protobuf

    return F.to_json(from_protobuf(payload, message, descriptor, {"mode": "PERMISSIVE", "enums.as.ints": "false", "emit.default.values": "false"}))


def by_topic(messages: DataFrame, rules: list[tuple[str, list[Column]]], default: Column | None = None) -> DataFrame:
    """messages with Json: the first non-null candidate of the first rule whose topic pattern (% for anything) fits, else the default, else the size."""
    unknown = F.to_json(F.struct(F.lit("unknown").alias("type"), F.octet_length("Value").alias("sizeBytes")))
    found = F.coalesce(default, unknown) if default is not None else unknown
    for pattern, candidates in reversed(rules):
        found = F.when(F.lower("Topic").like(pattern.lower()), F.coalesce(*candidates, unknown)).otherwise(found)
    return messages.withColumn("Json", found)
