"""A producer's helper: events of a service, collected and appended to the log."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from datetime import datetime, timezone

from pyspark.sql import SparkSession

from tidewatch.operators.events import append

SCHEMA = "RunId string, EventId string, CorrelationId string, Service string, Server string, ProcessId int, Pipeline string, Kind string, Source string, Target string, TimestampUtc timestamp_ntz, FinishUtc timestamp_ntz, Status string, RecordCount long, Error string, Info string"


class Reporter:
    """Collects events; `flush` appends them."""

    def __init__(self, run_id: str, service: str, server: str = "", process_id: int = 0, pipeline: str = "", source: str = "reporter"):
        self.fixed, self.rows = (run_id, service, server, process_id, pipeline, source), []

    def event(self, kind: str, chunk: str | None = None, target: str | None = None, start: datetime | None = None, finish: datetime | None = None, records: int | None = None, error: str | None = None, info: str | None = None) -> None:
        run, service, server, pid, pipeline, source = self.fixed
        at = start or datetime.now(timezone.utc).replace(tzinfo=None)
        self.rows.append((run, uuid.uuid4().hex, chunk, service, server, pid, pipeline, kind, source, target, at, finish, "Failed" if error else "Success", records, error, info))

    @contextmanager
    def span(self, chunk: str, kind: str = "Process", **more) -> Iterator[None]:
        """An event from the beginning of the block to its end; an exception becomes its error."""
        start, error = datetime.now(timezone.utc).replace(tzinfo=None), None
        try:
            yield
        except Exception as e:
            error = str(e) or type(e).__name__
            raise
        finally:
            self.event(kind, chunk, start=start, finish=datetime.now(timezone.utc).replace(tzinfo=None), error=error, **more)

    def flush(self, spark: SparkSession, path: str) -> None:
        if self.rows:
            append(spark.createDataFrame(self.rows, SCHEMA), path)
            self.rows = []
