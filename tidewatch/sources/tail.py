"""Streams that go on where they stopped: an event log by its ids, and text files by their bytes. Small text files are written, too.

Both are Python data sources: offsets are planned on the driver from footers and file sizes, rows are read in tasks. Spark
keeps the offsets in the checkpoint, so after a restart nothing is lost or read twice. Paths may be of any file system that pyarrow opens.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime, timedelta
from fnmatch import fnmatch

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def bytes_of(n: str | int) -> int:
    """'64m' as a number."""
    text = str(n).lower()
    return int(text[:-1]) << {"k": 10, "m": 20, "g": 30}[text[-1]] if text[-1] in "kmg" else int(text)


# --- event log ----------------------------------------------------------------------------------------------------


@dataclass
class Ids(InputPartition):
    """Ids after `after` up to `upto`."""

    after: int
    upto: int


class LogTail(DataSource):
    """Rows of a Parquet table that others append to, by increasing ids.

    Options: path, id (LogId), time (LoggedAtUtc), lag (seconds), ids (ids of one task), start (the first poll reads ids above it, 0). Ids are given before rows are committed, so a row may appear after one
    with a greater id. An id counts as reached when no row up to it is younger than the lag: a row that is committed within the lag after its time is read, once.
    """

    @classmethod
    def name(cls) -> str:
        return "tidewatch_log"

    def schema(self) -> StructType:
        raise ValueError("give the log's schema")

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return LogTailReader(self.options, schema)


class LogTailReader(DataSourceStreamReader):
    def __init__(self, options: dict, schema: StructType):
        self.path, self.fields = options["path"], schema.fieldNames()
        self.id, self.time = options.get("id", "LogId"), options.get("time", "LoggedAtUtc")
        self.lag, self.ids = timedelta(seconds=float(options.get("lag", 0))), int(options.get("ids", 1_000_000))
        self.now = options.get("now")
        self.first = self.reached = int(options.get("start", 0))

    def _log(self) -> ds.Dataset:
        system, path = opened(self.path)
        return ds.dataset(path, filesystem=system, format="parquet", exclude_invalid_files=False)

    def initialOffset(self) -> dict:
        return {"id": self.first}

    def latestOffset(self) -> dict:
        """The greatest id below which all rows are older than the lag. Of row groups below what was reached only the statistics are read, and without a lag of all."""
        now = datetime.fromisoformat(self.now) if self.now else datetime.now(UTC).replace(tzinfo=None)
        greatest, young = self.reached, None
        if not self.lag:
            return {"id": max([self.reached, *(self._greatest(f) for f in self._log().get_fragments())])}
        for batch in self._log().to_batches(columns=[self.id, self.time], filter=ds.field(self.id) > self.reached):
            if not len(batch):
                continue
            greatest = max(greatest, pc.max(batch.column(0)).as_py())
            late = batch.filter(pc.greater_equal(batch.column(1).cast(pa.timestamp("us")), pa.scalar(now - self.lag, pa.timestamp("us"))))
            if self.lag and len(late):
                least = pc.min(late.column(0)).as_py()
                young = least if young is None else min(young, least)
        return {"id": greatest if young is None else max(self.reached, young - 1)}

    def _greatest(self, file: ds.ParquetFileFragment) -> int:
        """A file's greatest id by its footer, or from its ids where the footer doesn't say."""
        groups = [g.statistics or {} for g in file.row_groups]
        if all("max" in g.get(self.id, {}) for g in groups):
            return max((g[self.id]["max"] for g in groups), default=self.reached)
        found = (pc.max(b.column(0)).as_py() for b in file.to_batches(columns=[self.id], filter=ds.field(self.id) > self.reached))
        return max((n for n in found if n is not None), default=self.reached)

    def partitions(self, start: dict, end: dict) -> list[Ids]:
        self.reached = max(self.reached, start["id"])
        return [Ids(after, min(after + self.ids, end["id"])) for after in range(start["id"], end["id"], self.ids)]

    def read(self, partition: Ids) -> Iterator[pa.RecordBatch]:
        wanted = (ds.field(self.id) > partition.after) & (ds.field(self.id) <= partition.upto)
        yield from self._log().to_batches(columns=self.fields, filter=wanted)

    def commit(self, end: dict) -> None:
        self.reached = max(self.reached, end["id"])


# --- text files ---------------------------------------------------------------------------------------------------


@dataclass
class Piece(InputPartition):
    """Lines of a file that begin in [start, stop); no line reaches over `whole`."""

    file: str
    start: int
    stop: int
    whole: int


STEP = 1 << 20


def last_line_end(system: fs.FileSystem, path: str, size: int, least: int) -> int:
    """The end of the last whole line that ends in (least, size]; least if none does."""
    with system.open_input_file(path) as f:
        at = size
        while at > least:
            low = max(least, at - STEP)
            if (found := f.read_at(at - low, low).rfind(b"\n")) >= 0:
                return low + found + 1
            at = low
    return least


def lines_of(piece: Piece) -> Iterator[tuple[int, str]]:
    """(place, line) of a piece, without line ends; a line that begins before the piece is left to the piece before."""
    system, path = opened(piece.file)
    with system.open_input_file(path) as f:
        at, held, place = piece.start, b"", piece.start
        skip = False
        if piece.start and f.read_at(1, piece.start - 1) != b"\n":
            skip = True
        while place < piece.stop and at < piece.whole:
            data = f.read_at(min(STEP, piece.whole - at), at)
            at += len(data)
            held += data
            *whole, held = held.split(b"\n")
            for line in whole:
                if not skip and place < piece.stop and (text := line.rstrip(b"\r")):
                    yield place, text.decode("utf-8", "replace")
                skip = False
                place += len(line) + 1
                if place >= piece.stop:
                    return


class FileTail(DataSource):
    """Lines of text files (file, place, line), place being the byte at which a line begins.

    Options: path (a folder), glob (*), recursive (true), piece (bytes of one task, 64m). As a stream it gives what was appended, whole lines only; a file that has
    become shorter is read from its beginning. Empty lines are left out. As a batch it gives all whole lines and what stands after the last.
    """

    @classmethod
    def name(cls) -> str:
        return "tidewatch_lines"

    def schema(self) -> str:
        return "file string, place long, line string"

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return FileTailReader(self.options)

    def reader(self, schema: StructType) -> DataSourceReader:
        return WholeFilesReader(self.options)


class Lines:
    def __init__(self, options: dict):
        self.path, self.glob = options["path"], options.get("glob", "*")
        self.recursive, self.piece = options.get("recursive", "true").lower() == "true", bytes_of(options.get("piece", "64m"))

    def files(self) -> dict[str, int]:
        """Sizes of the files."""
        system, path = opened(self.path)
        found = system.get_file_info(fs.FileSelector(path, recursive=self.recursive, allow_not_found=True))
        prefix = self.path[: -len(path)] if self.path.endswith(path) and self.path != path else ""
        return {prefix + f.path: f.size for f in found if f.type == fs.FileType.File and fnmatch(f.base_name, self.glob)}

    def pieces(self, file: str, start: int, stop: int) -> list[Piece]:
        return [Piece(file, at, min(at + self.piece, stop), stop) for at in range(start, stop, self.piece)]

    def read(self, partition: Piece) -> Iterator[tuple[str, int, str]]:
        for place, line in lines_of(partition):
            yield partition.file, place, line


class FileTailReader(Lines, DataSourceStreamReader):
    def __init__(self, options: dict):
        super().__init__(options)
        self.known: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        after = {}
        for file, size in self.files().items():
            system, path = opened(file)
            before = self.known.get(file, 0)
            after[file] = before if size == before else last_line_end(system, path, size, before if size > before else 0)
        return after | {f: n for f, n in self.known.items() if f not in after}

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        """What lies between; a file whose end moved back was cut and begins anew."""
        self.known = dict(end)
        spans = ((f, start.get(f, 0) if start.get(f, 0) <= stop else 0, stop) for f, stop in sorted(end.items()) if start.get(f, 0) != stop)
        return [p for f, begin, stop in spans for p in self.pieces(f, begin, stop)]

    def commit(self, end: dict) -> None:
        self.known = dict(end)


class WholeFilesReader(Lines, DataSourceReader):
    def partitions(self) -> list[Piece]:
        return [p for f, size in sorted(self.files().items()) for p in self.pieces(f, 0, size)]

    def read(self, partition: Piece) -> Iterator[tuple[str, int, str]]:
        yield from super().read(partition)
        if partition.stop == partition.whole:  # what stands after the last line end
            system, path = opened(partition.file)
            begin = last_line_end(system, path, partition.whole, 0)
            with system.open_input_file(path) as f:
                if rest := f.read_at(partition.whole - begin, begin).rstrip(b"\r"):
                    yield partition.file, begin, rest.decode("utf-8", "replace")


# --- use ----------------------------------------------------------------------------------------------------------


def register(spark: SparkSession) -> None:
    spark.dataSource.register(LogTail)
    spark.dataSource.register(FileTail)


def log_stream(spark: SparkSession, path: str, schema: str, id: str = "LogId", time: str = "LoggedAtUtc", lag: float = 0, **options: object) -> DataFrame:
    """The log as a stream of rows older than the lag (seconds)."""
    register(spark)
    return spark.readStream.format("tidewatch_log").schema(schema).options(path=path, id=id, time=time, lag=lag, **options).load()


def line_stream(spark: SparkSession, path: str, glob: str = "*", piece: str = "64m") -> DataFrame:
    """Lines that are appended to files."""
    register(spark)
    return spark.readStream.format("tidewatch_lines").options(path=path, glob=glob, piece=piece).load()


def line_table(spark: SparkSession, path: str, glob: str = "*", piece: str = "64m") -> DataFrame:
    """All lines of files in pieces."""
    register(spark)
    return spark.read.format("tidewatch_lines").options(path=path, glob=glob, piece=piece).load()


def write_files(files: DataFrame, folder: str) -> int:
    """Write a text file below a folder for each row (path, text), and count them. For files so many and small that Spark's writer would spend its time on opening and closing them.

    Tasks write under hidden names and rename, so a file is there whole or not at all, and a task that is run again gives the same files. Paths differ; a text is one row, so it must fit into a task.
    """

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (system, top), made = opened(folder), set()
        for batch in batches:
            for path, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                within = f"{top}/{path}".rpartition("/")[0]
                if within not in made:
                    system.create_dir(within, recursive=True)
                    made.add(within)
                hidden = f"{within}/.{uuid.uuid4().hex}"
                with system.open_output_stream(hidden) as f:
                    f.write((text or "").encode())
                system.move(hidden, f"{top}/{path}")
            yield pa.record_batch({"n": pa.array([batch.num_rows], pa.int64())})

    return files.select("path", "text").mapInArrow(written, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
