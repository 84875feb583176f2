"""Log files: line templates, entries of several lines, and searches over files.

Lines have: file, line_no, line.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.operators.globs import glob_join

#: Line numbers in a slice of a file.
SLICE_LINES = 1_000_000
#: The fields of a line and how an entry's first line begins.
FIELDS = ("timestamp", "level", "host", "pid", "thread", "message", "caller")
ENTRY_START = r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}"


@dataclass(frozen=True)
class Template:
    """A line's pattern and the fields of its groups."""

    pattern: str
    fields: tuple[str, ...]


def template(text: str) -> Template | None:
    """`{timestamp}|{level}|...` as a pattern; {*} skips text, {$} stands for a line's end and {newline} for the step to the next. None with less than two captures.

    A capture goes up to the next character of the template; before another capture it is as short as can
    be, before a line's end and at the template's end it takes the rest of the line.
    """
    parts, pattern, fields = [p for p in re.split(r"(\{[^}]*\})", text) if p], "^", []
    marks = {"$": r"(?=$|\n)", "newline": r"\n", "*": r"[^\n]*"}
    for i, part in enumerate(parts):
        name = part[1:-1] if part.startswith("{") and part.endswith("}") else None
        if name is None:
            pattern += re.escape(part)
        elif name in marks:
            pattern += marks[name]
        else:
            after = parts[i + 1] if i + 1 < len(parts) else "{$}"
            body = r"[^\n]*" if after[1:-1] in marks and after.startswith("{") else r"[^\n]*?" if after.startswith("{") else rf"[^\n{re.escape(after[0])}]*"
            pattern += f"({body})" if name in FIELDS else f"(?:{body})"
            fields += [name] if name in FIELDS else []
    return Template(pattern, tuple(fields)) if len(fields) >= 2 else None


def captured(line: Column, t: Template, name: str) -> Column:
    """A field of a line that fits the template, without blanks around it; empty if the template has no such field, null if the line doesn't fit."""
    fits = line.rlike(f"(?m){t.pattern}")
    if name not in t.fields:
        return F.when(fits, "")
    return F.when(fits, stripped(F.regexp_extract(line, f"(?m){t.pattern}", t.fields.index(name) + 1)))


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"\A\s+|\s+\z", "")


def piped(line: Column, name: str) -> Column:
    """A field of a line of at least six parts between bars, for lines that fit no template."""
    parts = F.split(line, r"\|")
    return F.when(F.size(parts) >= 6, stripped(F.get(parts, F.lit(FIELDS.index(name)))))


def parse(lines: DataFrame, templates: list[Template] = (), line: str = "line") -> DataFrame:
    """Lines with the fields of the first template that fits, else of the bar format; numbers that are none are 0.

    What belongs to an entry's later lines (a column `continuation`) is appended to its message.
    """
    out = {}
    for name in FIELDS:
        out[name] = F.coalesce(*(captured(F.col(line), t, name) for t in templates), piped(F.col(line), name))
    out["timestamp"] = out["timestamp"].try_cast("timestamp_ntz")
    for name in ("pid", "thread"):
        out[name] = F.coalesce(out[name].try_cast("int"), F.lit(0))
    if "continuation" in lines.columns:
        more = F.coalesce("continuation", F.lit(""))
        out["message"] = F.when(more == "", out["message"]).otherwise(F.concat(out["message"], F.lit("\n"), more))
    return lines.select("*", *(c.alias(n) for n, c in out.items()))


PARSED = "file string, entry int, line_index int, timestamp string, level string, host string, pid int, thread int, message string, caller string, continuations array<string>, n_lines int, plain boolean"


#: Rows of a table that a task hands over at once.
OUT_ROWS = 20_000


def parse_files(files: DataFrame, templates: list[Template] = ()) -> DataFrame:
    """Entries of whole files (file, text): wherever one of the templates matches, the first that does; a template may span lines.

    Lines between matches are continuations of the entry before them, lines before the first are left out. Without
    templates each line is an entry. Numbers that are none are 0. A file is one row, so it must fit into a task; with a column piece (a long that orders the
    pieces of a file, which end where lines end) only a piece must, and templates must be of one line. `line_index` then counts within a piece.
    """
    if "piece" in files.columns:
        return _parse_pieces(files, templates)
    return _parse_texts(files, templates)


#: The line_index of rows with a piece's lines before its first match, of which the last entry of an earlier piece is continued, or after its last one.
CONTINUES = -1


def _parse_pieces(pieces: DataFrame, templates: list[Template]) -> DataFrame:
    """Each piece for itself; only numbers of entries go from piece to piece, and lines that continue the last entry of an earlier piece."""
    if not templates or any(spans_lines(t) for t in templates):
        raise ValueError("pieces need templates of one line")
    rows = _parse_texts(pieces, templates)
    later = Window.partitionBy("file").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)  # a row for each piece
    counts = rows.groupBy("file", "piece").agg(F.count_if(F.col("line_index") != CONTINUES).alias("n"))
    before = counts.select("file", "piece", F.coalesce(F.sum("n").over(later), F.lit(0)).alias("before"))
    numbered = rows.join(before, ["file", "piece"]).withColumn("entry", (F.col("entry") + F.col("before")).cast("int"))
    own, several = F.col("line_index") != CONTINUES, F.array_sort(F.collect_list(F.struct("piece", "continuations")))
    # lines between two entries continue the first one unless all of them are blank; plain tells where one isn't
    more = numbered.where(~own).groupBy("file", "entry").agg(F.bool_or("plain").alias("any"), F.flatten(F.transform(several, lambda s: s["continuations"])).alias("more")).where("any").drop("any")
    joined = numbered.where(own).join(more, ["file", "entry"], "left").withColumn("more", F.coalesce("more", F.array().cast("array<string>")))
    names = [c.split()[0] for c in PARSED.split(", ")]
    return joined.withColumns({"continuations": F.concat("continuations", "more"), "n_lines": (F.col("n_lines") + F.size("more")).cast("int")}).select(*names)


def spans_lines(t: Template) -> bool:
    return r"\n" in t.pattern.replace(r"[^\n", "").replace(r"|\n)", "")


def _parse_texts(files: DataFrame, templates: list[Template]) -> DataFrame:
    """Entries of texts; of pieces also piece, and rows for what stands before the first match and after the last."""
    whole = "piece" not in files.columns
    groups = [[f"t{i}_{name}" for name in t.fields] for i, t in enumerate(templates)]
    pattern = "|".join(f"(?:{_named(t, gs)})" for t, gs in zip(templates, groups, strict=True))

    def entries_of(text: str) -> tuple[list, str, str]:
        """Entries, the text before the first one, and after the last one's match."""
        text = text.replace("\r\n", "\n").replace("\r", "\n")
        if not templates:
            lines = text.split("\n")
            return [(i, "", "", "", 0, 0, line, "", [], 1, True) for i, line in enumerate(lines) if line or i < len(lines) - 1], "", ""
        out: list[list] = []
        at, index, head = 0, 0, None
        for m in re.finditer(pattern, text, re.M):
            if not m[0]:
                continue
            gap = text[at : m.start()]
            index += gap.count("\n")
            _continue(out, gap)
            head = gap if head is None else head
            which = next(i for i, gs in enumerate(groups) if m[gs[0]] is not None)
            found = {name: m[g] or "" for name, g in zip(templates[which].fields, groups[which], strict=True)}
            number = lambda name: int(n[0]) if (n := re.match(r"\s*[+-]?\d{1,9}", found.get(name, ""))) else 0  # noqa: E731, B023
            field = lambda name: found.get(name, "")  # noqa: E731, B023
            out.append([index, field("timestamp").strip(), field("level").strip(), field("host"), number("pid"), number("thread"), field("message"), field("caller"), [], 1 + m[0].count("\n"), False])
            index, at = index + m[0].count("\n"), m.end()
        return out, text if head is None else head, text[at:] if out else ""

    names, given = [c.split()[0] for c in PARSED.split(", ")], ["file", "text"] if whole else ["file", "text", "piece"]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for file, text, *piece in part[given].itertuples(index=False):
                found, head, tail = entries_of(text or "")
                if whole:
                    _continue(found, tail)
                rows = [(file, i, *e, *piece) for i, e in enumerate(found)]
                for i, gap in ((-1, head), (len(found) - 1, tail)) if not whole else ():
                    if left := [line for line in gap.split("\n") if line]:
                        rows.append((file, i, CONTINUES, "", "", "", 0, 0, "", "", left, len(left), bool(gap.strip()), *piece))
                for k in range(0, len(rows), OUT_ROWS):
                    yield pd.DataFrame(rows[k : k + OUT_ROWS], columns=[*names, *given[2:]])

    return files.select(*given).mapInPandas(run, PARSED if whole else PARSED + ", piece long")


def parse_lines(lines: DataFrame, templates: list[Template], slice_lines: int = SLICE_LINES) -> DataFrame:
    """`parse_files` for templates of one line, over numbered lines (`read_lines`), so that files of any size are read in pieces.

    file, entry_no, the fields, and continuations: what the template leaves of its line, and later lines that aren't empty.
    """
    if any(spans_lines(t) for t in templates):
        raise ValueError("a template over several lines needs whole files")
    line = F.col("line")
    fits = [line.rlike(t.pattern) & (F.regexp_extract(line, t.pattern, 0) != "") for t in templates]
    which = F.coalesce(*(F.when(fit, i) for i, fit in enumerate(fits)))
    found = entries(lines.select("file", "line_no", "line"), slice_lines, which.isNotNull())
    first = found.withColumns({"which": which, "more": F.when(F.col("n_lines") > 1, F.split("continuation", "\n")).otherwise(F.array().cast("array<string>"))})
    pick = lambda value: F.coalesce(*(F.when(F.col("which") == i, value(t)) for i, t in enumerate(templates)))
    text = lambda name: F.coalesce(pick(lambda t: F.regexp_extract(line, t.pattern, t.fields.index(name) + 1) if name in t.fields else F.lit("")), F.lit(""))
    number = lambda name: F.coalesce(F.regexp_extract(text(name), r"\A\s*([+-]?[0-9]{1,9})", 1).try_cast("int"), F.lit(0))
    rest = pick(lambda t: F.substring(line, F.length(F.regexp_extract(line, t.pattern, 0)) + 1, F.lit(1 << 30)))
    fields = [stripped(text("timestamp")).alias("timestamp"), stripped(text("level")).alias("level"), text("host").alias("host"), number("pid").alias("pid"), number("thread").alias("thread"), text("message").alias("message"), text("caller").alias("caller")]
    left = F.when(F.trim(rest) != "", F.array(rest)).otherwise(F.array().cast("array<string>"))
    return first.select("file", "entry_no", *fields, F.concat(left, F.filter("more", lambda m: m != "")).alias("continuations"))


def _named(t: Template, names: list[str]) -> str:
    """The template's pattern with names for its captures, in order."""
    left = iter(names)
    return re.sub(r"(?<!\\)\((?!\?)", lambda _: f"(?P<{next(left)}>", t.pattern)


def _continue(out: list[list], text: str) -> None:
    """Add a text's lines that aren't empty to the last entry."""
    lines = [line for line in text.split("\n") if line] if out and text.strip() else []
    if lines:
        out[-1][8] += lines
        out[-1][9] += len(lines)


def entries(lines: DataFrame, slice_lines: int = SLICE_LINES, start: Column | None = None) -> DataFrame:
    """Entries: a line that begins with a time (or for which start is true) and the lines after it, joined; what stands before the first is left out.

    Files are cut into slices of line numbers; of each only its number of entries is carried on to the later ones, so no file is one task.
    """
    begins = F.when(F.col("line").rlike(ENTRY_START) if start is None else start, 1).otherwise(0)
    sliced = lines.withColumns({"begins": begins, "slice": F.floor(F.col("line_no") / slice_lines)})
    later = Window.partitionBy("file").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)  # a row for each slice of a file
    before = sliced.groupBy("file", "slice").agg(F.sum("begins").alias("n")).select("file", "slice", F.coalesce(F.sum("n").over(later), F.lit(0)).alias("before"))
    own = F.sum("begins").over(Window.partitionBy("file", "slice").orderBy("line_no"))
    numbered = sliced.withColumn("own", own).join(before, ["file", "slice"]).withColumn("entry_no", F.col("own") + F.col("before")).where("entry_no > 0")
    joined = numbered.groupBy("file", "entry_no").agg(F.sort_array(F.collect_list(F.struct("line_no", "line"))).alias("l"))
    return joined.select("file", F.col("entry_no").cast("long").alias("entry_no"), F.get("l.line", F.lit(0)).alias("line"), F.array_join(F.slice("l.line", 2, 1 << 30), "\n").alias("continuation"), F.size("l").alias("n_lines"))


def search_files(files: DataFrame, found: DataFrame) -> DataFrame:
    """Files that have any of the found entries."""
    return files.join(found.select("file").distinct(), "file", "left_semi")


def kept_folders(paths: DataFrame, matches: Column) -> DataFrame:
    """Folders that match or have a matching folder below them. paths: path, parts between slashes."""
    hit = paths.where(matches).select(F.split("path", "/").alias("p"))
    ancestors = hit.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("p")), lambda n: F.array_join(F.slice("p", 1, n), "/"))).alias("path")).distinct()
    return paths.join(ancestors, "path", "left_semi")


def read_lines(spark, folder: str, glob: str = "*") -> DataFrame:
    """The lines of all text files below a folder whose names fit, numbered within their file; empty lines count but are left out.

    Files are read in Spark's splits of any size. Lines of a split are in order, so a line's number is the number of lines in the splits before it, of which
    there is a row for each split, and its place in its own.
    """
    text = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(folder)
    lines = text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"), F.col("value").alias("line"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = lines.groupBy("file", "block").agg(F.min("n").alias("first"), F.count("*").alias("lines"))
    before = splits.select("file", "block", "first", F.coalesce(F.sum("lines").over(earlier), F.lit(0)).alias("before"))
    return lines.join(before, ["file", "block"]).where("line != ''").select("file", (F.col("before") + F.col("n") - F.col("first")).alias("line_no"), "line")


def file_table(spark, folder: str, glob: str = "*") -> DataFrame:
    """Name, size and time of change of the files below a folder."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(folder)
    return rows.select(F.col("path").alias("FullPath"), F.element_at(F.split("path", "/"), -1).alias("FileName"), F.col("length").alias("SizeBytes"), F.col("modificationTime").alias("ModifiedUtc"))


def merge_folders(*listings: DataFrame) -> DataFrame:
    """Folders of several servers as one listing, names without regard to case. listings: server, name."""
    every = listings[0]
    for more in listings[1:]:
        every = every.unionByName(more)
    return every.groupBy(F.lower("name").alias("low")).agg(F.min_by("name", "server").alias("name")).select("name").orderBy(F.upper("name"), "name")


def detect(sample: DataFrame, templates: list[Template], chars: int = 10_000) -> int | None:
    """The template that fits at least two of a file's first lines (file order by line_no, up to so many characters), else one that fits any.

    Of several the one with most fields, then with most matched text.
    """
    if not templates:
        return None
    upto = F.sum(F.length("line") + 1).over(Window.orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1))
    first = sample.where(F.col("line_no") <= chars).withColumn("at", F.coalesce(upto, F.lit(0))).where(F.col("at") < chars)  # at most `chars` lines
    first = first.withColumn("line", F.substring("line", F.lit(1), F.lit(chars) - F.col("at").cast("int")))
    fits = [F.count_if(F.col("line").rlike(t.pattern)) for t in templates]
    size = [F.coalesce(F.sum(F.length(F.regexp_extract("line", t.pattern, 0))), F.lit(0)) for t in templates]
    row = first.agg(*(c.alias(f"f{i}") for i, c in enumerate(fits)), *(c.alias(f"s{i}") for i, c in enumerate(size))).first()
    good = [i for i in range(len(templates)) if row[f"f{i}"] >= 2] or [i for i in range(len(templates)) if row[f"f{i}"]]
    return max(good, key=lambda i: (len(templates[i].fields), row[f"s{i}"], -i), default=None)


def search_pattern(text: str, regex: bool = False, case_sensitive: bool = False) -> str:
    body = text if regex else "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E"
    re.compile(text if regex else re.escape(text))
    return ("" if case_sensitive else "(?iu)") + body


def search(rows: DataFrame, column: str, text: str, regex: bool = False, case_sensitive: bool = False) -> DataFrame:
    """Rows that hold the text, with what is found in double angle brackets."""
    pattern = search_pattern(text, regex, case_sensitive)
    return rows.where(F.col(column).rlike(pattern)).withColumn("highlighted", F.regexp_replace(column, f"({pattern})", "«$1»"))


def match_counts(rows: DataFrame, column: str, text: str, regex: bool = False, case_sensitive: bool = False, by: str = "file") -> DataFrame:
    """How many rows of each file hold the text."""
    return rows.where(F.col(column).rlike(search_pattern(text, regex, case_sensitive))).groupBy(by).agg(F.count("*").alias("n"))


FILE_ORDER = {"host": "Server", "file": "FileName", "size": "SizeBytes", "created": "CreatedUtc", "modified": "ModifiedUtc"}


def sorted_files(files: DataFrame, key: str = "modified", descending: bool = True, most: int | None = None) -> DataFrame:
    """Files by host, file, size, created or modified, ties by path; most: as many as a search shows."""
    by = F.col(FILE_ORDER[key])
    rows = files.orderBy(by.desc() if descending else by.asc(), "FullPath")
    return rows.limit(most) if most is not None else rows


#: Files that a search shows.
MOST_RESULTS = 5000


def found_files(files: DataFrame, found: DataFrame, most: int = MOST_RESULTS) -> DataFrame:
    """The first files by path, up to a cap, that have any of the found entries (file), and whether there are more (capped)."""
    hit = files.join(found.select(F.col("file").alias("FullPath")).distinct(), "FullPath", "left_semi")
    some = hit.orderBy("FullPath").limit(most + 1).withColumn("place", F.row_number().over(Window.orderBy("FullPath")))  # at most `most` + 1 rows
    return some.withColumn("capped", F.max("place").over(Window.partitionBy()) > most).where(F.col("place") <= most).drop("place")


def log_path(pattern: str, service: str, server: str, pid: int, env: str, day) -> str:
    """A path pattern with {date}, {date-1}, {server}, {service}, {pid} and {env} filled in."""
    from datetime import timedelta

    values = {"{date}": f"{day:%Y%m%d}", "{date-1}": f"{day - timedelta(days=1):%Y%m%d}", "{server}": server, "{service}": service, "{pid}": str(pid), "{env}": env}
    for name, value in values.items():
        pattern = pattern.replace(name, value)
    return pattern


def newest_file(files: DataFrame, patterns: DataFrame) -> DataFrame:
    """For each key the newest file that its pattern fits; of a key's patterns the first with any file counts.

    patterns: key, idx, pattern (a glob).
    """
    hit = glob_join(files.select("FullPath", "ModifiedUtc"), F.col("FullPath"), patterns.select("key", "idx", "pattern"), "pattern")
    return hit.groupBy("key").agg(F.max_by("FullPath", F.struct(-F.col("idx"), "ModifiedUtc", "FullPath")).alias("FullPath"))
