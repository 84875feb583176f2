"""Scalar functions over columns: labels, names, formats, hashes."""

from __future__ import annotations

import json
import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip_label(label: Column, words: list[str], env_id: str = "") -> Column:
    """A label without some words (in any case; {EnvID} stands for env_id), without runs and ends of - and _.

    A label of which nothing is left stays as it is.
    """
    words = [re.sub(r"(?i)\{EnvID\}", lambda _: env_id, w) for w in words]
    bare = reduce(lambda c, w: F.regexp_replace(c, "(?i)" + re.escape(w), ""), [w for w in words if w], label)
    bare = F.trim(F.regexp_replace(bare, r"([_-])[_-]+", "$1"), F.lit(" -_"))
    return F.when(F.coalesce(bare, F.lit("")) == "", label).otherwise(bare)


def topic_name(pipeline: Column) -> Column:
    """`csv ingest` -> `csv-ingest-events`; blank stays empty."""
    return F.when(F.trim(F.coalesce(pipeline, F.lit(""))) == "", "").otherwise(F.concat(F.replace(F.lower(pipeline), F.lit(" "), F.lit("-")), F.lit("-events")))


def clock(seconds: Column) -> Column:
    """h:mm:ss, or m:ss below an hour."""
    s = F.floor(seconds).cast("long")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    h, m, r = F.floor(s / 3600).cast("long"), F.floor(s % 3600 / 60).cast("long"), s % 60
    return F.when(h > 0, F.concat_ws(":", h.cast("string"), two(m), two(r))).otherwise(F.concat_ws(":", m.cast("string"), two(r)))


def age(seconds: Column) -> Column:
    """`12s ago`, `3m ago`, `2h ago`, `1d ago`."""
    s = F.floor(seconds).cast("long")
    unit = lambda n, u: F.concat(F.floor(s / n).cast("long").cast("string"), F.lit(f"{u} ago"))
    return F.when(s < 60, unit(1, "s")).when(s < 3600, unit(60, "m")).when(s < 86400, unit(3600, "h")).otherwise(unit(86400, "d"))


def memory(mb: Column) -> Column:
    """`640 MB` below 1000, else `1.5 GB`."""
    return F.when(mb < 1000, F.format_string("%.0f MB", mb)).otherwise(F.format_string("%.1f GB", mb / 1024))


def progress_text(finish: Column, error: Column) -> Column:
    return F.when(F.coalesce(error, F.lit("")) != "", "error").when(finish.isNotNull(), "done").otherwise("inprogress")


def palette_index(text: Column, n: int) -> Column:
    """A stable place in a palette: the text's 31-multiplier hash in 32 signed bits, without its sign."""
    # two bytes for each of the text's UTF-16 units
    units = F.hex(F.encode(text, "UTF-16BE"))
    codes = F.transform(F.sequence(F.lit(1), F.greatest(F.length(units), F.lit(4)), F.lit(4)), lambda i: F.conv(F.substr(units, i, F.lit(4)), 16, 10).cast("long"))
    codes = F.when(F.length(units) > 0, codes).otherwise(F.array().cast("array<bigint>"))
    wrap = lambda x: F.pmod(x + 2**31, F.lit(2**32)) - 2**31
    return F.abs(F.aggregate(codes, F.lit(0).cast("long"), lambda h, c: wrap(h * 31 + c))) % n


def natural_key(text: Column) -> Column:
    """A sort key by which 2 stands before 10: numbers, of any length, are led by the length of their digits."""
    digits = lambda p: F.ltrim(p, F.lit("0"))
    padded = F.transform(F.regexp_extract_all(text, F.lit(r"(\d+|\D+)"), 1), lambda p: F.when(p.rlike(r"^\d"), F.concat(F.lpad(F.length(digits(p)).cast("string"), 8, "0"), digits(p))).otherwise(F.lower(p)))
    return F.array_join(padded, "")


def position(t: Column, low: Column, high: Column) -> Column:
    """Where between two moments t is, from 0 to 1."""
    return F.least(F.greatest(F.coalesce(F.try_divide(t - low, high - low), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))


def composite_key(*parts: Column, by: str = ":") -> Column:
    return F.concat_ws(by, *parts)


def mib(size: Column) -> Column:
    return size / (1024 * 1024)


def mb(size: Column) -> Column:
    return size / 1e6


def fill(text: str, values: dict[str, str]) -> str:
    """`{key}` replaced by values, keys in any case; unknown ones stay."""
    low = {k.lower(): v for k, v in values.items()}
    return re.sub(r"\{([^{}]+)\}", lambda m: str(low.get(m[1].lower(), m[0])), text)


def typed_body(values: dict[str, object], kinds: dict[str, str]) -> str:
    """A JSON body of parameter values: booleans, numbers and multiselects (comma-separated or lists) by kind, others as text; unparsable numbers stay text."""
    body: dict[str, object] = {}
    for key, value in values.items():
        kind = kinds.get(key, "text").lower()
        if kind == "boolean":
            body[key] = str(value) in ("true", "True", "1")
        elif kind == "multiselect":
            body[key] = [str(v).strip() for v in (value if isinstance(value, (list, tuple)) else str(value).split(",")) if str(v)]
        elif kind == "number" and re.fullmatch(r"\s*[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?\s*", str(value)):
            body[key] = float(value)
        else:
            body[key] = str(value)
    return json.dumps(body)
