"""Filters as plain data that become Spark columns.

A filter is a tree of And, Or, Not and Term. `column()` gives the Spark predicate: one expression, so
Catalyst pushes what it can into the scan. Terms that stand under no Not are left bare for that; under a Not a
null is taken as false first, since filters here are two-valued.
"""

from __future__ import annotations

import functools
import json
import operator
import re
from dataclasses import dataclass, field
from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Spellings under which another column's name is also known.
SYNONYMS = {"starttime": "Start", "endtime": "End"}
YEAR_ONE = datetime(1, 1, 1)


@dataclass(frozen=True)
class TimeOfDay:
    """Seconds since midnight."""

    seconds: int


@dataclass(frozen=True)
class Term:
    """A condition on one field. op: contains, exact, glob, isnull, gt, ge, lt, le, between (value: a pair)."""

    field: str
    op: str
    value: object = None
    case_sensitive: bool = False


@dataclass(frozen=True)
class And:
    items: tuple = ()


@dataclass(frozen=True)
class Or:
    items: tuple = ()


@dataclass(frozen=True)
class Not:
    item: object = None


@dataclass(frozen=True)
class View:
    """What a listing searches: the fields of terms without a field, and other names of fields."""

    fields: tuple[str, ...]
    aliases: dict[str, str] = field(default_factory=dict)

    def any_field(self, value: object, op: str = "contains", case_sensitive: bool = False) -> Or | None:
        """A term without a field: any of the view's fields may satisfy it; None for a view without fields."""
        return Or(tuple(Term(f, op, value, case_sensitive) for f in self.fields)) if self.fields else None

    def field(self, name: str) -> str:
        return {k.lower(): v for k, v in self.aliases.items()}.get(name.lower(), name)

    def term(self, name: str, op: str, value: object = None, case_sensitive: bool = False) -> Term:
        return Term(self.field(name), op, value, case_sensitive)

    def group(self, name: str, values: list, op: str = "contains") -> Or:
        """One field, any of several values."""
        return Or(tuple(self.term(name, op, v) for v in values))


DEFAULT_ALIASES = {"id": "RunId", "desc": "Description", "start": "StartTime", "end": "EndTime"}
VIEWS = {
    "runs": View(("RunId", "Description", "Type", "Status"), DEFAULT_ALIASES),
    "run stats": View(("RunId", "Description", "Type", "Status", "Env"), DEFAULT_ALIASES),
    "add run": View(("RunId", "Description"), DEFAULT_ALIASES),
    "services": View(("ServiceName", "HostName", "ProcessId"), {"svc": "ServiceName", "name": "ServiceName", "host": "HostName", "pid": "ProcessId", "mem": "RamMb", "peak": "PeakMb", "updated": "UpdatedDateTime"}),
    "run errors": View(("Service", "Server", "Pipeline", "Name", "Source", "Info", "Error"), {"svc": "Service", "pipe": "Pipeline", "srv": "Server", "host": "Server", "pid": "ProcessId", "src": "Source", "chunk": "Name", "info": "Info", "err": "Error", "time": "Start", "start": "Start"}),
    "topics": View(("Name", "PartitionCount", "MessageCount"), {"topic": "Name", "partitions": "PartitionCount", "parts": "PartitionCount", "messages": "MessageCount", "msgs": "MessageCount"}),
    "consumer groups": View(("GroupId", "State"), {"group": "GroupId", "state": "State"}),
    "topic messages": View(("Key", "PayloadType"), {"key": "Key", "type": "PayloadType", "ts": "Timestamp"}),
    "documents": View(("_id",)),
    "collections": View(("name",), {"collection": "name"}),
    "log search": View(("Level", "Machine", "Message"), {"ts": "Timestamp", "pid": "ProcessId", "thread": "ThreadId", "tid": "ThreadId", "msg": "Message", "caller": "Caller"}),
    "files": View(("Server", "FileName"), {"host": "Server", "file": "FileName", "name": "FileName", "size": "SizeBytes", "created": "CreatedUtc", "updated": "ModifiedUtc", "modified": "ModifiedUtc", "path": "FullPath"}),
    "folders": View(("RelativePath",), {"path": "RelativePath", "name": "RelativePath"}),
    "memory legend": View(("Name",), DEFAULT_ALIASES),
}


def moment(text: str, as_of: datetime) -> datetime | None:
    """now, today, yesterday, -2h (before now), 3d (after today), hh:mm[:ss] (today) or an ISO date, relative to as_of."""
    text = text.strip().lower().removesuffix("z") if text.strip().lower() in ("nowz", "todayz", "yesterdayz") else text.strip().lower()
    today = as_of.replace(hour=0, minute=0, second=0, microsecond=0)
    named = {"now": as_of, "today": today, "yesterday": today - timedelta(days=1)}
    if text in named:
        return named[text]
    if m := re.fullmatch(r"(-?)(\d+)([smhdw])", text):
        span = timedelta(**{{"s": "seconds", "m": "minutes", "h": "hours", "d": "days", "w": "weeks"}[m[3]]: int(m[2])})
        return as_of - span if m[1] else today + span
    if m := re.fullmatch(r"(\d{1,2}):(\d{2})(?::(\d{2}))?", text):
        return today + timedelta(hours=int(m[1]), minutes=int(m[2]), seconds=int(m[3] or 0))
    try:
        return datetime.fromisoformat(text.upper().removesuffix("Z"))
    except ValueError:
        return None


def glob_pattern(glob: str, anchored: bool = True) -> str:
    """A case-insensitive pattern in which * and ? stand for characters of one line."""
    body = "".join({"*": r"[^\n]*", "?": r"[^\n]"}.get(c, "\\Q" + c.replace("\\E", "") + "\\E") for c in glob)
    return rf"(?iu)\A{body}\n?\z" if anchored else f"(?iu){body}"


def glob_column(glob: Column) -> Column:
    """The pattern of glob_pattern for globs in a column."""
    literal = F.regexp_replace(glob, r"([^\w*? ])", r"\\$1")
    body = F.replace(F.replace(literal, F.lit("*"), F.lit(r"[^\n]*")), F.lit("?"), F.lit(r"[^\n]"))
    return F.concat(F.lit(r"(?iu)\A"), body, F.lit(r"\n?\z"))


def number_text(value: float) -> str:
    return str(int(value)) if float(value).is_integer() else repr(float(value))


def as_text(c: Column, kind: T.DataType) -> Column:
    """A value as text: whole doubles without a fraction, booleans as True and False."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.regexp_replace(c.cast("string"), r"\.0$", "")
    if isinstance(kind, T.BooleanType):
        return F.initcap(c.cast("string"))
    return c.cast("string")


class Compiler:
    """Columns for the terms of one schema. mode "memory": two-valued, null and '' alike; "sql": equality on dates, null only."""

    def __init__(self, schema: T.StructType, mode: str = "memory", payload: str | None = None):
        self.schema, self.mode, self.payload = schema, mode, payload

    def source(self, name: str) -> tuple[Column, T.DataType]:
        """The column of a field by any case or synonym, else a value of the JSON payload, else null."""
        by_name = {f.name.lower(): f for f in self.schema.fields}
        found = by_name.get(name.lower()) or by_name.get(SYNONYMS.get(name.lower(), "").lower())
        if found:
            return F.col(f"`{found.name}`"), found.dataType
        if self.payload:  # a value of the payload by its name, else by the name with a small first letter
            value = lambda n: F.get_json_object(F.col(self.payload), f"$.{n}")
            return F.coalesce(value(name), value(name[:1].lower() + name[1:])), T.StringType()
        return F.lit(None).cast("string"), T.StringType()

    def leaf(self, t: Term) -> Column:
        c, kind = self.source(t.field)
        if t.op == "isnull":
            return c.isNull() | (c == "") if self.mode == "memory" and isinstance(kind, T.StringType) else c.isNull()
        if t.op == "between":
            low, high = t.value
            if type(low) is not type(high) and not (isinstance(low, (int, float)) and isinstance(high, (int, float))):
                return F.lit(False)
            return self.leaf(Term(t.field, "ge", low)) & self.leaf(Term(t.field, "le", high))
        if t.op in ("gt", "ge", "lt", "le"):
            return self.compared(t.op, c, kind, t.value)
        text = as_text(c, kind)
        if t.op == "glob":
            return text.rlike(glob_pattern(str(t.value)))
        if t.op == "contains":
            if isinstance(t.value, bool) or isinstance(t.value, (datetime, TimeOfDay)):
                return F.lit(False)
            if isinstance(t.value, (int, float)):
                return F.contains(text, F.lit(number_text(t.value)))
            return F.contains(text, F.lit(t.value)) if t.case_sensitive else F.contains(F.lower(text), F.lit(t.value.lower()))
        if t.op == "exact":
            if isinstance(t.value, datetime):
                return self.instant(c, kind) == F.lit(t.value) if self.mode == "sql" else F.lit(False)
            if isinstance(t.value, bool):
                yes = c if isinstance(kind, T.BooleanType) else F.lower(text).isin("true", "1")
                return yes == F.lit(t.value)
            if isinstance(t.value, (int, float)):
                return self.number(c, kind) == F.lit(float(t.value))
            if isinstance(t.value, TimeOfDay):
                return F.lit(False)
            return text == F.lit(t.value) if t.case_sensitive else F.lower(text) == F.lit(t.value.lower())
        raise ValueError(f"no such condition: {t.op}")

    def number(self, c: Column, kind: T.DataType) -> Column:
        """As a double; what is no number counts as 0."""
        return c.cast("double") if isinstance(kind, T.NumericType) else F.when(c.isNotNull(), F.coalesce(c.try_cast("double"), F.lit(0.0)))

    def instant(self, c: Column, kind: T.DataType) -> Column:
        """As a timestamp without zone; what is none counts as the year 1."""
        if isinstance(kind, T.TimestampNTZType):
            return c
        return F.when(c.isNotNull(), F.coalesce(c.try_cast("timestamp_ntz"), F.lit(YEAR_ONE).cast("timestamp_ntz")))

    def compared(self, op: str, c: Column, kind: T.DataType, value: object) -> Column:
        test = {"gt": operator.gt, "ge": operator.ge, "lt": operator.lt, "le": operator.le}[op]
        if isinstance(value, TimeOfDay):
            at = self.instant(c, kind)
            return test(F.hour(at) * 3600 + F.minute(at) * 60 + F.second(at), F.lit(value.seconds))
        if isinstance(value, datetime):
            return test(self.instant(c, kind), F.lit(value).cast("timestamp_ntz"))
        if isinstance(value, bool) or not isinstance(value, (int, float)):
            return F.lit(False)
        return test(self.number(c, kind), F.lit(float(value)))

    def column(self, node: object, negated: bool = False) -> Column:
        if node is None:
            return F.lit(True)
        if isinstance(node, Term):
            leaf = self.leaf(node)
            return F.coalesce(leaf, F.lit(False)) if negated and self.mode == "memory" else leaf
        if isinstance(node, Not):
            return ~self.column(node.item, True)
        parts = [self.column(x, negated) for x in node.items]
        if isinstance(node, And):
            return functools.reduce(operator.and_, parts, F.lit(True)) if not parts else functools.reduce(operator.and_, parts)
        return functools.reduce(operator.or_, parts) if parts else F.lit(False)


def column(node: object, schema: T.StructType, mode: str = "memory", payload: str | None = None) -> Column:
    """The filter as a predicate over rows of this schema."""
    return Compiler(schema, mode, payload).column(node)


def references(node: object, name: str) -> bool:
    """Whether any term is about this field, under whatever And, Or or Not."""
    if isinstance(node, Term):
        return node.field.lower() == name.lower()
    if isinstance(node, Not):
        return references(node.item, name)
    return any(references(x, name) for x in getattr(node, "items", ()))


def to_json(node: object) -> str:
    return json.dumps(_plain(node))


def _plain(node: object) -> object:
    if isinstance(node, Term):
        return {"type": "term", "field": node.field, "op": node.op, "value": _plain_value(node.value), "caseSensitive": node.case_sensitive}
    if isinstance(node, Not):
        return {"type": "not", "item": _plain(node.item)}
    if isinstance(node, (And, Or)):
        return {"type": type(node).__name__.lower(), "items": [_plain(x) for x in node.items]}
    return None


def _plain_value(v: object) -> object:
    if isinstance(v, datetime):
        return {"date": v.isoformat()}
    if isinstance(v, TimeOfDay):
        return {"seconds": v.seconds}
    return [_plain_value(x) for x in v] if isinstance(v, tuple) else v


def from_json(text: str) -> object:
    return _tree(json.loads(text))


def _tree(x: dict | None) -> object:
    if x is None:
        return None
    if x["type"] == "term":
        return Term(x["field"], x["op"], _value(x["value"]), x.get("caseSensitive", False))
    if x["type"] == "not":
        return Not(_tree(x["item"]))
    return {"and": And, "or": Or}[x["type"]](tuple(map(_tree, x["items"])))


def _value(v: object) -> object:
    if isinstance(v, dict):
        return datetime.fromisoformat(v["date"]) if "date" in v else TimeOfDay(v["seconds"])
    return tuple(map(_value, v)) if isinstance(v, list) else v


@dataclass(frozen=True)
class Seek:
    """Where reading a topic begins and ends."""

    partitions: tuple[int, ...] | None = None
    offset_from: int | None = None
    offset_to: int | None = None
    time_from: datetime | None = None
    time_to: datetime | None = None
    latest: int | None = None


def seek(node: object) -> tuple[Seek, object]:
    """The directive held by terms on partition, offset, timestamp and latest, and the filter that is left.

    Such terms are taken out wherever they stand, also under Or and Not; what they leave behind is true.
    """
    found: dict[str, object] = {}

    def take(x: object) -> object:
        if isinstance(x, Not):
            return Not(take(x.item))
        if isinstance(x, (And, Or)):
            return type(x)(tuple(map(take, x.items)))
        name = x.field.lower()
        low, high = x.value if x.op == "between" else (x.value if x.op in ("exact", "contains", "gt", "ge") else None, x.value if x.op in ("exact", "contains", "lt", "le") else None)
        if name == "partition" and x.op in ("exact", "contains"):
            found["partitions"] = (*(found.get("partitions") or ()), int(x.value))
        elif name == "offset":
            step = x.op == "gt", x.op == "lt"
            found.update({k: int(v) + d for k, v, d in (("offset_from", low, step[0]), ("offset_to", high, -step[1])) if v is not None})
        elif name == "timestamp":
            found.update({k: v for k, v in (("time_from", low), ("time_to", high)) if isinstance(v, datetime)})
        elif name == "latest":
            found["latest"] = int(x.value)
        else:
            return x
        return And(())

    rest = take(node) if node is not None else None
    return Seek(**found), rest


def collection_filter(text: str, tree: object = None) -> object:
    """A filter of collection names: the tree that the caller made of the text, or without one its text, taken literally."""
    return tree if tree is not None else Term("name", "contains", text.strip()) if text.strip() else None


def document_column(text: str, schema: T.StructType, tree: object = None, key: str = "_id") -> Column:
    """A filter of documents: the caller's tree, or without one the text as a pattern of the key; text that is no pattern is taken literally."""
    if tree is not None:
        return column(tree, schema)
    if not text.strip():
        return F.lit(True)
    try:
        re.compile(text)
        pattern = text
    except re.error:
        pattern = "\\Q" + text.replace("\\E", "") + "\\E"
    return F.coalesce(F.col(f"`{key}`").cast("string").rlike(f"(?iu){pattern}"), F.lit(False))


def match_column(query: dict, schema: T.StructType, payload: str | None = None) -> Column:
    """A document-store match ($eq, $ne, $gt, $gte, $lt, $lte, $in, $nin, $regex, $exists, $and, $or, $nor, $not) as a predicate."""
    compiler = Compiler(schema, "memory", payload)

    def value(name: str, like: object) -> Column:
        c, kind = compiler.source(name)
        if isinstance(like, (int, float)) and not isinstance(like, bool) and not isinstance(kind, T.NumericType):
            return c.try_cast("double")
        return c

    def test(name: str, op: str, v: object) -> Column:
        c = value(name, v[0] if isinstance(v, list) and v else v)
        if op in ("$eq", "$ne"):
            same = c.isNull() if v is None else F.coalesce(c == F.lit(v), F.lit(False))
            return same if op == "$eq" else ~same
        if op in ("$in", "$nin"):
            inside = F.coalesce(c.isin(*v), F.lit(False)) if v else F.lit(False)
            return inside if op == "$in" else ~inside
        if op in ("$gt", "$gte", "$lt", "$lte"):
            return F.coalesce({"$gt": operator.gt, "$gte": operator.ge, "$lt": operator.lt, "$lte": operator.le}[op](c, F.lit(v)), F.lit(False))
        if op == "$regex":
            re.compile(v)
            return F.coalesce(c.cast("string").rlike(v), F.lit(False))
        if op == "$exists":
            return c.isNotNull() if v else c.isNull()
        if op == "$not":
            return ~functools.reduce(operator.and_, (test(name, o, x) for o, x in v.items()))
        raise ValueError(f"no such condition: {op}")

    parts = []
    for name, v in query.items():
        if name in ("$and", "$or", "$nor"):
            joined = functools.reduce(operator.and_ if name == "$and" else operator.or_, (match_column(x, schema, payload) for x in v))
            parts.append(~joined if name == "$nor" else joined)
        elif isinstance(v, dict) and v and all(k.startswith("$") for k in v):
            parts.extend(test(name, op, x) for op, x in v.items())
        else:
            parts.append(test(name, "$eq", v))
    return functools.reduce(operator.and_, parts) if parts else F.lit(True)
