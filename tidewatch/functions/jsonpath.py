"""JSON paths over a column, as Spark expressions.

Names, indices and one-level wildcards are native; a filter compares one field of an array's items with a number or
a text. Results are a JSON array and its size, as path queries give them: no match is an empty array.
"""

from __future__ import annotations

import json
import operator
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

STEP = re.compile(r"\.([A-Za-z_]\w*)|\[(\d+)\]|\[\*\]|\[\?\(@\.([A-Za-z_]\w*)\s*(<=|>=|<|>|==|!=)\s*([^)]+)\)\]")
TESTS = {"<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge, "==": operator.eq, "!=": operator.ne}


def steps(path: str) -> list[tuple]:
    """The steps of a path, or ValueError."""
    if not path.strip():
        raise ValueError("a blank path")
    if not path.startswith("$"):
        raise ValueError("a path begins with $")
    at, out = 1, []
    while at < len(path):
        m = STEP.match(path, at)
        if not m:
            raise ValueError(f"no step of a path: {path[at:]!r}")
        name, index, field, test, value = m.groups()
        out.append(("name", name) if name else ("index", int(index)) if index else ("test", field, test, json.loads(value.replace("'", '"'))) if field else ("all",))
        at = m.end()
    return out


def _member(found: Column, here: str) -> Column:
    """The values at a name or index of each of the found ones, without those that have none."""
    return F.filter(F.transform(found, lambda d: F.to_json(F.try_variant_get(F.try_parse_json(d), here, "variant"))), lambda d: d.isNotNull())


def _items(found: Column) -> Column:
    """The items of each array found."""
    parts = lambda d: F.coalesce(F.try_variant_get(F.try_parse_json(d), "$", "array<variant>"), F.array().cast("array<variant>"))
    return F.flatten(F.transform(found, lambda d: F.transform(parts(d), lambda v: F.to_json(v))))


def _passing(found: Column, name: str, test: str, value: object) -> Column:
    number = isinstance(value, (int, float)) and not isinstance(value, bool)
    other, kind = (F.lit(float(value)), "double") if number else (F.lit(value), "boolean" if isinstance(value, bool) else "string")
    return F.filter(found, lambda d: F.coalesce(TESTS[test](F.try_variant_get(F.try_parse_json(d), f"$.{name}", kind), other), F.lit(False)))


def query(document: Column, path: str) -> Column:
    """A struct of success, result (a JSON array) and n; success is false where the document is no JSON."""
    good = F.try_parse_json(document).isNotNull()
    found = F.filter(F.array(document), lambda d: d.isNotNull())
    for step in steps(path):
        if step[0] == "name":
            found = _member(found, f"$.{step[1]}")
        elif step[0] == "index":
            found = _member(found, f"$[{step[1]}]")
        else:
            found = _items(found)
            if step[0] == "test":
                found = _passing(found, *step[1:])
    return F.struct(good.alias("success"), F.when(good, F.concat(F.lit("["), F.array_join(found, ","), F.lit("]"))).alias("result"), F.when(good, F.size(found)).alias("n"))
