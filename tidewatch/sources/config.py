"""Configuration files: topology hints, environments and the batch catalog. JSON may have comments and trailing commas."""

from __future__ import annotations

import json
import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text in quotes, or a comment, or a comma before a closing bracket.
_JSONC = re.compile(r'("(?:\\.|[^"\\])*")|//[^\n]*|/\*.*?\*/|,(?=\s*[}\]])', re.S)
HINT_SCHEMA = "idx int, name string, role string, grp string, color string, ord int, publishes array<string>, subscribes array<string>"


def loads(text: str) -> object:
    """JSON with comments and trailing commas."""
    bare = re.sub(r"//[^\n]*|/\*.*?\*/", "", text) if '"' not in text else _JSONC.sub(lambda m: m[1] or "", text)
    return json.loads(_JSONC.sub(lambda m: m[1] or "", bare))


def load(path: str, default: object = None) -> object:
    """A file's content, or the default where it is missing or invalid."""
    try:
        return loads(Path(path).read_text(encoding="utf-8-sig"))
    except (OSError, ValueError):
        return default


def environment(folder: str, env: str, defaults: dict[str, dict]) -> dict[str, dict]:
    """An environment's sections from `env.json`, names in any case, over the defaults; these alone where the file is missing or invalid."""
    found = load(f"{folder}/{env.lower()}.json")
    given = {str(k).lower(): v for k, v in found.items()} if isinstance(found, dict) else {}
    out = {}
    for section, values in defaults.items():
        own = given.get(section.lower())
        own = {str(k).lower(): v for k, v in own.items()} if isinstance(own, dict) else {}
        out[section] = {name: own.get(name.lower(), value) for name, value in values.items()}
    return out


def hints(spark: SparkSession, folder: str, run_type: str) -> DataFrame | None:
    """The service hints of a run type as rows in order of declaration, None without a valid file."""
    found = load(f"{folder}/{run_type.lower()}.json")
    if not isinstance(found, dict):
        return None
    rows = [(i, s.get("name"), s.get("role", ""), s.get("group", ""), s.get("color"), s.get("order"), s.get("publishes", []), s.get("subscribes", [])) for i, s in enumerate(found.get("services", []))]
    return spark.createDataFrame(rows, HINT_SCHEMA)


def matching_jobs(catalog: DataFrame, category: str | None = None, text: str = "") -> DataFrame:
    """Jobs of a category of which name, description or any tag holds the text. catalog: name, description, category, tags."""
    rows = catalog if category is None else catalog.where(F.lower("category") == category.lower())
    has = lambda c: F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(text.lower()))
    return rows.where(has(F.col("name")) | has(F.col("description")) | F.coalesce(F.exists("tags", has), F.lit(False))) if text else rows


def categories(catalog: DataFrame) -> DataFrame:
    return catalog.select("category").where("category IS NOT NULL").distinct().orderBy("category")


def setting(column: Column, default: object) -> Column:
    return F.coalesce(column, F.lit(default))
