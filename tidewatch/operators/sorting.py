"""Sorts by several columns, texts without regard to case."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sorted_by(rows: DataFrame, *keys: str, allowed: tuple[str, ...] | None = None) -> DataFrame:
    """rows by columns, each descending if a minus stands before it; nulls are least. Texts go by their upper case, and where that is equal as they are.

    allowed: columns that may be asked for; others are passed over, so that a user's wish can't name any column.
    """
    kinds, order, ties = dict(rows.dtypes), [], []
    for key in keys:
        name = key.removeprefix("-")
        if name not in kinds or (allowed is not None and name not in allowed):
            continue
        towards = (lambda c: c.desc_nulls_last()) if key.startswith("-") else (lambda c: c.asc_nulls_first())
        if kinds[name] == "string":
            order.append(towards(F.upper(F.col(f"`{name}`"))))
            ties.append(towards(F.col(f"`{name}`")))
        else:
            order.append(towards(F.col(f"`{name}`")))
    return rows.orderBy(*order, *ties) if order else rows
