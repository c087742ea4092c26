"""0/1 indicator columns and null-keeping filters.

An indicator is never null: an unknown code is "not in the group". A sentinel filter drops only
the sentinel and keeps rows whose code is unknown.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def flag(condition: Column) -> Column:
    """1 where the condition holds, 0 where it does not or is unknown."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def prefix_flag(col: Column, prefix: str) -> Column:
    return flag(col.startswith(prefix))


def member_flag(col: Column, values: Iterable) -> Column:
    return flag(col.isin(list(values)))


def range_flag(col: Column, low, high) -> Column:
    """Both ends included."""
    return flag(col.between(low, high))


def equal_flag(col: Column, value) -> Column:
    return flag(col == F.lit(value))


def differs_or_null(col: Column, sentinel) -> Column:
    """Predicate ``col <> sentinel`` that keeps rows where ``col`` is null."""
    return ~col.eqNullSafe(F.lit(sentinel))


def any_column_equals(columns: Iterable[str], value: str) -> Column:
    """True when at least one of the columns, read as text, equals ``value``."""
    hits = [F.coalesce(F.col(f"`{c}`").cast("string") == F.lit(value), F.lit(False)) for c in columns]
    return F.greatest(*hits) if len(hits) > 1 else hits[0]


def blank_or_null(col: Column) -> Column:
    text = F.trim(col.cast("string"))
    return text.isNull() | (text == F.lit(""))
