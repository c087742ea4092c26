"""Numeric coercion and null-skipping sums."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def number_or_null(col: Column) -> Column:
    """Text to double; anything that is not a plain number becomes null."""
    text = F.trim(col.cast("string"))
    java_suffix = text.rlike("[0-9.][dDfF]$")  # Java reads "1d" as a double
    return nan_to_null(F.when(~java_suffix, text.try_cast("double")))


def nan_to_null(col: Column) -> Column:
    """Unknown is null, never NaN: Spark orders NaN above every number, so NaN >= x is true."""
    return F.when(~F.isnan(col), col)


def row_sum(cols: Iterable[Column], null_mode: str = "cell") -> Column:
    """Sum across columns of one row.

    ``cell`` counts an unknown cell as 0; ``row`` makes the whole row unknown.
    """
    if null_mode not in ("cell", "row"):
        raise ValueError(f"null_mode must be 'cell' or 'row', not {null_mode!r}")
    parts = [F.coalesce(c, F.lit(0)) if null_mode == "cell" else c for c in cols]
    total = parts[0]
    for part in parts[1:]:
        total = total + part
    return total


def sum_or_zero(col: Column) -> Column:
    """Aggregate: the sum, 0 when every value is unknown."""
    return F.coalesce(F.sum(col), F.lit(0))


def mean_sd_text(mean: Column, sd: Column) -> Column:
    """``12.34 (5.67)``; a part that is unknown reads ``nan``."""

    def text(value: Column) -> Column:
        return F.when(value.isNotNull(), F.format_string("%.2f", value)).otherwise(F.lit("nan"))

    return F.concat(text(mean), F.lit(" ("), text(sd), F.lit(")"))
