"""Checks of tables: overlaps, counts, emptiness, uniqueness."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heatstrata.functions.indicators import blank_or_null


def key_overlap(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Number of key values present in both tables; both sides shrink to their keys first."""
    common = left.select(key).distinct().intersect(right.select(key).distinct())
    return common.agg(F.count("*").alias("n_common"))


def join_profile(joined: DataFrame, unit: str = "municipality", date: str = "date") -> DataFrame:
    return joined.agg(
        F.countDistinct(unit).alias("n_units"),
        F.min(date).alias("first_date"),
        F.max(date).alias("last_date"),
    )


def row_counts(table: DataFrame, distinct: Sequence[str] = ()) -> DataFrame:
    """Rows, columns, and distinct values of the named columns."""
    return table.agg(
        F.count("*").alias("n_rows"),
        F.lit(len(table.columns)).alias("n_columns"),
        *[F.countDistinct(c).alias(f"n_{c}") for c in distinct],
    )


def emptiness(table: DataFrame) -> DataFrame:
    """How many rows are empty in every column, and which columns are empty in every row."""
    blank = {c: blank_or_null(F.col(f"`{c}`")) for c in table.columns}
    every = F.lit(True)
    for b in blank.values():
        every = every & b
    filled = [F.sum((~b).cast("int")).alias(f"c{i}") for i, b in enumerate(blank.values())]
    counted = table.agg(
        F.count("*").alias("n_rows"), F.coalesce(F.sum(every.cast("int")), F.lit(0)).alias("n_empty_rows"), *filled
    )
    names = F.array_compact(
        F.array(
            *[F.when(F.coalesce(F.col(f"c{i}"), F.lit(0)) == 0, F.lit(c)) for i, c in enumerate(blank)]
        )
    )
    return counted.select(
        "n_rows", "n_empty_rows", F.size(names).alias("n_empty_columns"), F.array_join(names, ",").alias("empty_columns")
    )


def repeated_keys(table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once; empty for a table that may be joined as the one side."""
    return table.groupBy(*keys).agg(F.count("*").alias("n_rows")).where(F.col("n_rows") > 1)


def subgroup_counts(table: DataFrame, group: str = "subgroup_type", member: str = "subgroup") -> DataFrame:
    return table.where(F.col(group).isNotNull()).groupBy(group).agg(F.countDistinct(member).alias(f"n_{member}"))
