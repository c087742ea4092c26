"""Schema operators. All of them work on names and types, so they cost no job."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T


class MissingColumns(ValueError):
    """A table lacks columns that an operator needs."""


def require_columns(df: DataFrame, needed: Iterable[str], what: str = "table") -> DataFrame:
    """Fail before any job runs when a column is absent."""
    missing = sorted(set(needed) - set(df.columns))
    if missing:
        raise MissingColumns(f"{what} lacks columns: {missing}")
    return df


def rename(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(names))


def drop_if_present(df: DataFrame, names: Iterable[str]) -> DataFrame:
    return df.drop(*names)


def upper_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.upper() for c in df.columns])


def tidy_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip().lower() for c in df.columns])


def reorder(df: DataFrame, first: Iterable[str]) -> DataFrame:
    """The wanted columns that exist, in that order, then all others as they were."""
    front = [c for c in first if c in df.columns]
    return df.select(*front, *[c for c in df.columns if c not in front])


def existing(df: DataFrame, wanted: Iterable[str]) -> DataFrame:
    """The wanted columns that exist; a columnar scan then reads only these."""
    return df.select(*[c for c in wanted if c in df.columns])


# Spellings, in any case, under which a year or a date column is accepted.
YEAR_SPELLINGS = ("year", "anio", "ano")
DATE_SPELLINGS = ("date_of_occurrence", "date of occurrence", "date-of-occurrence", "dateofoccurrence")


def find_year_or_date(df: DataFrame) -> tuple[str, str]:
    """("year", name) if a year column exists, else ("date", name); an error if neither does."""
    present = {name.lower(): name for name in reversed(df.columns)}
    accepted = [("year", s) for s in YEAR_SPELLINGS] + [("date", s) for s in DATE_SPELLINGS]
    for kind, spelling in accepted:
        if spelling in present:
            return kind, present[spelling]
    raise MissingColumns("no date or year column")


def drop_repeated_names(df: DataFrame) -> DataFrame:
    """Keep the first of several columns that share one name."""
    places = [f"_c{i}" for i in range(len(df.columns))]
    first_place: dict[str, str] = {}
    for place, name in zip(places, df.columns):
        first_place.setdefault(name, place)
    renamed = df.toDF(*places)
    return renamed.select(*[renamed[place].alias(name) for name, place in first_place.items()])


def numeric_columns(df: DataFrame, keys: Iterable[str] = ()) -> list[str]:
    skip = set(keys)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in skip]


def columns_starting(df: DataFrame, prefix: str) -> list[str]:
    return [c for c in df.columns if c.startswith(prefix)]


def add_if_absent(df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    absent = {name: value for name, value in columns.items() if name not in df.columns}
    return df.withColumns(absent) if absent else df
