"""Deaths: clean the records, sum them to municipality-days, split them by subgroup."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heatstrata.functions.dates import date_from_parts
from heatstrata.functions.indicators import differs_or_null
from heatstrata.functions.numbers import row_sum, sum_or_zero
from heatstrata.functions.places import municipality_id
from heatstrata.operators.codebook import CODE_BOOK, RAW_FIELDS, SPELLINGS, SUBGROUPS, band_flags, bands, checked_year
from heatstrata.operators.columns import numeric_columns, require_columns, upper_names

# Codes that mean "unknown day" and "unknown place".
UNKNOWN_DAY = 99
UNKNOWN_PLACE = 999

DAY_KEYS = ("date_of_occurrence", "ENT_OCURR", "MUN_OCURR")
SEX_COLUMNS = ("Group_A_SEXO", "Group_B_SEXO", "Group_C_SEXO")


def with_known_day(df: DataFrame, day: str = "DIA_OCURR") -> DataFrame:
    return df.where(differs_or_null(F.col(day), UNKNOWN_DAY))


def with_known_place(df: DataFrame, columns: Iterable[str] = ("ENT_OCURR", "MUN_OCURR")) -> DataFrame:
    for name in columns:
        df = df.where(differs_or_null(F.col(name), UNKNOWN_PLACE))
    return df


def clean_deaths(raw: DataFrame, year: int | str, book=CODE_BOOK) -> DataFrame:
    """Raw death records to date, place and 0/1 indicators: one narrow pass, no shuffle.

    ``year`` is the registration year of the file, or the column that holds it. The output columns
    are listed, not what to drop, so unused raw columns never leak through. A year that is unknown
    (null) or outside the code book is an error, since the codes of another era would be wrong.
    """
    df = upper_names(raw)
    require_columns(
        df, ("ENT_OCURR", "MUN_OCURR", "ANIO_OCUR", "MES_OCURR", "DIA_OCURR", *RAW_FIELDS), "death records"
    )
    date = date_from_parts(F.col("ANIO_OCUR"), F.col("MES_OCURR"), F.col("DIA_OCURR"))
    known = with_known_place(with_known_day(df))
    if isinstance(year, str):
        known = known.withColumn("_year", F.expr(checked_year(f"`{year}`", book)))
        year = "_year"
    banded = known.select(
        date.alias("date_of_occurrence"),
        "ENT_OCURR",
        "MUN_OCURR",
        *[F.expr(f"{text} AS _band_{family}") for family, text in bands(year, book).items()],
    )
    return banded.select(
        "date_of_occurrence",
        "ENT_OCURR",
        "MUN_OCURR",
        *[F.expr(f"{text} AS {name}") for name, text in band_flags(book).items()],
    )


def one_spelling(df: DataFrame) -> DataFrame:
    """Bring civil-status columns of differently cleaned files under one name.

    All spellings that are there are added up by row, leaving out nulls, so a union of files with
    different spellings keeps each file's values.
    """
    joint = "CIVIL_DIVORCED_SEPARATED"
    others = [c for c in (*(old for old, new in SPELLINGS.items() if new == joint), "CIVIL_SEPARATED", "CIVIL_DIVORCED") if c in df.columns]
    df = df.withColumnsRenamed({old: new for old, new in SPELLINGS.items() if new != joint and old in df.columns})
    if others:
        there = [joint] if joint in df.columns else []
        df = df.withColumn(joint, row_sum([F.col(c) for c in there + others])).drop(*others)
    return df


def daily_sums(df: DataFrame, keys: Sequence[str] = DAY_KEYS, nulls: str = "keep") -> DataFrame:
    """Sum every numeric column by day and place.

    ``keep``: rows with an unknown key form their own group, and a cell that is unknown throughout
    stays unknown. ``drop``: rows with an unknown key go, and such a cell becomes 0.
    """
    if nulls not in ("keep", "drop"):
        raise ValueError(f"nulls must be 'keep' or 'drop', not {nulls!r}")
    require_columns(df, keys, "death records")
    counted = numeric_columns(df, keys)
    if nulls == "drop":
        df = df.na.drop(subset=list(keys))
    total = "coalesce(sum(`{0}`), 0) AS `{0}`" if nulls == "drop" else "sum(`{0}`) AS `{0}`"
    return df.groupBy(*keys).agg(*[F.expr(total.format(c)) for c in counted])


def with_municipality(df: DataFrame) -> DataFrame:
    """Add the municipality id and a ``date`` column to day sums."""
    return df.withColumns(
        {
            "municipality": municipality_id(F.col("ENT_OCURR"), F.col("MUN_OCURR")),
            "date": F.col("date_of_occurrence").cast("date"),
        }
    )


def daily_total(
    df: DataFrame,
    keys: Sequence[str] = ("ENT_OCURR", "municipality", "date"),
    parts: Sequence[str] = SEX_COLUMNS,
    null_mode: str = "row",
    name: str = "all_deaths",
    positive: bool = True,
) -> DataFrame:
    """All deaths of a municipality-day, from the sex columns; days without deaths are left out."""
    total = sum_or_zero(row_sum([F.col(c) for c in parts], null_mode))
    out = df.groupBy(*keys).agg(total.alias(name))
    return out.where(F.col(name) > 0) if positive else out


def day_total(
    df: DataFrame,
    keys: Sequence[str] = ("ENT_OCURR", "municipality", "date"),
    parts: Sequence[str] = SEX_COLUMNS,
    name: str = "all_deaths",
) -> DataFrame:
    """``daily_total`` of a table with one row per key, such as day sums: a row expression, no shuffle."""
    out = df.select(*keys, F.coalesce(row_sum([F.col(c) for c in parts], "row"), F.lit(0)).alias(name))
    return out.where(F.col(name) > 0)


def daily_subgroups(
    df: DataFrame,
    subgroups: Iterable[str] = tuple(SUBGROUPS),
    keys: Sequence[str] = ("ENT_OCURR", "municipality", "date"),
) -> DataFrame:
    """Deaths of every subgroup side by side: one pass for all of them."""
    return df.groupBy(*keys).agg(*[F.expr(f"coalesce(sum(`{c}`), 0) AS `{c}`") for c in subgroups])


def unpivot_subgroups(
    df: DataFrame, ids: Sequence[str], subgroups: dict[str, str] = SUBGROUPS, value: str = "deaths"
) -> DataFrame:
    """One row per subgroup, with its family."""
    present = [s for s in subgroups if s in df.columns]
    pairs = [F.lit(x) for s in present for x in (s, subgroups[s])]
    return df.unpivot(list(ids), present, "subgroup", value).withColumn(
        "subgroup_type", F.create_map(*pairs)[F.col("subgroup")]
    )


def period_totals(
    df: DataFrame, keys: Sequence[str], parts: Sequence[str] = SEX_COLUMNS, name: str = "deaths_total"
) -> DataFrame:
    """Deaths by place and period; unknown cells count 0 and rows with an unknown key go."""
    total = sum_or_zero(row_sum([F.col(c) for c in parts], "cell"))
    return df.na.drop(subset=list(keys)).groupBy(*keys).agg(total.alias(name))
