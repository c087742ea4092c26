"""Dates from messy inputs. Unparseable values become null and stay in the data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The accepted date layouts, in order of preference.
DATE_LAYOUTS = ("yyyy-MM-dd", "dd/MM/yyyy", "MM/dd/yyyy", "yyyy/MM/dd")


def date_from_parts(year: Column, month: Column, day: Column) -> Column:
    """Date of a year, month and day; null for an impossible day such as 30 February."""
    zero = F.lit(0)
    return F.try_make_timestamp(
        year.cast("int"), month.cast("int"), day.cast("int"), zero, zero, zero.cast("decimal(16,6)")
    ).cast("date")


def date_from_text(col: Column) -> Column:
    """Date in the first ten characters, so ``2001-05-01 00:00:00`` works too."""
    return F.try_to_date(F.substring(col.cast("string"), 1, 10), "yyyy-MM-dd")


def date_from_layouts(col: Column, layouts=DATE_LAYOUTS) -> Column:
    """First layout that fits, decided row by row."""
    return F.coalesce(*[F.try_to_date(col, layout) for layout in layouts])


def column_layout(df: DataFrame, name: str, layouts=DATE_LAYOUTS) -> str | None:
    """First layout that fits at least one value of the column: one aggregate over the table.

    An error if none fits any of its values; null for a column without values.

    Use with ``F.try_to_date(col, layout)`` when a whole column shares one layout, so that
    ``03/04/2001`` is not read in one layout on one row and in another on the next.
    """
    fits = [
        F.max(F.try_to_date(F.col(name), layout).isNotNull()).alias(f"l{i}")
        for i, layout in enumerate(layouts)
    ]
    row = df.agg(*fits, F.count(F.col(name)).alias("n")).first()
    fitting = [layout for layout, ok in zip(layouts, row) if ok]
    if not fitting and row["n"]:
        raise ValueError(f"no date layout fits column {name}")
    return fitting[0] if fitting else None


def layout_votes(df: DataFrame, name: str, group: str, layouts=DATE_LAYOUTS) -> DataFrame:
    """For each group of rows (a file): how many values of the column each layout fits. Mergeable counters.

    Columns ``n`` (values) and ``fits`` (a count per layout). Each distinct value of a group is tried once: most
    layouts do not fit it, and a misfit costs much more than a fit.
    """
    values = df.groupBy(F.col(group).alias("group"), F.col(name).alias("value")).agg(F.count(F.col(name)).alias("n"))
    fits = [F.coalesce(F.sum(F.when(F.try_to_date("value", layout).isNotNull(), F.col("n"))), F.lit(0)) for layout in layouts]
    return values.groupBy(F.col("group").alias(group)).agg(F.sum("n").alias("n"), F.array(*fits).alias("fits"))


def chosen_layout(votes: DataFrame, group: str, rule: str = "most", layouts=DATE_LAYOUTS) -> DataFrame:
    """(group, layout): the layout that fits ``most`` values, ties by order of preference, or the ``first`` that fits any.

    Null where none fits. ``03/04/2001`` fits two layouts; its file's other values decide which it is.
    """
    if rule not in ("most", "first"):
        raise ValueError(f"rule must be 'most' or 'first', not {rule!r}")
    counts = F.col("fits") if rule == "most" else F.transform("fits", lambda n: F.least(n, F.lit(1).cast("long")))
    best = F.array_max(counts)
    named = F.get(F.array(*[F.lit(x) for x in layouts]), (F.array_position(counts, best) - 1).cast("int"))
    return votes.select(group, F.when(best > 0, named).alias("layout"))


def dates_by_group(df: DataFrame, name: str, group: str, layouts: DataFrame) -> DataFrame:
    """The column as a date, read in the layout that its group has; null where that does not fit.

    A generator keeps later filters and columns from reading each text again at every place they name the date.
    """
    joined = df.join(layouts.select(group, F.col("layout").alias("_layout")), group, "left")
    date = F.coalesce(*[F.when(F.col("_layout") == x, F.try_to_date(F.col(name), x)) for x in DATE_LAYOUTS])
    return joined.withColumn("_date", F.explode(F.array(date))).withColumn(name, F.col("_date")).drop("_layout", "_date")


def iso_weekday(date: Column) -> Column:
    """Monday is 1, Sunday is 7."""
    return F.weekday(date) + F.lit(1)


def sunday_weekday(date: Column) -> Column:
    """Sunday is 1, Saturday is 7."""
    return F.dayofweek(date)


def week_from_january(date: Column) -> Column:
    """Week of the year counted in blocks of seven days from 1 January."""
    return (F.floor((F.dayofyear(date) - 1) / 7) + 1).cast("int")


def calendar_parts(date: Column) -> dict[str, Column]:
    return {
        "year": F.year(date),
        "month": F.month(date),
        "wday": iso_weekday(date),
        "week": week_from_january(date),
        "day": F.date_format(date, "dd"),
    }
