"""Multi-year study periods and their labels (``1998-2002``)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Periods = Sequence[tuple[int, int]]

# The five study periods, both years included.
STUDY_PERIODS: Periods = ((1998, 2002), (2003, 2007), (2008, 2012), (2013, 2017), (2018, 2022))


def period_labels(periods: Periods = STUDY_PERIODS) -> list[str]:
    return [f"{first}-{last}" for first, last in periods]


def period_of_year(year: Column, periods: Periods = STUDY_PERIODS, keep_other: bool = False) -> Column:
    """Label of the period holding ``year``; years outside give null, or the year as text."""
    outside = year.cast("string") if keep_other else F.lit(None).cast("string")
    result = outside
    for (first, last), label in zip(periods, period_labels(periods)):
        result = F.when(year.between(first, last), F.lit(label)).otherwise(result)
    return result


def period_of_date(date: Column, periods: Periods = STUDY_PERIODS) -> Column:
    return period_of_year(F.year(date), periods)


def within_periods(date: Column, periods: Periods = STUDY_PERIODS) -> Column:
    """Date bounds rather than a test on ``year(date)``, so that file statistics can skip data."""
    first = min(p[0] for p in periods)
    last = max(p[1] for p in periods)
    return date.between(F.lit(f"{first}-01-01").cast("date"), F.lit(f"{last}-12-31").cast("date"))


def normal_label(label: Column) -> Column:
    """``1998_2002`` and `` 1998-2002 `` both become ``1998-2002``."""
    return F.trim(F.replace(label, F.lit("_"), F.lit("-")))


def period_days(label: Column) -> Column:
    """Calendar days of a ``YYYY-YYYY`` label, both years whole."""
    years = F.split(label, "-")
    first = F.make_date(years[0].cast("int"), F.lit(1), F.lit(1))
    last = F.make_date(years[1].cast("int"), F.lit(12), F.lit(31))
    return F.datediff(last, first) + F.lit(1)
