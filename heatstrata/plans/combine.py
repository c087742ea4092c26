"""Cleaned yearly files to one table per period."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heatstrata.functions.dates import chosen_layout, dates_by_group, layout_votes
from heatstrata.functions.numbers import number_or_null
from heatstrata.functions.periods import STUDY_PERIODS, Periods, period_of_year
from heatstrata.operators.columns import find_year_or_date
from heatstrata.sources import readers, schemas, writers

#: Cleaned files with the date as it is written; its layout is found per file.
CLEAN_AS_TEXT = T.StructType([f for f in schemas.DEATHS_CLEAN.fields if f.name != "date_of_occurrence"])


def combine_and_split(
    spark: SparkSession,
    paths: Sequence[str],
    folder: str,
    known: T.StructType = CLEAN_AS_TEXT,
    periods: Periods = STUDY_PERIODS,
    rule: str = "most",
    skipped: list[str] | None = None,
) -> DataFrame:
    """Read yearly files of any column order, and write them below ``folder``, split by period.

    Stored: ``combined`` (all rows, the file of each, its misfits), ``layouts`` (the date layout of each
    file, with its votes), ``misfits`` (values per file that do not fit their type) and ``periods`` (the
    rows of each period, in one folder each, sorted by day). Returned is the last. The year comes from a
    year column if there is one, else from the date column. Rows without a year, or outside all periods,
    are in ``combined`` only. No year or date column, or dates of which none can be read, is an error.
    """
    base = folder.rstrip("/")
    raw = readers.read_years(spark, paths, known, tag="_file", skipped=skipped, misfits="_misfits")
    writers.write_table(raw, f"{base}/combined")
    combined = spark.read.parquet(f"{base}/combined")
    writers.write_table(readers.misfits_by_file(combined, "_file", "_misfits"), f"{base}/misfits")
    kind, name = find_year_or_date(combined)
    if kind == "date":
        writers.write_table(layout_votes(combined, name, "_file"), f"{base}/votes")
        votes = spark.read.parquet(f"{base}/votes")
        layouts = chosen_layout(votes, "_file", rule)
        writers.write_table(layouts.join(votes, "_file"), f"{base}/layouts")
        known_layouts = spark.read.parquet(f"{base}/layouts")
        if not known_layouts.where("layout IS NOT NULL").limit(1).count():
            raise ValueError(f"no date of column {name} can be read")
        dated = dates_by_group(combined, name, "_file", known_layouts)
        year, day = F.year(name), [name]
    else:
        dated, year, day = combined, number_or_null(F.col(f"`{name}`").cast("string")).cast("int"), []
    split = dated.withColumn("year_period", period_of_year(year, periods)).where("year_period IS NOT NULL").drop("_file", "_misfits")
    places = [c for c in ("ENT_OCURR", "MUN_OCURR") if c in split.columns]
    writers.write_by_period(split, f"{base}/periods", sort=[*day, *places] or [name])
    return spark.read.schema(split.schema).parquet(f"{base}/periods")
