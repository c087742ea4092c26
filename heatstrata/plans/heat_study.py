"""From raw death records and daily weather to attributable deaths.

Each stage writes a table and the next one reads it. A lost executor repeats one stage at most,
tables that several stages need are computed once, and every table is also a result.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from heatstrata.functions.periods import STUDY_PERIODS, Periods, period_of_date, within_periods
from heatstrata.operators import attribution, crossover, exposure, mortality, reports
from heatstrata.operators.codebook import SUBGROUPS
from heatstrata.operators.columns import require_columns
from heatstrata.operators.crossover import (
    EXPOSURES_95_90, EXPOSURES_99, EXPOSURES_BY_STATE, EXPOSURES_BY_SUBGROUP, lag_1_day, same_day,
)
from heatstrata.sources import bucketed, readers, schemas, writers

KEYS = ("ENT_OCURR", "municipality", "date", "year_period")
FAMILIES = {"All": "All", **SUBGROUPS}
#: Every exposure of a model, the day itself and the day before.
BATTERY = same_day(EXPOSURES_99 + EXPOSURES_95_90) + lag_1_day(EXPOSURES_99 + EXPOSURES_95_90)


@dataclass(frozen=True)
class HeatStudy:
    """Where the tables of a study lie and which years it covers."""

    spark: SparkSession
    folder: str
    periods: Periods = STUDY_PERIODS
    #: Lags start anew in each period; else they run over the whole series.
    lags_by_period: bool = True
    #: Buckets of the tables by municipality; by default as many as the session's shuffle partitions.
    buckets: int | None = None

    def path(self, name: str) -> str:
        return f"{self.folder.rstrip('/')}/{name}"

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    def store(self, df: DataFrame, name: str, by_period: bool = False) -> DataFrame:
        writers.write_table(df, self.path(name), ["year_period"] if by_period else [])
        return self.read(name)

    def store_by_unit(self, df: DataFrame, name: str) -> DataFrame:
        """Stored in buckets of the municipality and folders of the period, by day."""
        n = self.buckets or bucketed.default_buckets(self.spark)
        return bucketed.write_bucketed(df, self.path(name), "municipality", n, ["date"], ["year_period"])

    def by_unit(self, name: str) -> DataFrame:
        return bucketed.open_bucketed(self.spark, self.path(name))

    def years(self) -> tuple[int, int]:
        return min(p[0] for p in self.periods), max(p[1] for p in self.periods)

    def deaths(self, paths: Sequence[str]) -> DataFrame:
        """Yearly raw files in folders ``year=YYYY`` to municipality-days.

        ``deaths_misfits`` lists, where there are any, the values of each file that do not fit their type
        and count as unknown.
        """
        raw = readers.read_years(self.spark, paths, schemas.DEATHS_RAW, tag="source_path", misfits="misfits")
        by_file, seen = readers.misfits_by_file(raw, "source_path", "misfits"), Observation()
        raw = raw.observe(seen, F.coalesce(F.sum("misfits"), F.lit(0)).alias("n"))
        raw = raw.withColumn("SOURCE_YEAR", readers.year_in_path("source_path"))
        daily = mortality.with_municipality(mortality.daily_sums(mortality.clean_deaths(raw, "SOURCE_YEAR")))
        daily = daily.withColumn("year_period", period_of_date(F.col("date"), self.periods))
        stored = self.store_by_unit(daily, "deaths_daily")
        # Counted in the scan that is made anyway; the files are named only where there are any.
        self.store(by_file if seen.get["n"] else by_file.limit(0), "deaths_misfits")
        return stored

    def heat(self, weather: DataFrame) -> DataFrame:
        """Daily weather to thresholds, flags, lags and runs. One shuffle by municipality, as the table is stored.

        Every exposure of a model has a lag of one row, by the rule ``lags_by_period``.
        """
        dealt = exposure.prepare_weather(weather, self.years()).repartition(self.buckets or bucketed.default_buckets(self.spark), "municipality")
        days = exposure.with_all_indicators(dealt)
        days = days.withColumn("year_period", period_of_date(F.col("date"), self.periods))
        lags = {f"{c}_lag1": (c, 1) for c in (*EXPOSURES_99, *EXPOSURES_95_90)}
        within = ["year_period"] if self.lags_by_period else []
        days = exposure.add_lags(days.drop(*lags), lags, within=within)
        return self.store_by_unit(days, "heat_indicators")

    # Entering the study in the middle: tables that earlier runs or other programs have exported as CSV.

    def enter_heat(self, paths: Sequence[str] | str) -> DataFrame:
        """An exported indicator table in place of ``heat``. Lags of the models are made anew, by this study's rule."""
        days = readers.read_csv(self.spark, paths, schemas.HEAT_INDICATORS)
        require_columns(days, ("municipality", "date", *EXPOSURES_99, *EXPOSURES_95_90), "indicators")
        days = days.where(within_periods(F.col("date"), self.periods)).withColumn("year_period", period_of_date(F.col("date"), self.periods))
        dealt = days.repartition(self.buckets or bucketed.default_buckets(self.spark), "municipality")
        lags = {f"{c}_lag1": (c, 1) for c in (*EXPOSURES_99, *EXPOSURES_95_90)}
        lagged = exposure.add_lags(dealt.drop(*lags), lags, within=["year_period"] if self.lags_by_period else [])
        return self.store_by_unit(lagged, "heat_indicators")

    def enter_deaths(self, paths: Sequence[str] | str) -> DataFrame:
        """Exported day sums in place of ``deaths``; several rows of a day and place are added up."""
        sums = readers.read_csv(self.spark, paths, schemas.DEATHS_DAILY)
        require_columns(sums, (*mortality.DAY_KEYS, *SUBGROUPS), "day sums")
        daily = mortality.with_municipality(mortality.daily_sums(sums.select(*mortality.DAY_KEYS, *SUBGROUPS)))
        return self.store_by_unit(daily.withColumn("year_period", period_of_date(F.col("date"), self.periods)), "deaths_daily")

    def enter_odds(self, paths: Sequence[str] | str) -> DataFrame:
        """Exported odds ratios in place of the state models; published names become this library's, ``All`` the overall level."""
        odds = readers.read_csv(self.spark, paths, schemas.ODDS_RATIOS)
        odds = odds.withColumnsRenamed({theirs: ours for ours, theirs in crossover.PUBLISHED_NAMES.items()})
        require_columns(odds, ("ENT_OCURR", "year_period", "variable", "type", "or", "or_low", "or_high"), "odds ratios")
        level = F.when(F.col("ENT_OCURR") == "All", F.lit("overall")).otherwise(F.lit("state"))
        return self.store(odds.withColumn("level", level), "odds_by_state")

    def strata(self) -> DataFrame:
        """Every death-day with the reference counts of all exposures and the deaths of all subgroups. No shuffle.

        Both tables lie in buckets of the municipality, which serve the window, the join and this table.
        A unit with two rows for one day, of weather or of deaths, is an error.
        """
        days = self.by_unit("heat_indicators").drop("year_period")
        daily = crossover.one_row_a_day(self.by_unit("deaths_daily"))
        sexes = [F.col(c) for c in mortality.SEX_COLUMNS]
        weights = {"All": mortality.row_sum(sexes), "all_deaths": F.coalesce(mortality.row_sum(sexes, "row"), F.lit(0))}
        with bucketed.joined_by_bucket(self.spark):
            rows = crossover.strata(daily.select(*KEYS, *SUBGROUPS, *[c.alias(n) for n, c in weights.items()]), days, BATTERY)
            return self.store_by_unit(rows, "strata")

    def odds_ratios(self) -> dict[str, DataFrame]:
        """The exposure battery, the state models and the subgroup models: each one job that reads the stored strata."""
        rows, period = self.by_unit("strata"), ["year_period"]
        tables = {
            "odds_battery": crossover.models(rows, BATTERY, by=period),
            "odds_by_state": crossover.models_by_place(rows, same_day(EXPOSURES_BY_STATE) + lag_1_day(EXPOSURES_BY_STATE), by=period),
            "odds_by_subgroup": crossover.models_by_subgroup(rows, same_day(EXPOSURES_BY_SUBGROUP), FAMILIES, by=period),
        }
        return {name: self.store(df, name) for name, df in tables.items()}

    def attributable(self, variables: Sequence[str] = EXPOSURES_BY_STATE) -> dict[str, DataFrame]:
        """Hot days, deaths and attributable deaths per municipality, state and period."""
        days = self.read("heat_indicators")
        flags = [c for c in days.columns if c.startswith("hw_")]
        hot = self.store(exposure.heat_days(days, ["year_period", "municipality"], flags), "heat_period")
        keys = ["ENT_OCURR", "MUN_OCURR", "municipality", "year_period"]
        deaths = self.store(mortality.period_totals(self.read("deaths_daily"), keys), "deaths_period")
        odds = self.read("odds_by_state")
        by_place = attribution.attributable_by_municipality(hot, odds, deaths, variables[0])
        by_state = attribution.attributable_by_state(hot, odds, deaths, variables)
        return {
            "heat_period": hot,
            "deaths_period": deaths,
            "attributable_municipality": self.store(by_place, "attributable_municipality"),
            "attributable_state": self.store(by_state, "attributable_state"),
        }

    def report(self) -> dict[str, DataFrame]:
        """Event temperatures, thresholds, subgroup counts by period and labelled odds ratios."""
        days = self.read("heat_indicators")
        wide = exposure.heat_days(self.read("deaths_daily"), ["year_period"], list(SUBGROUPS))
        long = mortality.unpivot_subgroups(wide, ["year_period"])
        thresholds = [c for c in days.columns if c.startswith("hwthr_")]
        labelled = reports.labelled_odds_ratios(self.read("odds_by_subgroup"), EXPOSURES_BY_SUBGROUP[0])
        tables = {
            "threshold_events": exposure.threshold_events(days),
            "thresholds": exposure.one_row_per_unit(days, thresholds),
            "heat_descriptives": reports.heat_descriptives(days),
            "descriptive": reports.descriptive_table(long, self.periods),
            "odds_labelled": labelled,
        }
        return {name: self.store(df, name) for name, df in tables.items()}

    def run(self, death_paths: Sequence[str], weather: DataFrame) -> dict[str, DataFrame]:
        found = {"deaths_daily": self.deaths(death_paths), "heat_indicators": self.heat(weather)}
        self.strata()
        return {**found, **self.odds_ratios(), **self.attributable(), **self.report()}
