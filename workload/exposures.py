"""Thresholds, flags, lags, runs, events and heat-day counts on the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heatstrata.functions.periods import period_of_date, period_of_year
from heatstrata.operators import exposure, reports
from workload import sql
from workload.tables import PERIODS, heat, rounded, user_weather, weather

RELATIVE = [f"hw_{q}_{s}_1" for q in (99, 95, 90) for s in ("max", "min")]
THRESHOLDS = [f"hwthr_{q}_{s}" for q in (99, 95, 90) for s in ("max", "min")]
LAGS = list(exposure.INDICATOR_LAGS)
RUNS = [f"hw_99_{s}_{n}" for n in (2, 3) for s in ("max", "min")]
SUMMED = ["hw_99_max_1", "hw_99_min_1", "hw_abs_30", "hw_abs_35", *LAGS, *RUNS]
DAY = ["municipality", "date"]


def flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = exposure.add_thresholds(weather(spark, sf_dir))
    return exposure.add_absolute_flags(exposure.add_relative_flags(df))


def thresholds_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(exposure.add_thresholds(weather(spark, sf_dir)).select(*DAY, *THRESHOLDS), 9)


def thresholds_municipality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per municipality, taken from its events."""
    wanted = ["hwthr_99_max", "hwthr_99_min", "hwthr_95_max", "hwthr_95_min"]
    events = exposure.threshold_events(flagged(spark, sf_dir), exposure.EVENTS_BY_PERCENTILE)
    return rounded(exposure.one_row_per_unit(events, wanted), 9)


def thresholds_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same percentiles from a group-by, without the daily rows."""
    return rounded(exposure.unit_thresholds(weather(spark, sf_dir)), 9)


def heat_flags_relative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flagged(spark, sf_dir).select(*DAY, *RELATIVE)


def heat_flags_absolute(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exposure.add_absolute_flags(weather(spark, sf_dir)).select(*DAY, "hw_abs_30", "hw_abs_35")


def heat_lags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heat(spark, sf_dir).select(*DAY, *LAGS)


def heat_lags_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lags that count only if the earlier row lies exactly k days back."""
    df = exposure.add_lags(flagged(spark, sf_dir), exposure.INDICATOR_LAGS, calendar=True)
    return df.select(*DAY, *LAGS)


def heat_lags_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lags that start anew in each period."""
    df = flagged(spark, sf_dir).withColumn("year_period", period_of_date(F.col("date"), PERIODS))
    df = exposure.add_lags(df, exposure.INDICATOR_LAGS, within=["year_period"])
    return df.select(*DAY, "year_period", *LAGS)


def heat_flags_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heat(spark, sf_dir).select(*DAY, *RUNS)


def heat_indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(exposure.heat_indicators(weather(spark, sf_dir)), 9)


def threshold_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(exposure.threshold_events(heat(spark, sf_dir)), 9)


def threshold_events_95(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(exposure.threshold_events(flagged(spark, sf_dir), exposure.EVENTS_BY_PERCENTILE), 9)


def heat_days_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exposure.heat_days(heat(spark, sf_dir), ["year", "municipality"], SUMMED)


def heat_days_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All hw_ columns by period in one step."""
    return exposure.heat_days(heat(spark, sf_dir), ["year_period", "municipality"], [*SUMMED, *RELATIVE[2:]])


def heat_days_two_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By year first, then by period: equal to one step, since sums compose."""
    yearly = exposure.heat_days(heat(spark, sf_dir), ["year", "municipality"], SUMMED)
    yearly = yearly.withColumn("year_period", period_of_year(F.col("year"), PERIODS))
    return exposure.heat_days(yearly, ["year_period", "municipality"], SUMMED)


def heat_descriptives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(reports.heat_descriptives(heat(spark, sf_dir)))


def heat_user_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags of every user-day against the user's own percentiles, with runs."""
    df = exposure.with_all_indicators(user_weather(spark, sf_dir))
    return df.select(F.col("municipality").alias("user_id"), "date", *RELATIVE, *LAGS, *RUNS)


QUERIES = {
    f.__name__: f
    for f in (
        thresholds_window, thresholds_municipality, thresholds_grouped, heat_flags_relative, heat_flags_absolute,
        heat_lags, heat_lags_calendar, heat_lags_period, heat_flags_runs, heat_indicators, threshold_events,
        threshold_events_95, heat_days_year, heat_days_period, heat_days_two_steps, heat_descriptives, heat_user_panel,
    )
}


def _names(columns) -> str:
    return ", ".join(columns)


def _round(columns, places: int = 9) -> str:
    return ", ".join(f"round({c}, {places}) AS {c}" for c in columns)


def _sums(columns) -> str:
    return ", ".join(f"CAST(coalesce(sum({c}), 0) AS BIGINT) AS {c}" for c in columns)


HEAT = f"WITH {sql.HEAT}\n"
EVENT_TEMPERATURES = ["tmax_max", "tmin_max"]


def _events(definitions, columns) -> str:
    return "\nUNION ALL\n".join(
        f"SELECT '{label}' AS HW_definition, municipality, date AS date2, {columns} FROM heat WHERE {high} = 1 OR {low} = 1"
        for label, (high, low) in definitions.items()
    )


def _calendar(name: str) -> str:
    column, k = exposure.INDICATOR_LAGS[name]
    return f"CASE WHEN date_diff('day', lag(date, {k}) OVER u, date) = {k} THEN lag({column}, {k}) OVER u END AS {name}"


def _by_period(name: str) -> str:
    column, k = exposure.INDICATOR_LAGS[name]
    return f"lag({column}, {k}) OVER u AS {name}"


def _text(side: str) -> str:
    mean, sd = (f"coalesce(printf('%.2f', {side}_{x}), 'nan')" for x in ("mean", "sd"))
    return f"{mean} || ' (' || {sd} || ')' AS {side}_text"


def _measures() -> str:
    return "\nUNION ALL\n".join(
        f"""SELECT '{label}' AS HW_definition,
 avg(tmax_max) FILTER (WHERE {high} = 1) AS max_mean, stddev_samp(tmax_max) FILTER (WHERE {high} = 1) AS max_sd,
 avg(tmin_max) FILTER (WHERE {low} = 1) AS min_mean, stddev_samp(tmin_max) FILTER (WHERE {low} = 1) AS min_sd FROM heat"""
        for label, (high, low) in exposure.EVENTS_BY_LENGTH.items()
    )


ORACLES = {
    "thresholds_window": HEAT + f"SELECT municipality, date, {_round(THRESHOLDS)} FROM heat",
    "thresholds_municipality": HEAT
    + f"""SELECT DISTINCT municipality, {_round(THRESHOLDS[:4])} FROM heat
WHERE hw_99_max_1 = 1 OR hw_99_min_1 = 1 OR hw_95_max_1 = 1 OR hw_95_min_1 = 1""",
    "thresholds_grouped": HEAT + f"SELECT municipality, {_round(THRESHOLDS)} FROM thresholds",
    "heat_flags_relative": HEAT + f"SELECT municipality, date, {_names(RELATIVE)} FROM heat",
    "heat_flags_absolute": HEAT + "SELECT municipality, date, hw_abs_30, hw_abs_35 FROM heat",
    "heat_lags": HEAT + f"SELECT municipality, date, {_names(LAGS)} FROM heat",
    "heat_lags_calendar": HEAT
    + f"SELECT municipality, date, {', '.join(map(_calendar, LAGS))} FROM flagged WINDOW u AS (PARTITION BY municipality ORDER BY date)",
    "heat_lags_period": HEAT
    + f""", periods AS (SELECT *, {sql.PERIOD_OF.format('date')} AS year_period FROM flagged)
SELECT municipality, date, year_period, {', '.join(map(_by_period, LAGS))} FROM periods
WINDOW u AS (PARTITION BY municipality, year_period ORDER BY date)""",
    "heat_flags_runs": HEAT + f"SELECT municipality, date, {_names(RUNS)} FROM heat",
    "heat_indicators": HEAT
    + "SELECT municipality, date, round(tmin_max, 9) AS tmin_max, round(vp, 9) AS vp, round(prcp, 9) AS prcp,"
    + f" round(tmax_max, 9) AS tmax_max, {_names(exposure.INDICATOR_COLUMNS[6:])} FROM heat",
    "threshold_events": HEAT
    + _events(
        exposure.EVENTS_BY_LENGTH,
        _round([*EVENT_TEMPERATURES, *THRESHOLDS[:2]]) + ", " + _names(["hw_99_max_1", "hw_99_min_1", *RUNS]),
    ),
    "threshold_events_95": HEAT
    + _events(
        exposure.EVENTS_BY_PERCENTILE, _round([*EVENT_TEMPERATURES, *THRESHOLDS[:4]]) + ", " + _names(RELATIVE[:4])
    ),
    "heat_days_year": HEAT + f"SELECT year, municipality, {_sums(SUMMED)} FROM heat GROUP BY year, municipality",
    "heat_days_period": HEAT
    + f"SELECT year_period, municipality, {_sums([*SUMMED, *RELATIVE[2:]])} FROM heat GROUP BY year_period, municipality",
    "heat_days_two_steps": HEAT
    + f"SELECT year_period, municipality, {_sums(SUMMED)} FROM heat GROUP BY year_period, municipality",
    "heat_descriptives": HEAT
    + f""", measured AS ({_measures()})
SELECT HW_definition, {_round(["max_mean", "max_sd", "min_mean", "min_sd"], 6)},
 {_text("max")}, {_text("min")} FROM measured""",
    "heat_user_panel": f"""WITH days AS (
 SELECT user_id AS municipality, CAST(ts AS DATE) AS date, max(value) AS tmax_max, min(value) AS tmin_max
 FROM events GROUP BY user_id, CAST(ts AS DATE)),
{sql.heat_from("days")}
SELECT municipality AS user_id, date, {_names([*RELATIVE, *LAGS, *RUNS])} FROM heat""",
}
