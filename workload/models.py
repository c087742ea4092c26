"""Matched odds ratios on the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heatstrata.functions.periods import period_of_date
from heatstrata.plans.refresh import PatternBatches
from heatstrata.sources import bucketed
from heatstrata.sources.work_folder import work_folder
from heatstrata.operators import crossover, exposure, mortality
from heatstrata.operators.codebook import SUBGROUPS
from heatstrata.operators.crossover import (
    EXPOSURES_95_90, EXPOSURES_99, EXPOSURES_BY_STATE, EXPOSURES_BY_SUBGROUP, SAME_DAY, Exposure, lag_1_day, same_day,
)
from workload import sql
from workload.tables import (
    FAMILIES, KEYS, PERIODS, YEARS, deaths_by_subgroup, deaths_daily, deaths_total, heat, rounded, table, user_cases, user_weather, weather_raw,
)

BATTERY = EXPOSURES_99 + EXPOSURES_95_90


def with_counts_as_integers(results: DataFrame) -> DataFrame:
    return rounded(
        results.withColumns({c: F.col(c).cast("bigint") for c in ("n_cases", "n_informative")})
    )


def with_lags(df: DataFrame, columns, within=()) -> DataFrame:
    return exposure.add_lags(df, {f"{c}_lag1": (c, 1) for c in columns}, within=within)


def cc_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = heat(spark, sf_dir).select("municipality", "date", "hw_95_max_1", "hw_99_max_1", "hw_abs_35")
    return crossover.expand(deaths_total(spark, sf_dir), days)


def cc_control_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crossover.control_counts(cc_expand(spark, sf_dir))


def cc_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strata in long form: one row per death-day and known exposure."""
    chosen = same_day(EXPOSURES_BY_SUBGROUP)
    rows = crossover.strata(deaths_total(spark, sf_dir), heat(spark, sf_dir), chosen)
    return crossover.long_strata(rows, chosen, ["municipality", "date", "all_deaths"])


def cc_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_counts_as_integers(
        crossover.odds_ratios(deaths_total(spark, sf_dir), heat(spark, sf_dir), same_day(EXPOSURES_BY_SUBGROUP))
    )


def cc_overall_unweighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_counts_as_integers(
        crossover.odds_ratios(
            deaths_total(spark, sf_dir), heat(spark, sf_dir), same_day(EXPOSURES_BY_SUBGROUP), weighted=False
        )
    )


def cc_battery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every exposure, same day and the day before, with lags that start anew in each period."""
    days = with_lags(heat(spark, sf_dir), BATTERY, within=["year_period"]).drop("year_period")
    return with_counts_as_integers(
        crossover.odds_ratios(
            deaths_total(spark, sf_dir), days, same_day(BATTERY) + lag_1_day(BATTERY), by=["year_period"]
        )
    )


def cc_by_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_counts_as_integers(
        crossover.odds_ratios(
            deaths_total(spark, sf_dir),
            heat(spark, sf_dir),
            same_day(EXPOSURES_BY_SUBGROUP),
            by=["year_period"],
        )
    )


def cc_by_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One model per state, period, exposure and lag; lags run over the whole series."""
    return state_battery(spark, sf_dir, with_lags(heat(spark, sf_dir), EXPOSURES_BY_STATE))


def cc_by_state_period_lags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with lags that start anew in each period."""
    days = with_lags(heat(spark, sf_dir), EXPOSURES_BY_STATE, within=["year_period"]).drop("year_period")
    return state_battery(spark, sf_dir, days)


def state_battery(spark: SparkSession, sf_dir: str, days: DataFrame) -> DataFrame:
    return with_counts_as_integers(
        crossover.odds_ratios(
            deaths_total(spark, sf_dir),
            days,
            same_day(EXPOSURES_BY_STATE) + lag_1_day(EXPOSURES_BY_STATE),
            by=["ENT_OCURR", "year_period"],
        )
    )


def state_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overall and per-state models of every period, unrounded."""
    return crossover.odds_ratios_by_place(
        deaths_total(spark, sf_dir), heat(spark, sf_dir), same_day(EXPOSURES_BY_STATE), by=["year_period"]
    )


def cc_all_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_counts_as_integers(state_results(spark, sf_dir))


def subgroup_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everyone and every subgroup, per period and exposure, unrounded."""
    return crossover.odds_ratios_by_subgroup(
        deaths_by_subgroup(spark, sf_dir),
        heat(spark, sf_dir),
        same_day(EXPOSURES_BY_SUBGROUP),
        FAMILIES,
        by=["year_period"],
    )


def cc_by_subgroup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_counts_as_integers(subgroup_results(spark, sf_dir))


def stored_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weather, deaths and strata in buckets of the municipality, on disk; the strata are opened again.

    The panel is dealt once, by its first table. What follows joins, counts and stores by bucket.
    """
    folder, buckets = work_folder(spark), bucketed.default_buckets(spark)
    dealt = with_lags(heat(spark, sf_dir), BATTERY, within=["year_period"]).drop("year_period")
    days = bucketed.write_bucketed(dealt, f"{folder}/heat", "municipality", buckets, ["date"])
    daily = deaths_daily(spark, sf_dir)
    sexes = [F.col(c) for c in mortality.SEX_COLUMNS]
    weights = [mortality.row_sum(sexes).alias("All"), F.coalesce(mortality.row_sum(sexes, "row"), F.lit(0)).alias("all_deaths")]
    deaths = bucketed.write_bucketed(daily.select(*KEYS, *SUBGROUPS, *weights), f"{folder}/deaths", "municipality", buckets, ["date"])
    with bucketed.joined_by_bucket(spark):
        rows = crossover.strata(crossover.one_row_a_day(deaths), days, same_day(BATTERY) + lag_1_day(BATTERY))
        return bucketed.write_bucketed(rows, f"{folder}/strata", "municipality", buckets, ["date"])


def cc_stored_battery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exposure battery from stored strata."""
    rows = stored_strata(spark, sf_dir)
    return with_counts_as_integers(crossover.models(rows, same_day(BATTERY) + lag_1_day(BATTERY), by=["year_period"]))


def cc_stored_subgroups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The subgroup models from stored strata."""
    rows = stored_strata(spark, sf_dir)
    return with_counts_as_integers(crossover.models_by_subgroup(rows, same_day(EXPOSURES_BY_SUBGROUP), FAMILIES, by=["year_period"]))


def cc_by_subgroup_battery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every subgroup under eight exposures, on the day and the day before: one pass over stored strata."""
    rows = stored_strata(spark, sf_dir)
    battery = same_day(EXPOSURES_99) + lag_1_day(EXPOSURES_99)
    return with_counts_as_integers(crossover.models_by_subgroup(rows, battery, SUBGROUPS, by=["year_period"]))


def cc_robust(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sandwich errors next to the model-based ones, per period."""
    return with_counts_as_integers(
        crossover.odds_ratios(
            deaths_total(spark, sf_dir), heat(spark, sf_dir), same_day(EXPOSURES_BY_SUBGROUP), by=["year_period"], robust=True
        )
    )


def cc_refreshed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models from pattern sums that were loaded year by year: first years, a year again, then the rest."""
    chosen = same_day(EXPOSURES_BY_SUBGROUP)
    rows = crossover.strata(deaths_total(spark, sf_dir), heat(spark, sf_dir), chosen)
    store = PatternBatches(spark, work_folder(spark), tuple(chosen), PERIODS)
    for first, last in ((1995, 1997), (1997, 1997), (1998, 2001)):
        store.add(rows.where((F.col("date") >= F.lit(f"{first}-01-01").cast("date")) & (F.col("date") <= F.lit(f"{last}-12-31").cast("date"))))
    return with_counts_as_integers(store.fit())


def cc_user_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same model with users as units: purchases on days of an unusually high value."""
    days = exposure.add_thresholds(user_weather(spark, sf_dir), quantiles=(90,))
    days = exposure.add_relative_flags(days, quantiles=(90,))
    return with_counts_as_integers(
        crossover.odds_ratios(user_cases(spark, sf_dir), days, same_day(["hw_90_max_1", "hw_90_min_1"]))
    )


def region_day_odds_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders per region-day against days above the region's 90th percentile, one model."""
    days = exposure.prepare_weather(weather_raw(spark, sf_dir, unit="state"), YEARS)
    days = exposure.add_relative_flags(exposure.add_thresholds(days, quantiles=(90,)), quantiles=(90,))
    region = table(spark, sf_dir, "customer").join(
        table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")
    ).select("c_custkey", F.format_string("R%02d", "n_regionkey").alias("municipality"))
    cases = (
        table(spark, sf_dir, "orders")
        .join(region, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy("municipality", F.col("o_orderdate").cast("date").alias("date"))
        .agg(F.count("*").alias("all_deaths"))
    )
    return with_counts_as_integers(
        crossover.odds_ratios(cases, days, [Exposure("hw_90_max_1", SAME_DAY)])
    )


QUERIES = {
    "cc_expand": cc_expand,
    "cc_control_counts": cc_control_counts,
    "cc_strata": cc_strata,
    "cc_overall": cc_overall,
    "cc_overall_unweighted": cc_overall_unweighted,
    "cc_battery": cc_battery,
    "cc_by_period": cc_by_period,
    "cc_by_state": cc_by_state,
    "cc_by_state_period_lags": cc_by_state_period_lags,
    "cc_all_levels": cc_all_levels,
    "cc_by_subgroup": cc_by_subgroup,
    "cc_user_panel": cc_user_panel,
    "cc_region_days": region_day_odds_ratio,
    "cc_stored_battery": cc_stored_battery,
    "cc_stored_subgroups": cc_stored_subgroups,
    "cc_by_subgroup_battery": cc_by_subgroup_battery,
    "cc_robust": cc_robust,
    "cc_refreshed": cc_refreshed,
}

SAME = [(c, SAME_DAY) for c in EXPOSURES_BY_SUBGROUP]
STATE = [(c, SAME_DAY) for c in EXPOSURES_BY_STATE]

MATCHED = f"""WITH {sql.HEAT},
{sql.TOTAL},
expanded AS (
 SELECT d.*, d.date AS case_date, CAST(year(d.date) AS INTEGER) AS year, CAST(month(d.date) AS INTEGER) AS month,
  CAST(isodow(d.date) AS INTEGER) AS wday, h.date AS ref_date, h.hw_95_max_1, h.hw_99_max_1, h.hw_abs_35,
  CASE WHEN h.date = d.date THEN 1 WHEN h.date IS NOT NULL THEN 0 END AS "case"
 FROM total d LEFT JOIN heat h ON h.municipality = d.municipality AND year(h.date) = year(d.date)
  AND month(h.date) = month(d.date) AND isodow(h.date) = isodow(d.date))
"""


def _lagged(columns, partition: str) -> str:
    lags = ", ".join(f"lag({c}, 1) OVER p AS {c}_lag1" for c in columns)
    drop = ", ".join(f"{c}_lag1" for c in columns if c.startswith("hw_abs"))
    star = f"* EXCLUDE ({drop})" if drop else "*"
    return f"with_lags AS (SELECT {star}, {lags} FROM heat WINDOW p AS (PARTITION BY {partition} ORDER BY date))"


def model_sql(exposures, keys, weights="SELECT *, all_deaths AS w FROM total", weather="heat", extra="", final=None) -> str:
    """Expanded matching on the death-days of ``total`` and one model per ``keys``."""
    keys = list(keys) + ["variable", "type"]
    shown = ", ".join(final or keys)
    return f"""WITH RECURSIVE {sql.HEAT},
{sql.TOTAL},
{extra}
weights AS ({weights}),
{sql.stratum_ctes(exposures, "total", weather)},
{sql.model_ctes("weights", keys)}
SELECT {shown}, {sql.RESULT_VALUES} FROM results"""


LEVELS = """SELECT *, all_deaths AS w, 'state' AS level, ENT_OCURR AS place FROM total
 UNION ALL SELECT *, all_deaths AS w, 'overall' AS level, -1 AS place FROM total"""
LEVEL_KEYS = ["level", "place", "year_period"]
LEVEL_SHOWN = ["level", "nullif(place, -1) AS ENT_OCURR", "year_period", "variable", "type"]

SUBGROUP_WEIGHTS = f"""SELECT municipality, date, year_period,
 unnest([{", ".join(f"'{f}'" for f in ["All", *sql.FAMILY_OF.values()])}]) AS subgroup_type,
 unnest([{", ".join(f"'{s}'" for s in ["All", *sql.FAMILY_OF])}]) AS subgroup,
 unnest([Group_A_SEXO + Group_B_SEXO + Group_C_SEXO, {", ".join(sql.FAMILY_OF)}]) AS w
 FROM daily"""
SUBGROUP_KEYS = ["year_period", "subgroup_type", "subgroup"]


def subgroup_model_sql(select: str) -> str:
    """Models of all subgroups as the table ``results``, then ``select``."""
    return f"""WITH RECURSIVE {sql.HEAT},
{sql.DAILY},
weights AS ({SUBGROUP_WEIGHTS}),
{sql.stratum_ctes(SAME, "daily")},
{sql.model_ctes("weights", SUBGROUP_KEYS + ["variable", "type"])}
{select}"""


def robust_sql() -> str:
    """The sandwich from every single stratum, not from patterns."""
    p = "n.b AS b, s.n1 * exp(n.b) / (s.n0 + s.n1 * exp(n.b)) AS p"
    return f"""WITH RECURSIVE {sql.HEAT},
{sql.TOTAL},
weights AS (SELECT *, all_deaths AS w FROM total),
{sql.stratum_ctes(SAME, "total")},
{sql.model_ctes("weights", ["year_period", "variable", "type"])},
residuals AS (
 SELECT d.year_period, s.variable, s.type, s.xc, d.w, {p}
 FROM strata s JOIN weights d ON s.municipality = d.municipality AND s.date = d.date
 JOIN newton n ON n.year_period = d.year_period AND n.variable = s.variable AND n.type = s.type AND n.step = 60
 WHERE s.xc IS NOT NULL AND s.n1 > 0 AND s.n0 > 0),
sandwich AS (
 SELECT year_period, variable, type, sqrt(sum(pow(w * (xc - p), 2))) / sum(w * p * (1 - p)) AS robust_se
 FROM residuals GROUP BY ALL)
SELECT r.year_period, r.variable, r.type, round(robust_se, 6) AS robust_se, {sql.RESULT_VALUES}
FROM results r LEFT JOIN sandwich USING (year_period, variable, type)"""


def state_model_sql(select: str) -> str:
    """Models of all states and overall as the table ``results``, then ``select``."""
    return f"""WITH RECURSIVE {sql.HEAT},
{sql.TOTAL},
weights AS ({LEVELS}),
{sql.stratum_ctes(STATE, "total")},
{sql.model_ctes("weights", LEVEL_KEYS + ["variable", "type"])}
{select}"""


USER_SQL = f"""WITH RECURSIVE days AS (
 SELECT user_id AS municipality, CAST(ts AS DATE) AS date, max(value) AS tmax_max, min(value) AS tmin_max
 FROM events GROUP BY user_id, CAST(ts AS DATE)),
{sql.heat_from("days")},
weights AS (
 SELECT user_id AS municipality, CAST(ts AS DATE) AS date, count(*) AS w FROM events
 WHERE event_type = 'purchase' GROUP BY user_id, CAST(ts AS DATE)),
{sql.stratum_ctes([("hw_90_max_1", SAME_DAY), ("hw_90_min_1", SAME_DAY)], "weights")},
{sql.model_ctes("weights", ["variable", "type"])}
SELECT variable, type, {sql.RESULT_VALUES} FROM results"""

REGION_SQL = f"""WITH RECURSIVE days AS (
 SELECT n_regionkey AS municipality, CAST(l_shipdate AS DATE) AS date,
  max(l_extendedprice) AS tmax_max, min(l_extendedprice) AS tmin_max
 FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
 GROUP BY n_regionkey, CAST(l_shipdate AS DATE)),
{sql.heat_from("days")},
weights AS (
 SELECT n_regionkey AS municipality, CAST(o_orderdate AS DATE) AS date, count(*) AS w
 FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
 GROUP BY n_regionkey, CAST(o_orderdate AS DATE)),
{sql.stratum_ctes([("hw_90_max_1", SAME_DAY)], "weights")},
{sql.model_ctes("weights", ["variable", "type"])}
SELECT variable, type, {sql.RESULT_VALUES} FROM results"""

ORACLES = {
    "cc_expand": MATCHED
    + """SELECT municipality, year, month, wday, ENT_OCURR, case_date, year_period, all_deaths, ref_date AS date,
 hw_95_max_1, hw_99_max_1, hw_abs_35, "case" FROM expanded""",
    "cc_control_counts": MATCHED
    + """SELECT municipality, case_date, count("case") AS n_days, CAST(coalesce(sum("case"), 0) AS BIGINT) AS n_cases,
 CAST(sum(CASE WHEN "case" = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_controls FROM expanded GROUP BY municipality, case_date""",
    "cc_strata": f"""WITH {sql.HEAT},
{sql.TOTAL},
{sql.stratum_ctes(SAME, "total")}
SELECT s.municipality, s.date, variable, type, xc, n1, n0, all_deaths
FROM strata s JOIN total t ON s.municipality = t.municipality AND s.date = t.date WHERE xc IS NOT NULL""",
    "cc_overall": model_sql(SAME, []),
    "cc_overall_unweighted": model_sql(SAME, [], "SELECT *, 1 AS w FROM total"),
    "cc_battery": model_sql(
        [(c, SAME_DAY) for c in BATTERY] + [(f"{c}_lag1", crossover.LAG_1_DAY) for c in BATTERY],
        ["year_period"],
        weather="with_lags",
        extra=_lagged(BATTERY, "municipality, year_period") + ",",
    ),
    "cc_by_period": model_sql(SAME, ["year_period"]),
    "cc_by_state": model_sql(
        STATE + [(f"{c}_lag1", crossover.LAG_1_DAY) for c in EXPOSURES_BY_STATE],
        ["ENT_OCURR", "year_period"],
        weather="with_lags",
        extra=_lagged(EXPOSURES_BY_STATE, "municipality") + ",",
    ),
    "cc_by_state_period_lags": model_sql(
        STATE + [(f"{c}_lag1", crossover.LAG_1_DAY) for c in EXPOSURES_BY_STATE],
        ["ENT_OCURR", "year_period"],
        weather="with_lags",
        extra=_lagged(EXPOSURES_BY_STATE, "municipality, year_period") + ",",
    ),
    "cc_all_levels": state_model_sql(f"SELECT {', '.join(LEVEL_SHOWN)}, {sql.RESULT_VALUES} FROM results"),
    "cc_by_subgroup": subgroup_model_sql(
        f"SELECT {', '.join(SUBGROUP_KEYS)}, variable, type, {sql.RESULT_VALUES} FROM results"
    ),
    "cc_robust": robust_sql(),
    "cc_refreshed": robust_sql(),
    "cc_user_panel": USER_SQL,
    "cc_region_days": REGION_SQL,
}
ORACLES["cc_stored_battery"] = ORACLES["cc_battery"]
ORACLES["cc_stored_subgroups"] = ORACLES["cc_by_subgroup"]
_LEGACY = [(c, SAME_DAY) for c in EXPOSURES_99] + [(f"{c}_lag1", crossover.LAG_1_DAY) for c in EXPOSURES_99]
ORACLES["cc_by_subgroup_battery"] = f"""WITH RECURSIVE {sql.HEAT},
{_lagged(EXPOSURES_99, "municipality, year_period")},
{sql.DAILY},
weights AS (SELECT * FROM ({SUBGROUP_WEIGHTS}) WHERE subgroup <> 'All'),
{sql.stratum_ctes(_LEGACY, "daily", "with_lags")},
{sql.model_ctes("weights", SUBGROUP_KEYS + ["variable", "type"])}
SELECT {', '.join(SUBGROUP_KEYS)}, variable, type, {sql.RESULT_VALUES} FROM results"""
