"""Attributable numbers, labelled results and report tables on the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heatstrata.functions.labels import FAMILY_LABELS, REPORT_SECTIONS, SUBGROUP_LABELS, UNPLOTTED_SUBGROUPS
from heatstrata.functions.periods import period_labels
from heatstrata.operators import attribution, bitmaps, crossover, exposure, mortality, quality, reports
from heatstrata.operators.crossover import EXPOSURES_BY_STATE, EXPOSURES_BY_SUBGROUP, SAME_DAY, same_day
from workload import sql
from workload.deaths import JOINED
from workload.models import state_model_sql, state_results, stored_strata, subgroup_model_sql, subgroup_results
from workload.tables import FAMILIES, PERIODS, deaths_by_subgroup, deaths_daily, heat, rounded

LABELS = period_labels(PERIODS)
VARIABLE = "hw_95_max_1"


def heat_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exposure.heat_days(heat(spark, sf_dir), ["year_period", "municipality"], list(EXPOSURES_BY_STATE))


def period_deaths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mortality.period_totals(deaths_daily(spark, sf_dir), ["municipality", "year_period"])


def by_municipality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attribution.attributable_by_municipality(
        heat_period(spark, sf_dir), state_results(spark, sf_dir), period_deaths(spark, sf_dir), VARIABLE
    )


def an_municipality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(by_municipality(spark, sf_dir))


def an_state_collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(attribution.collapse_to_state(by_municipality(spark, sf_dir)))


def by_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attribution.attributable_by_state(
        heat_period(spark, sf_dir), state_results(spark, sf_dir), period_deaths(spark, sf_dir), EXPOSURES_BY_STATE
    )


def an_state_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every heat definition, by state and period."""
    return rounded(by_state(spark, sf_dir))


def an_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State sums where one state has no odds ratios and some municipalities no count of deaths."""
    odds = state_results(spark, sf_dir).where("level = 'overall' OR ENT_OCURR <> 2")
    deaths = period_deaths(spark, sf_dir).where(~F.col("municipality").endswith("5"))
    return rounded(attribution.attributable_by_state(heat_period(spark, sf_dir), odds, deaths, EXPOSURES_BY_STATE))


def topk_an_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twelve state-periods with the most attributable deaths: a top-k report."""
    ordered = by_state(spark, sf_dir).orderBy(
        F.round("AN_deaths_est", 6).desc(), "ENT_OCURR", "year_period", "hw_definition"
    )
    return rounded(ordered.limit(12))


def results_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = attribution.select_results(state_results(spark, sf_dir), [VARIABLE])
    return rounded(chosen.select("level", "ENT_OCURR", "year_period", "variable", "type", "or", "or_low", "or_high"))


def or_first_per_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One result per state and period, whatever the exposure."""
    first = attribution.first_per_key(attribution.state_level(state_results(spark, sf_dir)))
    return rounded(first.select("ENT_OCURR", "year_period", "variable", "type", "or"))


def distinct_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deaths_daily(spark, sf_dir).select("ENT_OCURR").distinct().orderBy("ENT_OCURR")


def union_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State and subgroup results in one table; columns of only one side are null on the other."""
    wanted = ["year_period", "variable", "type", "estimate", "or"]
    rows = stored_strata(spark, sf_dir)  # both kinds of models read the same strata
    states = crossover.models_by_place(rows, same_day(EXPOSURES_BY_STATE), by=["year_period"]).select("level", "ENT_OCURR", *wanted)
    groups = crossover.models_by_subgroup(rows, same_day(EXPOSURES_BY_SUBGROUP), FAMILIES, by=["year_period"]).select("subgroup_type", "subgroup", *wanted)
    return rounded(states.unionByName(groups, allowMissingColumns=True))


def sort_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = state_results(spark, sf_dir).select("level", "ENT_OCURR", "year_period", "variable", "type", "or")
    return rounded(results).orderBy("type", "variable", "year_period", "level", "ENT_OCURR")


def or_labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(reports.labelled_odds_ratios(subgroup_results(spark, sf_dir), VARIABLE))


def plotted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of one exposure, found in any column, without the subgroups no figure shows."""
    results = reports.rows_mentioning(subgroup_results(spark, sf_dir), VARIABLE)
    results = results.where(~F.col("subgroup").isin(*UNPLOTTED_SUBGROUPS))
    return results.withColumn("subgroup", reports.relabel(F.col("subgroup"), SUBGROUP_LABELS))


def or_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(
        reports.pivot_mean(plotted(spark, sf_dir), ["subgroup_type", "subgroup"], "year_period", "or", LABELS)
    )


def densify_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Men and women in every period of a longer list; periods without results are null."""
    results = reports.labelled_odds_ratios(subgroup_results(spark, sf_dir), VARIABLE)
    sexes = results.where((F.col("subgroup_type") == "Sex") & F.col("subgroup").isin("Male", "Female"))
    return rounded(
        reports.densify_entries(sexes, ["subgroup"], "year_period", [*LABELS, "2002-2004"], ["or", "or_low", "or_high"])
    )


def sort_custom_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subgroups in display order, known ones first. All are summed side by side before they are stacked."""
    wide = deaths_by_subgroup(spark, sf_dir).agg(*[F.sum(c).alias(c) for c in mortality.SUBGROUPS])
    totals = mortality.unpivot_subgroups(wide, []).select("subgroup", "deaths")
    wanted = list(SUBGROUP_LABELS)
    placed = totals.withColumn("place", reports.display_order(F.col("subgroup"), wanted))
    return reports.in_custom_order(placed, "subgroup", wanted)


def long_by_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deaths by family, subgroup and period. The wide sums come first: they shrink the rows to
    one per period before the subgroups are stacked."""
    wide = exposure.heat_days(deaths_by_subgroup(spark, sf_dir), ["year_period"], list(mortality.SUBGROUPS))
    return mortality.unpivot_subgroups(wide, ["year_period"])


def report_descriptive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.descriptive_table(long_by_period(spark, sf_dir), PERIODS)


def section_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = reports.descriptive_table(long_by_period(spark, sf_dir), PERIODS)
    return reports.section_totals(table, [*LABELS, "Total"])


def section_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = reports.descriptive_table(long_by_period(spark, sf_dir), PERIODS).where(F.col("section") != reports.TOTAL_SECTION)
    long = table.unpivot(["section", "Subgroup"], LABELS, "year_period", "deaths")
    return rounded(reports.section_composition(long))


def qa_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.row_counts(
        deaths_by_subgroup(spark, sf_dir), ["municipality", "date", "year_period"]
    )


def qa_distinct_bitmaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct places, days and years of the day sums, by period and in all, from bitmaps that are added up."""
    codes = {"place": F.col("ENT_OCURR") * 1000 + F.col("MUN_OCURR"), "day": F.unix_date("date"), "year": F.year("date")}
    parts = bitmaps.distinct_bitmaps(deaths_daily(spark, sf_dir), codes, ["year_period"])
    each, all_ = bitmaps.distinct_counts(parts, ["year_period"]), bitmaps.distinct_counts(parts)
    return each.unionByName(all_.withColumn("year_period", F.lit("all")))


def join_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deaths with the weather of their day; the weather side is cut to the days of deaths before it is shuffled."""
    days = heat(spark, sf_dir).select("municipality", "date", "tmax_max", "hw_95_max_1", "hw_99_max_1")
    deaths = deaths_daily(spark, sf_dir).drop("date_of_occurrence", "year_period")
    keys = ["municipality", "date"]
    return deaths.join(bitmaps.may_have_key(days, bitmaps.key_filter(deaths, keys), keys), keys, "left")


def report_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The descriptive table in display order, for the sink; ``place`` is the order of its sections."""
    ordered = reports.in_report_order(reports.descriptive_table(long_by_period(spark, sf_dir), PERIODS), PERIODS)
    return ordered.withColumn("place", reports.display_order(F.col("section"), [reports.TOTAL_SECTION, *REPORT_SECTIONS]))


def qa_subgroup_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.subgroup_counts(plotted(spark, sf_dir))


def qa_emptiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Day sums joined with a blank and a null column; both count as empty."""
    table = deaths_daily(spark, sf_dir).withColumns({"note": F.lit("  "), "source": F.lit(None).cast("string")})
    return quality.emptiness(table)


QUERIES = {
    f.__name__: f
    for f in (
        an_municipality, an_state_collapsed, an_state_period, topk_an_state, results_select, or_first_per_state,
        distinct_states, union_results, sort_results, or_labelled, or_pivot, densify_periods, sort_custom_order,
        report_descriptive, section_totals, section_composition, qa_counts, qa_subgroup_counts, qa_emptiness,
        an_missing, qa_distinct_bitmaps, join_filtered, report_ordered,
    )
}

PERIOD_DAYS = "date_diff('day', make_date(CAST(split_part({0}, '-', 1) AS BIGINT), 1, 1), make_date(CAST(split_part({0}, '-', 2) AS BIGINT), 12, 31)) + 1"
PAF = 'CASE WHEN {0} > 0 THEN 1 - 1 / {0} END'

# heat and death counts of the attribution queries
AN_PARTS = f"""hot AS (
 SELECT year_period, municipality, CAST(substr(municipality, 3, 2) AS INTEGER) AS ENT_OCURR,
  CAST(coalesce(sum(hw_99_max_1), 0) AS BIGINT) AS hw_99_max_1, CAST(coalesce(sum(hw_95_max_1), 0) AS BIGINT) AS hw_95_max_1
 FROM heat GROUP BY year_period, municipality),
period_deaths AS (
 SELECT municipality, year_period, CAST(sum(Group_A_SEXO + Group_B_SEXO + Group_C_SEXO) AS BIGINT) AS deaths_total
 FROM daily WHERE year_period IS NOT NULL GROUP BY municipality, year_period),
an AS (
 SELECT h.municipality, h.year_period, h.ENT_OCURR, h.hw_95_max_1, p.deaths_total,
  r."or" AS OR_point, r.or_low AS OR_lcl, r.or_high AS OR_ucl,
  {PAF.format('r."or"')} AS PAF_point, {PAF.format('r.or_low')} AS PAF_lcl, {PAF.format('r.or_high')} AS PAF_ucl,
  p.deaths_total * (h.hw_95_max_1 / ({PERIOD_DAYS.format('h.year_period')})) AS exposed
 FROM hot h
 LEFT JOIN results r ON r.level = 'state' AND r.place = h.ENT_OCURR AND r.year_period = h.year_period
  AND r.variable = 'hw_95_max_1' AND r.type = 'Same Day'
 LEFT JOIN period_deaths p ON p.municipality = h.municipality AND p.year_period = h.year_period),
by_state AS (
 SELECT h.ENT_OCURR, h.year_period, h.hw_definition,
  coalesce(sum(h.days / ({PERIOD_DAYS.format('h.year_period')}) * p.deaths_total * {PAF.format('r."or"')}), 0) AS AN_deaths_est,
  CAST(sum(CASE WHEN r."or" IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_missing_or,
  CAST(sum(CASE WHEN p.deaths_total IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_missing_deaths
 FROM (SELECT ENT_OCURR, year_period, municipality, unnest(['hw_99_max_1', 'hw_95_max_1']) AS hw_definition,
   unnest([hw_99_max_1, hw_95_max_1]) AS days FROM hot) h
 LEFT JOIN results r ON r.level = 'state' AND r.place = h.ENT_OCURR AND r.year_period = h.year_period
  AND r.variable = h.hw_definition AND r.type = 'Same Day'
 LEFT JOIN period_deaths p ON p.municipality = h.municipality AND p.year_period = h.year_period
 GROUP BY h.ENT_OCURR, h.year_period, h.hw_definition)
"""


def _round(columns) -> str:
    return ", ".join(f'round("{c}", 6) AS "{c}"' for c in columns)


AN_POINT = "exposed * PAF_point AS AN_deaths_est, exposed * PAF_lcl AS AN_deaths_est_lcl, exposed * PAF_ucl AS AN_deaths_est_ucl"
AN_VALUES = ["AN_deaths_est", "AN_deaths_est_lcl", "AN_deaths_est_ucl"]
AN_SHOWN = [*attribution.OR_NAMES.values(), *attribution.PAF_NAMES.values(), *AN_VALUES]


def an_sql(select: str) -> str:
    return state_model_sql(f", {AN_PARTS} {select}")


def _values(mapping) -> str:
    return ", ".join("('" + k.replace("'", "''") + f"', '{v}')" for k, v in mapping.items())


LABELS_SQL = f""", labels AS (SELECT * FROM (VALUES {_values(SUBGROUP_LABELS)}) AS l(code, label)),
families AS (SELECT * FROM (VALUES {_values(FAMILY_LABELS)}) AS f(family, title)),
labelled AS (
 SELECT "or", or_low, or_high, coalesce(title, subgroup_type) AS subgroup_type, coalesce(label, subgroup) AS subgroup, year_period
 FROM results LEFT JOIN labels ON subgroup = code LEFT JOIN families ON subgroup_type = family
 WHERE variable = 'hw_95_max_1' AND type = 'Same Day'),
plotted AS (
 SELECT subgroup_type, coalesce(label, subgroup) AS subgroup, year_period, "or"
 FROM results LEFT JOIN labels ON subgroup = code
 WHERE variable = 'hw_95_max_1' AND subgroup NOT IN ('Group_C_SEXO', 'NACIONALID_NO_ESPEC'))
"""

PERIOD_SUM = ", ".join(
    f"""CAST(coalesce(sum(CASE WHEN year_period = '{p}' THEN deaths END), 0) AS BIGINT) AS "{p}\"""" for p in LABELS
)
SECTIONS = f"""WITH {sql.DAILY},
stacked AS (
 SELECT year_period, unnest([{", ".join(f"'{f}'" for f in sql.FAMILY_OF.values())}]) AS family,
  unnest([{", ".join(f"'{s}'" for s in sql.FAMILY_OF)}]) AS Subgroup, unnest([{", ".join(sql.FAMILY_OF)}]) AS deaths
 FROM daily WHERE year_period IS NOT NULL),
sections AS (SELECT * FROM (VALUES {_values(REPORT_SECTIONS)}) AS s(section, family)),
described AS (
 SELECT section, Subgroup, {PERIOD_SUM}, CAST(sum(deaths) AS BIGINT) AS "Total"
 FROM stacked JOIN sections USING (family) GROUP BY section, Subgroup),
report AS (
 SELECT * FROM described UNION ALL
 SELECT 'TOTAL', 'TOTAL', {", ".join(f'CAST(sum("{p}") AS BIGINT)' for p in [*LABELS, "Total"])}
 FROM described WHERE section = 'Sex')
"""
DAILY = f"WITH {sql.DAILY}\n"

ORACLES = {
    "an_municipality": an_sql(
        f"""SELECT municipality, year_period, ENT_OCURR, hw_95_max_1, deaths_total, {_round(AN_SHOWN)}
FROM (SELECT *, {AN_POINT} FROM an)"""
    ),
    "an_state_collapsed": an_sql(
        f"""SELECT ENT_OCURR, year_period, CAST(coalesce(sum(deaths_total), 0) AS BIGINT) AS deaths_total,
 {", ".join(f"round(coalesce(sum({c}), 0), 6) AS {c}" for c in AN_VALUES)},
 CAST(sum(CASE WHEN OR_point IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_missing_or,
 CAST(sum(CASE WHEN deaths_total IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_missing_deaths
FROM (SELECT *, {AN_POINT} FROM an) GROUP BY ENT_OCURR, year_period"""
    ),
    "an_state_period": an_sql(
        "SELECT ENT_OCURR, year_period, hw_definition, round(AN_deaths_est, 6) AS AN_deaths_est, n_missing_or, n_missing_deaths FROM by_state"
    ),
    "topk_an_state": an_sql(
        """SELECT ENT_OCURR, year_period, hw_definition, round(AN_deaths_est, 6) AS AN_deaths_est, n_missing_or, n_missing_deaths
FROM by_state ORDER BY round(AN_deaths_est, 6) DESC, ENT_OCURR, year_period, hw_definition LIMIT 12"""
    ),
    "results_select": state_model_sql(
        f"""SELECT level, nullif(place, -1) AS ENT_OCURR, year_period, variable, type, {_round(["or", "or_low", "or_high"])}
FROM results WHERE variable = 'hw_95_max_1' AND type = 'Same Day'"""
    ),
    "or_first_per_state": state_model_sql(
        f"""SELECT place AS ENT_OCURR, year_period, variable, type, {_round(["or"])}
FROM results WHERE level = 'state'
QUALIFY row_number() OVER (PARTITION BY place, year_period ORDER BY variable, type) = 1"""
    ),
    "distinct_states": DAILY + "SELECT DISTINCT ENT_OCURR FROM daily ORDER BY 1",
    "sort_results": state_model_sql(
        f"""SELECT level, nullif(place, -1) AS ENT_OCURR, year_period, variable, type, {_round(["or"])}
FROM results ORDER BY type, variable, year_period, level, ENT_OCURR"""
    ),
    "or_labelled": subgroup_model_sql(
        f"{LABELS_SQL} SELECT {_round(['or', 'or_low', 'or_high'])}, subgroup_type, subgroup, year_period FROM labelled"
    ),
    "or_pivot": subgroup_model_sql(
        f"""{LABELS_SQL} SELECT subgroup_type, subgroup, {", ".join(
            f'''round(avg(CASE WHEN year_period = '{p}' THEN "or" END), 6) AS "{p}"''' for p in LABELS)}
FROM plotted GROUP BY subgroup_type, subgroup"""
    ),
    "densify_periods": subgroup_model_sql(
        f"""{LABELS_SQL}, wanted AS (
 SELECT subgroup, unnest([{", ".join(f"'{p}'" for p in [*LABELS, "2002-2004"])}]) AS year_period
 FROM (SELECT DISTINCT subgroup FROM labelled WHERE subgroup_type = 'Sex' AND subgroup IN ('Male', 'Female')))
SELECT w.subgroup, w.year_period, round("or", 6) AS "or", round(or_low, 6) AS or_low, round(or_high, 6) AS or_high
FROM wanted w LEFT JOIN labelled l ON l.subgroup = w.subgroup AND l.year_period = w.year_period AND l.subgroup_type = 'Sex'"""
    ),
    "qa_subgroup_counts": subgroup_model_sql(
        f"{LABELS_SQL} SELECT subgroup_type, count(DISTINCT subgroup) AS n_subgroup FROM plotted GROUP BY subgroup_type"
    ),
    "sort_custom_order": DAILY
    + f"""SELECT subgroup, CAST(sum(deaths) AS BIGINT) AS deaths,
 CAST(coalesce(list_position([{", ".join(f"'{s}'" for s in SUBGROUP_LABELS)}], subgroup), {len(SUBGROUP_LABELS) + 1}) AS INTEGER) AS place
FROM (SELECT unnest([{", ".join(f"'{s}'" for s in sql.FAMILY_OF)}]) AS subgroup, unnest([{", ".join(sql.FAMILY_OF)}]) AS deaths FROM daily)
GROUP BY subgroup ORDER BY place, subgroup""",
    "report_descriptive": SECTIONS + "SELECT * FROM report",
    "section_totals": SECTIONS
    + "SELECT section, "
    + ", ".join(f'CAST(sum("{p}") AS BIGINT) AS "{p}"' for p in [*LABELS, "Total"])
    + " FROM report GROUP BY section",
    "section_composition": SECTIONS
    + f""", shares AS (
 SELECT section, Subgroup, unnest([{", ".join(f"'{p}'" for p in LABELS)}]) AS year_period,
  unnest([{", ".join(f'"{p}"' for p in LABELS)}]) AS deaths FROM described)
SELECT section, Subgroup, year_period, deaths,
 round(100.0 * deaths / sum(deaths) OVER (PARTITION BY section, year_period), 6) AS share_pct FROM shares""",
    "qa_counts": DAILY
    + """SELECT count(*) AS n_rows, 35 AS n_columns, count(DISTINCT municipality) AS n_municipality,
 count(DISTINCT date) AS n_date, count(DISTINCT year_period) AS n_year_period FROM daily""",
    "qa_emptiness": DAILY
    + f"""SELECT count(*) AS n_rows,
 count(*) FILTER (WHERE coalesce({", ".join(f"CAST({c} AS VARCHAR)" for c in ["date", "ENT_OCURR", "MUN_OCURR", *sql.FAMILY_OF])}) IS NULL) AS n_empty_rows,
 2 AS n_empty_columns, 'note,source' AS empty_columns FROM daily""",
}


def _union_sql() -> str:
    """Both result tables need their own chain of iterations, so each is a nested query."""
    shown = 'year_period, variable, type, round(estimate, 6) AS estimate, round("or", 6) AS "or"'
    states = state_model_sql(f"SELECT level, nullif(place, -1) AS ENT_OCURR, {shown} FROM results")
    groups = subgroup_model_sql(f"SELECT subgroup_type, subgroup, {shown} FROM results")
    return f"SELECT * FROM ({states}) UNION ALL BY NAME SELECT * FROM ({groups})"


ORACLES["union_results"] = _union_sql()
ORACLES["an_missing"] = state_model_sql(
    ", "
    + AN_PARTS.replace("r.level = 'state'", "r.level = 'state' AND r.place <> 2").replace(
        "WHERE year_period IS NOT NULL GROUP BY municipality, year_period", "WHERE year_period IS NOT NULL AND municipality NOT LIKE '%5' GROUP BY municipality, year_period"
    )
    + "SELECT ENT_OCURR, year_period, hw_definition, round(AN_deaths_est, 6) AS AN_deaths_est, n_missing_or, n_missing_deaths FROM by_state"
)
ORACLES["qa_distinct_bitmaps"] = f"""WITH {sql.DAILY},
counts AS (
 SELECT CASE WHEN grouping(year_period) = 1 THEN 'all' ELSE year_period END AS year_period, count(DISTINCT (ENT_OCURR, MUN_OCURR)) AS place,
  count(DISTINCT date) AS day, count(DISTINCT year(date)) AS year FROM daily GROUP BY GROUPING SETS ((), (year_period)))
SELECT * FROM (SELECT year_period, unnest(['place', 'day', 'year']) AS name, unnest([place, day, year]) AS n FROM counts) WHERE n > 0"""
ORACLES["join_filtered"] = JOINED + "SELECT * FROM joined"
ORACLES["report_ordered"] = (
    SECTIONS
    + f"""SELECT *, CAST(list_position([{", ".join(f"'{s}'" for s in [reports.TOTAL_SECTION, *REPORT_SECTIONS])}], section) AS INTEGER) AS place FROM report"""
)
