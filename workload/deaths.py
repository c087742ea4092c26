"""Cleaning and day sums of the death records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heatstrata.functions.indicators import equal_flag, member_flag, prefix_flag, range_flag
from heatstrata.operators import mortality, quality
from heatstrata.operators.codebook import SUBGROUPS
from heatstrata.plans.refresh import DeathBatches
from heatstrata.sources.work_folder import work_folder
from workload import sql
from workload.tables import KEYS, PERIODS, death_records, deaths_by_subgroup, deaths_clean, deaths_daily, heat, weather

DAY_PLACE = ["date_of_occurrence", "ENT_OCURR", "MUN_OCURR"]


def clean_deaths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deaths_clean(spark, sf_dir)


def filter_valid_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mortality.with_known_day(death_records(spark, sf_dir))


def filter_valid_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mortality.with_known_place(death_records(spark, sf_dir))


def ind_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    cause = F.col("CAUSA_DEF")
    return death_records(spark, sf_dir).select(
        "o_orderkey", *[prefix_flag(cause, p).alias(f"IS_{p}") for p in ("I", "J", "F")]
    )


def ind_isin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return death_records(spark, sf_dir).select(
        "o_orderkey",
        member_flag(F.col("CAUSA_DEF"), ["T67", "X30"]).alias("IS_TX"),
        member_flag(F.col("EDAD_AGRU"), [6, 7, 8]).alias("Group_B_EDAD"),
    )


def ind_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    bands = {"A": (1, 5), "C": (9, 17), "D": (18, 21), "E": (22, 29)}
    age = F.col("EDAD_AGRU")
    return death_records(spark, sf_dir).select(
        "o_orderkey", *[range_flag(age, *b).alias(f"Group_{k}_EDAD") for k, b in bands.items()]
    )


def ind_equals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return death_records(spark, sf_dir).select(
        "o_orderkey",
        equal_flag(F.col("EDAD_AGRU"), 30).alias("Group_F_EDAD"),
        equal_flag(F.col("SEXO"), 1).alias("Group_A_SEXO"),
        equal_flag(F.col("NACIONALID"), 9).alias("NACIONALID_NO_ESPEC"),
    )


def daily_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mortality.daily_sums(deaths_clean(spark, sf_dir))


def daily_sum_legacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with an unknown date go and unknown cells count 0."""
    return mortality.daily_sums(deaths_clean(spark, sf_dir), nulls="drop")


def daily_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mortality.daily_total(deaths_daily(spark, sf_dir), KEYS)


def daily_subgroup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All subgroups side by side. The records are summed by number; a cell gets its id text afterwards."""
    cells = mortality.daily_subgroups(deaths_clean(spark, sf_dir), keys=DAY_PLACE)
    return mortality.with_municipality(cells).drop("date_of_occurrence", "MUN_OCURR")


def unpivot_subgroups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mortality.unpivot_subgroups(deaths_by_subgroup(spark, sf_dir), KEYS)


def deaths_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mortality.period_totals(
        deaths_daily(spark, sf_dir), ["ENT_OCURR", "MUN_OCURR", "municipality", "year_period"]
    )


def deaths_period_refreshed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deaths by period from sums that were loaded by year, one year twice."""
    daily = deaths_daily(spark, sf_dir)
    store = DeathBatches(spark, work_folder(spark), PERIODS)
    for years in ("year(date) < 1998", "year(date) = 1996", "year(date) >= 1998"):
        store.add(daily.where(years))
    return store.totals()


def joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = heat(spark, sf_dir).select("municipality", "date", "tmax_max", "hw_95_max_1", "hw_99_max_1")
    deaths = deaths_daily(spark, sf_dir).drop("date_of_occurrence", "year_period")
    return deaths.join(days, ["municipality", "date"], "left")


def join_deaths_weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined(spark, sf_dir)


def profile_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.join_profile(joined(spark, sf_dir))


def key_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = mortality.with_municipality(daily_sum(spark, sf_dir))
    return quality.key_overlap(days, weather(spark, sf_dir), "municipality")


def repeated_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Municipality-days with several raw records; the day sums must have none."""
    clean = deaths_clean(spark, sf_dir)
    return quality.repeated_keys(clean, DAY_PLACE)


QUERIES = {
    f.__name__: f
    for f in (
        clean_deaths, filter_valid_day, filter_valid_place, ind_prefix, ind_isin, ind_between, ind_equals, daily_sum,
        daily_sum_legacy, daily_total, daily_subgroup, unpivot_subgroups, deaths_period, deaths_period_refreshed, join_deaths_weather,
        profile_join, key_overlap, repeated_keys,
    )
}

NAMES = ", ".join(SUBGROUPS)
RECORDS = f"WITH {sql.RECORDS}\n"
CLEAN = f"WITH {sql.CLEAN}\n"
DAILY = f"WITH {sql.DAILY}\n"
SUMS = ", ".join(f"CAST(coalesce(sum({c}), 0) AS BIGINT) AS {c}" for c in SUBGROUPS)
JOINED = f"""WITH {sql.HEAT},
{sql.DAILY},
joined AS (
 SELECT d.* EXCLUDE (date_of_occurrence, year_period), h.tmax_max, h.hw_95_max_1, h.hw_99_max_1
 FROM daily d LEFT JOIN heat h ON h.municipality = d.municipality AND h.date = d.date)
"""


def _flag(test: str, name: str) -> str:
    return f"CASE WHEN {test} THEN 1 ELSE 0 END AS {name}"


ORACLES = {
    "clean_deaths": CLEAN + "SELECT * FROM clean",
    "filter_valid_day": RECORDS + "SELECT * FROM records WHERE DIA_OCURR IS NULL OR DIA_OCURR <> 99",
    "filter_valid_place": RECORDS
    + "SELECT * FROM records WHERE (ENT_OCURR IS NULL OR ENT_OCURR <> 999) AND (MUN_OCURR IS NULL OR MUN_OCURR <> 999)",
    "ind_prefix": RECORDS
    + "SELECT o_orderkey, " + ", ".join(_flag(f"CAUSA_DEF LIKE '{p}%'", f"IS_{p}") for p in "IJF") + " FROM records",
    "ind_isin": RECORDS
    + f"SELECT o_orderkey, {_flag(sql.INDICATORS['IS_TX'], 'IS_TX')}, {_flag('EDAD_AGRU IN (6, 7, 8)', 'Group_B_EDAD')} FROM records",
    "ind_between": RECORDS
    + "SELECT o_orderkey, " + ", ".join(_flag(sql.INDICATORS[f"Group_{k}_EDAD"], f"Group_{k}_EDAD") for k in "ACDE") + " FROM records",
    "ind_equals": RECORDS
    + "SELECT o_orderkey, "
    + ", ".join(_flag(sql.INDICATORS[n], n) for n in ("Group_F_EDAD", "Group_A_SEXO", "NACIONALID_NO_ESPEC"))
    + " FROM records",
    "daily_sum": DAILY + f"SELECT date_of_occurrence, ENT_OCURR, MUN_OCURR, {NAMES} FROM daily",
    "daily_sum_legacy": CLEAN
    + f"""SELECT date_of_occurrence, ENT_OCURR, MUN_OCURR, {SUMS} FROM clean
WHERE date_of_occurrence IS NOT NULL AND ENT_OCURR IS NOT NULL AND MUN_OCURR IS NOT NULL
GROUP BY date_of_occurrence, ENT_OCURR, MUN_OCURR""",
    "daily_total": f"WITH {sql.TOTAL}\nSELECT * FROM total",
    "daily_subgroup": CLEAN
    + f"""SELECT ENT_OCURR, printf('MX%02d%03d', ENT_OCURR, MUN_OCURR) AS municipality, date_of_occurrence AS date, {SUMS}
FROM clean GROUP BY ALL""",
    "unpivot_subgroups": DAILY
    + f"""SELECT ENT_OCURR, municipality, date, year_period,
 unnest([{", ".join(f"'{s}'" for s in sql.FAMILY_OF)}]) AS subgroup, unnest([{", ".join(sql.FAMILY_OF)}]) AS deaths,
 unnest([{", ".join(f"'{f}'" for f in sql.FAMILY_OF.values())}]) AS subgroup_type FROM daily""",
    "deaths_period": DAILY
    + """SELECT ENT_OCURR, MUN_OCURR, municipality, year_period,
 CAST(sum(Group_A_SEXO + Group_B_SEXO + Group_C_SEXO) AS BIGINT) AS deaths_total
FROM daily WHERE year_period IS NOT NULL GROUP BY ALL""",
    "join_deaths_weather": JOINED + "SELECT * FROM joined",
    "profile_join": JOINED
    + "SELECT count(DISTINCT municipality) AS n_units, min(date) AS first_date, max(date) AS last_date FROM joined",
    "key_overlap": f"WITH {sql.HEAT},\n{sql.DAILY}\n"
    + "SELECT count(*) AS n_common FROM (SELECT municipality FROM daily INTERSECT SELECT municipality FROM weather)",
    "repeated_keys": CLEAN
    + """SELECT date_of_occurrence, ENT_OCURR, MUN_OCURR, count(*) AS n_rows FROM clean
GROUP BY date_of_occurrence, ENT_OCURR, MUN_OCURR HAVING count(*) > 1""",
}
ORACLES["deaths_period_refreshed"] = ORACLES["deaths_period"]
