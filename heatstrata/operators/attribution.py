"""Deaths attributable to heat: hot days and deaths of a place, times 1 - 1/OR of its state."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heatstrata.functions.numbers import sum_or_zero
from heatstrata.functions.odds import attributable_fraction
from heatstrata.functions.periods import normal_label, period_days
from heatstrata.functions.places import state_of_id
from heatstrata.operators.columns import require_columns
from heatstrata.operators.crossover import SAME_DAY

# Names of the result columns.
OR_NAMES = {"or": "OR_point", "or_low": "OR_lcl", "or_high": "OR_ucl"}
PAF_NAMES = {"OR_point": "PAF_point", "OR_lcl": "PAF_lcl", "OR_ucl": "PAF_ucl"}
AN_NAMES = {
    "PAF_point": "AN_deaths_est", "PAF_lcl": "AN_deaths_est_lcl", "PAF_ucl": "AN_deaths_est_ucl",
}


def select_results(results: DataFrame, variables: Sequence[str], type: str = SAME_DAY) -> DataFrame:
    """Results of the wanted exposures and lag."""
    return results.where(F.col("variable").isin(list(variables)) & (F.col("type") == type))


def state_level(results: DataFrame, state: str = "ENT_OCURR") -> DataFrame:
    """Only per-state results, with a numeric state and the usual period label.

    Tables written elsewhere mark the overall rows with the state ``All``; tables made here have a
    ``level`` column.
    """
    keep = F.col("level") == "state" if "level" in results.columns else F.col(state) != "All"
    return results.where(keep).withColumns(
        {state: F.col(state).cast("int"), "year_period": normal_label(F.col("year_period"))}
    )


def first_per_key(
    results: DataFrame, keys: Sequence[str] = ("ENT_OCURR", "year_period"), ties: Sequence[str] = ("variable", "type")
) -> DataFrame:
    """One result per key: the first by the tie-breaking columns."""
    order = Window.partitionBy(*keys).orderBy(*ties)
    return results.withColumn("_n", F.row_number().over(order)).where(F.col("_n") == 1).drop("_n")


def _period_deaths(deaths: DataFrame) -> DataFrame:
    return deaths.select("municipality", normal_label(F.col("year_period")).alias("year_period"), "deaths_total")


def attributable_by_municipality(
    heat: DataFrame,
    odds: DataFrame,
    deaths: DataFrame,
    variable: str,
    type: str = SAME_DAY,
    period_length: str = "calendar",
) -> DataFrame:
    """Attributable deaths with limits, by municipality and period.

    heat: year_period, municipality, hot days in column ``variable``; odds: per-state results;
    deaths: municipality, year_period, deaths_total. ``period_length="observed"`` divides by the
    column ``observed_days`` of ``heat`` instead of the calendar length.
    """
    require_columns(heat, ("year_period", "municipality", variable), "heat days")
    require_columns(
        odds, ("ENT_OCURR", "year_period", "variable", "type", *OR_NAMES), "odds ratios"
    )
    require_columns(deaths, ("municipality", "year_period", "deaths_total"), "period deaths")
    chosen = first_per_key(select_results(state_level(odds), [variable], type)).select(
        "ENT_OCURR", "year_period", *[F.col(f"`{a}`").alias(b) for a, b in OR_NAMES.items()]
    )
    days = period_days(F.col("year_period"))
    if period_length == "observed":
        days = F.col("observed_days")
    extra = ["observed_days"] if period_length == "observed" else []
    joined = (
        heat.select(normal_label(F.col("year_period")).alias("year_period"), "municipality", variable, *extra)
        .withColumn("ENT_OCURR", state_of_id(F.col("municipality"), strict=True))
        .join(chosen, ["ENT_OCURR", "year_period"], "left")
        .join(_period_deaths(deaths), ["municipality", "year_period"], "left")
    )
    exposed = F.col("deaths_total") * F.try_divide(F.col(variable), days)
    return (
        joined.withColumns({paf: attributable_fraction(F.col(o)) for o, paf in PAF_NAMES.items()})
        .withColumn("_exposed", exposed)
        .withColumns({an: F.col("_exposed") * F.col(paf) for paf, an in AN_NAMES.items()})
        .select(
            "municipality", "year_period", "ENT_OCURR", variable, "deaths_total",
            *OR_NAMES.values(), *PAF_NAMES.values(), *AN_NAMES.values(),
        )
    )


def collapse_to_state(
    by_municipality: DataFrame, columns: Sequence[str] = ("deaths_total", *AN_NAMES.values())
) -> DataFrame:
    """State sums. An unknown attributable number counts 0.

    ``n_missing_or`` and ``n_missing_deaths`` say how many municipalities have no odds ratio and how
    many no count of deaths.
    """
    columns = list(columns)
    return (
        by_municipality.na.drop(subset=["ENT_OCURR", "year_period"])
        .groupBy("ENT_OCURR", "year_period")
        .agg(
            *[sum_or_zero(F.col(c)).alias(c) for c in columns],
            F.sum(F.col("OR_point").isNull().cast("int")).alias("n_missing_or"),
            F.sum(F.col("deaths_total").isNull().cast("int")).alias("n_missing_deaths"),
        )
    )


def attributable_by_state(
    heat: DataFrame, odds: DataFrame, deaths: DataFrame, variables: Sequence[str], type: str = SAME_DAY
) -> DataFrame:
    """Attributable deaths by state, period and heat definition, all definitions in one pass."""
    require_columns(heat, ("year_period", "municipality", *variables), "heat days")
    chosen = first_per_key(
        select_results(state_level(odds), variables, type),
        keys=("ENT_OCURR", "year_period", "variable"),
        ties=("type",),
    ).select("ENT_OCURR", "year_period", F.col("variable").alias("hw_definition"), "or")
    hot = (
        heat.select(normal_label(F.col("year_period")).alias("year_period"), "municipality", *variables)
        .withColumn("ENT_OCURR", state_of_id(F.col("municipality")))
        .unpivot(["ENT_OCURR", "municipality", "year_period"], list(variables), "hw_definition", "hot_days")
    )
    joined = hot.join(_period_deaths(deaths), ["municipality", "year_period"], "left").join(
        chosen, ["ENT_OCURR", "year_period", "hw_definition"], "left"
    )
    share = F.col("hot_days") / period_days(F.col("year_period"))
    number = share * F.col("deaths_total") * attributable_fraction(F.col("or"))
    return (
        joined.na.drop(subset=["ENT_OCURR", "year_period"])
        .withColumn("_an", number)
        .groupBy("ENT_OCURR", "year_period", "hw_definition")
        .agg(
            sum_or_zero(F.col("_an")).alias("AN_deaths_est"),
            F.sum(F.col("or").isNull().cast("int")).alias("n_missing_or"),
            F.sum(F.col("deaths_total").isNull().cast("int")).alias("n_missing_deaths"),
        )
    )
