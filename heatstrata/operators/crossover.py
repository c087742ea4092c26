"""Time-stratified case-crossover: matched days, strata, conditional odds ratios.

A death-day is compared with the days of the same unit, year, month and weekday. With one binary
exposure and one case day per stratum, the conditional likelihood needs from a stratum only four
numbers: case exposure ``xc``, exposed days ``n1``, unexposed days ``n0`` and weight ``w``. So

* the reference days are counted by a window on the weather side (at most five days per group);
* one equi-join on (unit, date) then gives every death-day its stratum, with no expansion;
* all subgroups share that row, as weights side by side;
* rows collapse to a few dozen patterns per model, before and after one small shuffle;
* every model is fitted by a built-in expression over its own patterns, all in parallel.

``expand`` builds the matched rows themselves, for inspection and for tests.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heatstrata.functions.dates import iso_weekday
from heatstrata.functions.odds import odds_ratio_columns, two_sided_p

SAME_DAY = "Same Day"
LAG_1_DAY = "Lag 1 Day"

# Exposure sets of the studies.
EXPOSURES_99 = (
    "hw_99_max_1", "hw_99_min_1", "hw_99_max_2", "hw_99_min_2",
    "hw_99_max_3", "hw_99_min_3", "hw_abs_30", "hw_abs_35",
)
EXPOSURES_95_90 = ("hw_95_max_1", "hw_95_min_1", "hw_90_max_1", "hw_90_min_1")
EXPOSURES_BY_STATE = ("hw_99_max_1", "hw_95_max_1")
EXPOSURES_BY_SUBGROUP = ("hw_99_max_1", "hw_95_max_1", "hw_90_max_1", "hw_abs_30", "hw_abs_35")

NEWTON_STEPS = 60
FARTHEST_ESTIMATE = 40


@dataclass(frozen=True)
class Exposure:
    """A 0/1/null column of the weather table and how results name it."""

    column: str
    type: str = SAME_DAY


def same_day(columns: Sequence[str]) -> list[Exposure]:
    return [Exposure(c) for c in columns]


def lag_1_day(columns: Sequence[str]) -> list[Exposure]:
    return [Exposure(f"{c}_lag1", LAG_1_DAY) for c in columns]


def stratum_keys(date: str) -> dict[str, Column]:
    return {"year": F.year(date), "month": F.month(date), "wday": iso_weekday(F.col(date))}


def expand(
    deaths: DataFrame, weather: DataFrame, unit: str = "municipality", date: str = "date"
) -> DataFrame:
    """Every death-day with its matched days: at most five rows per death-day.

    ``case`` is 1 on the day itself, 0 on a reference day, null when no day matches.
    """
    keys = [unit, *stratum_keys(date)]
    cases = deaths.withColumns(stratum_keys(date)).withColumnRenamed(date, "case_date")
    days = weather.withColumns(stratum_keys(date))
    return cases.join(days, keys, "left").withColumn("case", (F.col(date) == F.col("case_date")).cast("int"))


def control_counts(matched: DataFrame, unit: str = "municipality") -> DataFrame:
    """Matched days and case days of every death-day."""
    return matched.groupBy(unit, "case_date").agg(
        F.count("case").alias("n_days"),
        F.coalesce(F.sum("case"), F.lit(0)).alias("n_cases"),
        F.sum(F.when(F.col("case") == 0, 1).otherwise(0)).alias("n_controls"),
    )


def with_reference_counts(
    weather: DataFrame, exposures: Sequence[Exposure], unit: str = "municipality", date: str = "date"
) -> DataFrame:
    """Next to each exposure x: exposed days (``x#n1``) and unexposed days (``x#n0``) of its stratum.

    The window keys start with the unit, so a table already partitioned by unit is not shuffled. A
    unit with two rows for one day is an error: in the same window, the days as bits must add up to
    what they are together. That is looked at once a row, where the date is handed on.
    """
    over = f"OVER (PARTITION BY `{unit}`, year(`{date}`), month(`{date}`), weekday(`{date}`))"
    bit = f"shiftleft(1L, day(`{date}`))"
    counts = {
        f"{x.column}#{place}": F.expr(f"CAST(sum({value}) {over} AS INT)")
        for x in exposures
        for place, value in (("n1", f"`{x.column}`"), ("n0", f"1 - `{x.column}`"))
    }
    once = F.expr(f"sum({bit}) {over} <=> bit_or({bit}) {over}")
    counted = weather.withColumns({**counts, "_once": once})
    return counted.withColumn(date, F.expr(f"if(_once, `{date}`, raise_error('two rows for one unit and day'))")).drop("_once")


def strata(
    deaths: DataFrame,
    weather: DataFrame,
    exposures: Sequence[Exposure],
    unit: str = "municipality",
    date: str = "date",
) -> DataFrame:
    """Death-days with their case exposure and reference counts.

    A death-day without weather on the same day has no case row and adds nothing to a
    conditional likelihood, hence the inner join.
    """
    counted = with_reference_counts(weather, exposures, unit, date).select(unit, date, *stratum_columns(exposures))
    return deaths.join(counted, [unit, date])


def stratum_columns(exposures: Sequence[Exposure]) -> list[str]:
    """The columns that strata have of each exposure."""
    return [c for x in exposures for c in (x.column, f"{x.column}#n1", f"{x.column}#n0")]


def one_row_a_day(deaths: DataFrame, unit: str = "municipality", date: str = "date") -> DataFrame:
    """The same table, with an error where a unit has two rows for one day: they would count as two strata.

    Partitioned by the unit, so next to other work by unit it costs no shuffle. Rows without unit or
    date match no day and are not looked at.
    """
    several = f"count(*) OVER (PARTITION BY `{unit}`, `{date}`) > 1 AND `{unit}` IS NOT NULL AND `{date}` IS NOT NULL"
    counted = deaths.withColumn("_several", F.expr(several))
    return counted.withColumn(date, F.expr(f"if(_several, raise_error('two death rows for one unit and day'), `{date}`)")).drop("_several")


def long_strata(rows: DataFrame, exposures: Sequence[Exposure], keep: Sequence[str]) -> DataFrame:
    """Strata with one row per known exposure and the columns to keep: a projection."""
    entry = "struct('{0}' AS variable, '{1}' AS type, `{0}` AS xc, `{0}#n1` AS n1, `{0}#n0` AS n0)"
    entries = ", ".join(entry.format(x.column, x.type) for x in exposures)
    return rows.select(*keep, F.expr(f"inline(array({entries}))")).where("xc IS NOT NULL")


def stratum_patterns(
    rows: DataFrame,
    exposures: Sequence[Exposure],
    weights: Sequence[str],
    by: Sequence[str] = (),
    weighted: bool = True,
    squares: bool = False,
) -> DataFrame:
    """Collapse strata to patterns: one row per group, exposure and (xc, n1, n0).

    Each weight column becomes the total weight of the pattern (``weighted``), or the number of
    its strata with any weight. ``squares`` adds the sum of squared weights as ``<weight>#2``, which
    the robust variance needs. All of them are sums, so patterns of disjoint days can be added up.
    """
    amounts = ["CAST(sum(`{0}`) AS DOUBLE) AS `{0}`" if weighted else "CAST(count_if(`{0}` > 0) AS DOUBLE) AS `{0}`"]
    if squares:
        amounts.append(f"CAST({'sum(`{0}` * `{0}`)' if weighted else 'count_if(`{0}` > 0)'} AS DOUBLE) AS `{{0}}#2`")
    return (
        long_strata(rows, exposures, [*by, *weights])
        .groupBy(*by, "variable", "type", "xc", "n1", "n0")
        .agg(*[F.expr(amount.format(w)) for w in weights for amount in amounts])
    )


def unpivot_weights(
    patterns: DataFrame, families: Mapping[str, str], by: Sequence[str] = ()
) -> DataFrame:
    """Patterns with one weight column per subgroup to rows keyed by subgroup."""
    entry = "struct('{1}' AS subgroup_type, '{0}' AS subgroup, `{0}` AS w)"
    entries = ", ".join(entry.format(*pair) for pair in families.items())
    return patterns.select(
        *by, "variable", "type", "xc", "n1", "n0", F.expr(f"inline(array({entries}))")
    )


def add_overall_level(
    patterns: DataFrame, place: str, by: Sequence[str] = (), weight: str = "w"
) -> DataFrame:
    """Patterns of every place plus those of all places together.

    ``level`` tells them apart; the place is null on the ``overall`` rows.
    """
    common = [*by, "variable", "type", "xc", "n1", "n0"]
    columns = [F.col(c) for c in common]
    return (
        patterns.groupingSets([columns, [F.col(place), *columns]], F.col(place), *columns)
        .agg(F.sum(weight).alias(weight), F.grouping(place).alias("_all"))
        .withColumn("level", F.when(F.col("_all") == 1, F.lit("overall")).otherwise(F.lit("state")))
        .drop("_all")
    )


# Score and information of the conditional likelihood at the odds ratio {r} = e^b, over all
# patterns of a model. With p = n1 r / (n0 + n1 r), the probability that the case day is exposed,
# the score is w (xc - p), written without the difference that would cancel near p = 1.
_DERIVATIVES = """aggregate(
    cells, named_struct('score', 0D, 'information', 0D),
    (t, c) -> named_struct(
        'score', t.score + c.w * (c.xc * c.n0 - (1 - c.xc) * c.n1 * {r}) / (c.n0 + c.n1 * {r}),
        'information', t.information + c.w * c.n1 * {r} * c.n0 / power(c.n0 + c.n1 * {r}, 2)))"""

# Sum of squared score residuals of the strata, each stratum being one independent observation.
_SQUARED_SCORES = """aggregate(
    cells, 0D, (t, c) -> t + c.w2 * power((c.xc * c.n0 - (1 - c.xc) * c.n1 * {r}) / (c.n0 + c.n1 * {r}), 2))"""

# One Newton step, kept inside an interval known to hold the root of the falling score. A solved
# model is passed on as it is.
_STEP = f"""if(s.done, s, transform(
    array({_DERIVATIVES.format(r="s.r")}),
    d -> transform(
        array(named_struct(
            'low', if(d.score >= 0, s.b, s.low),
            'high', if(d.score <= 0, s.b, s.high),
            'newton', s.b + try_divide(d.score, d.information))),
        q -> transform(
            array(if(coalesce(q.newton BETWEEN q.low AND q.high, false), q.newton, (q.low + q.high) / 2)),
            b -> named_struct(
                'b', b, 'r', exp(b), 'low', q.low, 'high', q.high,
                'done', abs(b - s.b) <= 1e-14 * abs(b)))[0])[0])[0])"""

# Estimate and information of a model, as an array of one struct.
_SOLUTION = f"""transform(
    array(_cells),
    cells -> aggregate(
        sequence(1, {NEWTON_STEPS}),
        named_struct(
            'b', 0D, 'r', 1D, 'low', double(-{FARTHEST_ESTIMATE}), 'high', double({FARTHEST_ESTIMATE}), 'done', false),
        (s, i) -> {_STEP},
        s -> named_struct('estimate', s.b, 'information', ({_DERIVATIVES.format(r="s.r")}).information{{more}})))"""


def fit(patterns: DataFrame, by: Sequence[str], weight: str = "w", robust: bool = False) -> DataFrame:
    """Conditional log odds ratio of every group of patterns, with its standard error.

    A group holds at most a few dozen patterns, so gathering it in one row is safe. Strata whose
    days are all exposed or all unexposed carry no information. If nothing is informative, or the
    case day is always (or never) the exposed one, no finite estimate exists: the estimate is null
    and ``converged`` is false.

    ``robust`` adds ``robust_se``, the sandwich estimate with each stratum as one observation: the
    square root of the sum of (weight * score residual)**2, over the information. It needs patterns
    made with ``squares``. Limits, z and p stay with the model-based error.

    The solution is unpacked with a generator. The optimizer moves no filter on a result column
    below a generator, so the iterations are never repeated inside such a filter.
    """
    informative = "n1 > 0 AND n0 > 0"
    cell = "struct(double(xc) AS xc, double(n1) AS n1, double(n0) AS n0, w)"
    more = ""
    if robust:
        cell = f"struct(double(xc) AS xc, double(n1) AS n1, double(n0) AS n0, w, double(`{weight}#2`) AS w2)"
        more = f", 'squares', {_SQUARED_SCORES.format(r='s.r')}"
    models = (
        patterns.withColumn("w", F.expr(f"double(`{weight}`)"))
        .where("w > 0")
        .groupBy(*by)
        .agg(
            F.expr(f"array_sort(collect_list({cell}) FILTER (WHERE {informative})) AS _cells"),
            F.expr("sum(w) AS n_cases"),
            F.expr(f"coalesce(sum(w) FILTER (WHERE {informative}), 0D) AS n_informative"),
            F.expr(f"coalesce(sum(w) FILTER (WHERE {informative} AND xc = 1), 0D) AS _exposed"),
        )
        .withColumn("converged", F.expr("_exposed > 0 AND _exposed < n_informative"))
    )
    solved = models.select("*", F.expr(f"inline_outer(CASE WHEN converged THEN {_SOLUTION.format(more=more)} END)"))
    measured = solved.withColumn("std_error", F.expr("1 / sqrt(information)")).withColumn(
        "statistic", F.expr("estimate / std_error")
    )
    return measured.select(
        *by,
        "estimate",
        "std_error",
        *([F.expr("sqrt(squares) / information AS robust_se")] if robust else []),
        "statistic",
        *[c.alias(n) for n, c in odds_ratio_columns(F.col("estimate"), F.col("std_error")).items()],
        two_sided_p("statistic").alias("p_value"),
        "n_cases",
        "n_informative",
        "converged",
    )


def models(
    rows: DataFrame,
    exposures: Sequence[Exposure],
    by: Sequence[str] = (),
    weight: str = "all_deaths",
    weighted: bool = True,
    robust: bool = False,
) -> DataFrame:
    """One model per group in ``by`` and exposure, from strata (made now or stored)."""
    patterns = stratum_patterns(rows, exposures, [weight], by, weighted, robust)
    return fit(patterns, [*by, "variable", "type"], weight, robust)


def models_by_place(
    rows: DataFrame,
    exposures: Sequence[Exposure],
    place: str = "ENT_OCURR",
    by: Sequence[str] = (),
    weight: str = "all_deaths",
    weighted: bool = True,
) -> DataFrame:
    """Models of every place and of all places, from one pass over the strata."""
    patterns = stratum_patterns(rows, exposures, [weight], [place, *by], weighted)
    levels = add_overall_level(patterns, place, by, weight)
    return fit(levels, ["level", place, *by, "variable", "type"], weight)


def models_by_subgroup(
    rows: DataFrame,
    exposures: Sequence[Exposure],
    families: Mapping[str, str],
    by: Sequence[str] = (),
    weighted: bool = True,
) -> DataFrame:
    """Models of every subgroup; ``families`` maps each weight column to its family."""
    patterns = stratum_patterns(rows, exposures, list(families), by, weighted)
    long = unpivot_weights(patterns, families, by)
    return fit(long, [*by, "subgroup_type", "subgroup", "variable", "type"])


def odds_ratios(
    deaths: DataFrame,
    weather: DataFrame,
    exposures: Sequence[Exposure],
    by: Sequence[str] = (),
    weight: str = "all_deaths",
    weighted: bool = True,
    unit: str = "municipality",
    date: str = "date",
    robust: bool = False,
) -> DataFrame:
    """``models`` of deaths and weather; ``by`` are columns of the deaths table."""
    return models(strata(deaths, weather, exposures, unit, date), exposures, by, weight, weighted, robust)


def odds_ratios_by_place(
    deaths: DataFrame,
    weather: DataFrame,
    exposures: Sequence[Exposure],
    place: str = "ENT_OCURR",
    by: Sequence[str] = (),
    weight: str = "all_deaths",
    weighted: bool = True,
    unit: str = "municipality",
    date: str = "date",
) -> DataFrame:
    """``models_by_place`` of deaths and weather."""
    return models_by_place(strata(deaths, weather, exposures, unit, date), exposures, place, by, weight, weighted)


def odds_ratios_by_subgroup(
    deaths: DataFrame,
    weather: DataFrame,
    exposures: Sequence[Exposure],
    families: Mapping[str, str],
    by: Sequence[str] = (),
    weighted: bool = True,
    unit: str = "municipality",
    date: str = "date",
) -> DataFrame:
    """``models_by_subgroup`` of deaths and weather."""
    return models_by_subgroup(strata(deaths, weather, exposures, unit, date), exposures, families, by, weighted)


# Published names of the result columns that a CSV reader may expect.
PUBLISHED_NAMES = {"std_error": "std.error", "p_value": "p.value"}


def with_published_names(results: DataFrame) -> DataFrame:
    return results.withColumnsRenamed(PUBLISHED_NAMES)
