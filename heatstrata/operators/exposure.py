"""Heat exposure of every municipality-day: thresholds, flags, lags, consecutive days.

All windows below partition by the unit (municipality) and order by the day, so one exchange and
one sort serve the whole chain. A partition holds one row per day of the unit: its size is set by
the calendar, not by how many observations fed the panel, so no unit can grow hot.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heatstrata.functions.dates import date_from_text
from heatstrata.functions.numbers import nan_to_null
from heatstrata.functions.periods import within_periods
from heatstrata.operators.columns import rename, require_columns

# Percentiles, absolute limits in degrees C, and study years.
QUANTILES = (99, 95, 90)
ABSOLUTE_LIMITS = (30, 35)
STUDY_YEARS = (1998, 2022)

TEMPERATURES = {"max": "tmax_max", "min": "tmin_max"}

# Columns of the exported indicator table, in order.
INDICATOR_COLUMNS = (
    "municipality", "date", "tmin_max", "vp", "prcp", "tmax_max", "date2", "year", "month",
    "hw_99_max_1", "hw_99_min_1", "hw_abs_30", "hw_abs_35", "hw_abs_30_lag1", "hw_abs_35_lag1",
    "hw_99_max_lag1", "hw_99_min_lag1", "hw_99_max_2", "hw_99_min_2", "hw_99_max_lag2", "hw_99_min_lag2",
    "hw_99_max_lag3", "hw_99_min_lag3", "hw_99_max_3", "hw_99_min_3",
    "hw_95_min_1", "hw_95_max_1", "hw_90_min_1", "hw_90_max_1",
)

# Event definitions and the flags that switch them on.
EVENTS_BY_LENGTH = {
    "99th 1-day": ("hw_99_max_1", "hw_99_min_1"),
    "99th 2-day": ("hw_99_max_2", "hw_99_min_2"),
    "99th 3-day": ("hw_99_max_3", "hw_99_min_3"),
}
EVENTS_BY_PERCENTILE = {
    "99th 1-day": ("hw_99_max_1", "hw_99_min_1"),
    "95th 1-day": ("hw_95_max_1", "hw_95_min_1"),
}


def whole_unit(unit: str, date: str):
    """All days of a unit. Ordered, although a percentile needs no order, so that the sort it
    asks for is the one the lags need as well."""
    return Window.partitionBy(unit).orderBy(date).rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )


def prepare_weather(raw: DataFrame, years: tuple[int, int] = STUDY_YEARS) -> DataFrame:
    """Raw daily weather to typed, renamed rows of the study years."""
    df = rename(raw, {"ADM2_PCODE": "municipality", "tmax": "tmax_max", "tmin": "tmin_max"})
    require_columns(df, ("municipality", "date", "tmax_max", "tmin_max"), "weather")
    if dict(df.dtypes)["date"] != "date":
        df = df.withColumn("date", date_from_text(F.col("date")))
    temps = {c: nan_to_null(F.col(c).cast("double")) for c in TEMPERATURES.values()}
    return df.where(within_periods(F.col("date"), [years])).withColumns(
        {**temps, "date2": F.col("date"), "year": F.year("date"), "month": F.month("date")}
    )


def threshold_name(quantile: int, side: str) -> str:
    return f"hwthr_{quantile}_{side}"


def flag_name(quantile: int, side: str, days: int = 1) -> str:
    return f"hw_{quantile}_{side}_{days}"


def add_thresholds(
    df: DataFrame,
    unit: str = "municipality",
    date: str = "date",
    quantiles: Sequence[int] = QUANTILES,
    temperatures: Mapping[str, str] = TEMPERATURES,
) -> DataFrame:
    """Linear-interpolated percentiles of each unit, on each of its days.

    All percentiles of one temperature come from one aggregate, so its values are counted once.
    """
    window = whole_unit(unit, date)
    shares = F.array(*[F.lit(q / 100.0) for q in quantiles])
    df = df.withColumns(
        {f"_thr_{side}": F.percentile(F.col(t), shares).over(window) for side, t in temperatures.items()}
    )
    return df.withColumns(
        {
            threshold_name(q, side): F.col(f"_thr_{side}")[i]
            for i, q in enumerate(quantiles)
            for side in temperatures
        }
    ).drop(*[f"_thr_{side}" for side in temperatures])


def unit_thresholds(
    df: DataFrame,
    unit: str = "municipality",
    quantiles: Sequence[int] = QUANTILES,
    temperatures: Mapping[str, str] = TEMPERATURES,
) -> DataFrame:
    """One row of percentiles per unit."""
    shares = F.array(*[F.lit(q / 100.0) for q in quantiles])
    found = df.groupBy(unit).agg(
        *[F.percentile(F.col(t), shares).alias(f"_thr_{side}") for side, t in temperatures.items()]
    )
    return found.select(
        unit,
        *[
            F.col(f"_thr_{side}")[i].alias(threshold_name(q, side))
            for i, q in enumerate(quantiles)
            for side in temperatures
        ],
    )


def one_row_per_unit(df: DataFrame, columns: Sequence[str], unit: str = "municipality") -> DataFrame:
    """Values that are constant within a unit, once per unit (combined before the shuffle)."""
    return df.groupBy(unit).agg(*[F.first(c).alias(c) for c in columns])


def at_least(value: Column, limit: Column) -> Column:
    """1 or 0, null when either side is unknown."""
    return (value >= limit).cast("int")


def add_relative_flags(
    df: DataFrame, quantiles: Sequence[int] = QUANTILES, temperatures: Mapping[str, str] = TEMPERATURES
) -> DataFrame:
    return df.withColumns(
        {
            flag_name(q, side): at_least(F.col(t), F.col(threshold_name(q, side)))
            for q in quantiles
            for side, t in temperatures.items()
        }
    )


def add_absolute_flags(
    df: DataFrame, temperature: str = "tmax_max", limits: Sequence[float] = ABSOLUTE_LIMITS
) -> DataFrame:
    return df.withColumns({f"hw_abs_{x}": at_least(F.col(temperature), F.lit(float(x))) for x in limits})


def add_lags(
    df: DataFrame,
    lags: Mapping[str, tuple[str, int]],
    unit: str = "municipality",
    date: str = "date",
    within: Sequence[str] = (),
    calendar: bool = False,
) -> DataFrame:
    """New columns ``name -> (column, k)``: the value k rows earlier in the unit.

    ``within`` adds keys at which a series starts anew (a period). With ``calendar`` the value
    counts only if that row lies exactly k days back; by default gaps are not looked at.
    """
    window = Window.partitionBy(unit, *within).orderBy(date)

    def lagged(column: str, k: int) -> Column:
        value = F.lag(column, k).over(window)
        if calendar:
            value = F.when(F.datediff(F.col(date), F.lag(date, k).over(window)) == k, value)
        return value

    return df.withColumns({name: lagged(*source) for name, source in lags.items()})


def all_hot(flags: Sequence[str]) -> Column:
    """1 if every flag is 1, 0 if any is 0, else null: AND in three-valued logic."""
    together = F.col(flags[0]) == 1
    for name in flags[1:]:
        together = together & (F.col(name) == 1)
    return together.cast("int")


# Lags of the exported table: name -> (flag, rows back).
INDICATOR_LAGS = {
    **{f"hw_99_{side}_lag{k}": (f"hw_99_{side}_1", k) for k in (1, 2, 3) for side in TEMPERATURES},
    **{f"hw_abs_{x}_lag1": (f"hw_abs_{x}", 1) for x in ABSOLUTE_LIMITS},
}


def add_run_flags(df: DataFrame, quantile: int = 99, lengths: Sequence[int] = (2, 3)) -> DataFrame:
    """Hot on this and the previous days; needs the lag columns of the same percentile."""
    return df.withColumns(
        {
            flag_name(quantile, side, n): all_hot(
                [flag_name(quantile, side)] + [f"hw_{quantile}_{side}_lag{k}" for k in range(1, n)]
            )
            for n in lengths
            for side in TEMPERATURES
        }
    )


def with_all_indicators(weather: DataFrame, unit: str = "municipality", date: str = "date") -> DataFrame:
    """Thresholds, all flags, lags and runs, next to the input columns."""
    df = add_thresholds(weather, unit, date)
    df = add_absolute_flags(add_relative_flags(df))
    return add_run_flags(add_lags(df, INDICATOR_LAGS, unit, date))


def heat_indicators(weather: DataFrame) -> DataFrame:
    """The exported indicator table; ``vp`` and ``prcp`` are kept where the input has them."""
    df = with_all_indicators(weather)
    return df.select(*[c for c in INDICATOR_COLUMNS if c in df.columns])


def threshold_events(
    df: DataFrame, definitions: Mapping[str, tuple[str, str]] = EVENTS_BY_LENGTH, unit: str = "municipality"
) -> DataFrame:
    """One row per day and event definition that is on for the maximum or the minimum.

    Every row carries all temperatures, thresholds and flags. The table is read once: each day is
    exploded into the definitions it meets.
    """
    flags = list(dict.fromkeys(f for pair in definitions.values() for f in pair))
    thresholds = list(dict.fromkeys(threshold_name(int(f.split("_")[1]), f.split("_")[2]) for f in flags))
    met = F.array_compact(
        F.array(
            *[
                F.when((F.col(high) == 1) | (F.col(low) == 1), F.lit(label))
                for label, (high, low) in definitions.items()
            ]
        )
    )
    return df.select(
        F.explode(met).alias("HW_definition"), unit, F.col("date").alias("date2"),
        "tmax_max", "tmin_max", *thresholds, *flags,
    )


def heat_days(df: DataFrame, keys: Sequence[str], flags: Sequence[str]) -> DataFrame:
    """Hot days per group; unknown days count 0 and rows with an unknown key go."""
    return df.na.drop(subset=list(keys)).groupBy(*keys).agg(
        *[F.coalesce(F.sum(f), F.lit(0)).alias(f) for f in flags]
    )
