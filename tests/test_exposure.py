import datetime
import itertools

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from heatstrata.operators import exposure
from heatstrata.operators.columns import MissingColumns

START = datetime.date(2001, 1, 1)
RAW = "ADM2_PCODE string, date string, tmin double, tmax double"


def weather(spark, series):
    """unit -> list of (day offset, tmin, tmax)"""
    rows = [
        (unit, str(START + datetime.timedelta(days=d)), low, high) for unit, days in series.items() for d, low, high in days
    ]
    return exposure.prepare_weather(spark.createDataFrame(rows, RAW))


def panel(seed=0, n=60):
    rng = np.random.default_rng(seed)
    return {u: [(i, float(rng.integers(5, 15)), float(rng.integers(20, 40))) for i in range(n)] for u in ("MX01001", "MX09002")}


def test_prepare_drops_bad_dates_and_unknowns(spark):
    raw = spark.createDataFrame(
        [("a", "2001-05-01 00:00:00", 1.0, float("nan")), ("a", "bad", 1.0, 2.0), ("a", "1990-01-01", 1.0, 2.0)], RAW
    )
    (row,) = exposure.prepare_weather(raw).collect()
    assert row.tmax_max is None and row.year == 2001 and row.municipality == "a"
    with pytest.raises(MissingColumns):
        exposure.prepare_weather(raw.drop("tmin"))


def test_thresholds_equal_linear_quantile(spark):
    series = panel()
    rows = exposure.add_thresholds(weather(spark, series)).select("municipality", "hwthr_99_max", "hwthr_90_min").distinct().collect()
    for r in rows:
        highs = pd.Series([h for _, _, h in series[r.municipality]])
        lows = pd.Series([x for _, x, _ in series[r.municipality]])
        assert r.hwthr_99_max == pytest.approx(highs.quantile(0.99), abs=1e-9)
        assert r.hwthr_90_min == pytest.approx(lows.quantile(0.90), abs=1e-9)
    grouped = exposure.unit_thresholds(weather(spark, series)).collect()
    assert {r.municipality: r.hwthr_99_max for r in grouped} == {r.municipality: r.hwthr_99_max for r in rows}


def test_indicators_against_pandas(spark):
    """The whole table against an independent pandas computation, with gaps and unknown values."""
    series = panel(3, 120)
    series["MX01001"] = [(d, None if d % 17 == 0 else low, float("nan") if d % 23 == 0 else high) for d, low, high in series["MX01001"] if d % 7]
    got = exposure.heat_indicators(weather(spark, series)).toPandas().sort_values(["municipality", "date"])
    for unit, days in series.items():
        df = pd.DataFrame(days, columns=["d", "tmin", "tmax"]).astype(float)
        mine = got[got.municipality == unit].reset_index(drop=True)
        for q, side in itertools.product((99, 95, 90), ("max", "min")):
            t = df["t" + side]
            want = (t >= t.quantile(q / 100)).astype(float).where(t.notna())
            assert mine[f"hw_{q}_{side}_1"].astype(float).equals(want), (unit, q, side)
            if q == 99:
                for k in (1, 2, 3):
                    assert mine[f"hw_99_{side}_lag{k}"].astype(float).equals(want.shift(k))
                runs = {2: [want, want.shift(1)], 3: [want, want.shift(1), want.shift(2)]}
                for n, parts in runs.items():
                    block = pd.concat(parts, axis=1)
                    expected = [1.0 if (r == 1).all() else 0.0 if (r == 0).any() else np.nan for r in block.to_numpy()]
                    assert mine[f"hw_99_{side}_{n}"].astype(float).equals(pd.Series(expected)), (unit, n, side)
        absolute = (df.tmax >= 30).astype(float).where(df.tmax.notna())
        assert mine["hw_abs_30"].astype(float).equals(absolute)
        assert mine["hw_abs_30_lag1"].astype(float).equals(absolute.shift(1))


def test_exported_columns(spark):
    df = weather(spark, panel())
    assert exposure.heat_indicators(df).columns == [c for c in exposure.INDICATOR_COLUMNS if c not in ("vp", "prcp")]
    full = df.withColumns({"vp": F.lit(1.0), "prcp": F.lit(0.0)})
    assert exposure.heat_indicators(full).columns == list(exposure.INDICATOR_COLUMNS)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.sampled_from([0, 1, None]), min_size=3, max_size=3))
def test_run_logic(spark, flags):
    df = spark.createDataFrame([tuple(flags)], "a int, b int, c int")
    got = df.select(exposure.all_hot(["a", "b", "c"])).first()[0]
    assert got == (0 if 0 in flags else None if None in flags else 1)


def test_lag_kinds(spark):
    df = weather(spark, {"u": [(0, 1.0, 1.0), (1, 1.0, 2.0), (4, 1.0, 3.0), (400, 1.0, 4.0)]}).withColumn("p", F.year("date"))
    lag = {"x": ("tmax_max", 1)}

    def values(**how):
        return [r.x for r in exposure.add_lags(df, lag, **how).orderBy("date").collect()]

    assert values() == [None, 1.0, 2.0, 3.0]
    assert values(calendar=True) == [None, 1.0, None, None]
    assert values(within=["p"]) == [None, 1.0, 2.0, None]


def test_events_carry_all_flags(spark):
    df = exposure.with_all_indicators(weather(spark, panel(5)))
    events = exposure.threshold_events(df)
    for label, (high, low) in exposure.EVENTS_BY_LENGTH.items():
        assert events.where(F.col("HW_definition") == label).count() == df.where((F.col(high) == 1) | (F.col(low) == 1)).count()
    assert events.where(F.col("hw_99_max_1").isNull()).count() == 0
    one = exposure.one_row_per_unit(events, ["hwthr_99_max"])
    assert one.count() == 2


def test_period_sums_compose(spark):
    df = exposure.with_all_indicators(weather(spark, panel(7, 800)))
    df = df.withColumn("p", F.when(F.col("year") <= 2001, "a").otherwise("b"))
    flags = ["hw_99_max_1", "hw_abs_30", "hw_99_max_2"]
    direct = exposure.heat_days(df, ["p", "municipality"], flags)
    yearly = exposure.heat_days(df, ["year", "municipality"], flags).withColumn("p", F.when(F.col("year") <= 2001, "a").otherwise("b"))
    twice = exposure.heat_days(yearly, ["p", "municipality"], flags)
    assert {tuple(r) for r in direct.collect()} == {tuple(r) for r in twice.collect()}
    assert exposure.heat_days(df.withColumn("p", F.lit(None).cast("string")), ["p"], flags).count() == 0


def test_one_exchange_and_one_sort_for_the_whole_chain(spark):
    """Thresholds, flags, lags, runs and reference counts need one shuffle by unit."""
    from heatstrata.operators import crossover

    df = spark.range(10).selectExpr(
        "CAST(id AS STRING) AS municipality", "date'2001-01-01' AS date", "CAST(id AS DOUBLE) AS tmax_max", "CAST(id AS DOUBLE) AS tmin_max"
    )
    plan = exposure.with_all_indicators(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert plan.count("Sort [") == 1
    counted = crossover.with_reference_counts(exposure.with_all_indicators(df), crossover.same_day(["hw_99_max_1"]))
    assert counted._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
