import datetime
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from heatstrata.operators import crossover
from heatstrata.operators.crossover import LAG_1_DAY, Exposure, same_day

START = datetime.date(2001, 1, 1)


def simulate(seed=1, units=6, days=365, effect=0.4):
    """Random exposure days and death counts that follow a known log odds ratio."""
    rng = np.random.default_rng(seed)
    weather, deaths = [], []
    for u in range(units):
        for d in range(days):
            x = int(rng.random() < 0.2)
            date = START + datetime.timedelta(days=d)
            known = None if rng.random() < 0.03 else x
            weather.append((f"u{u}", date, known))
            n = int(rng.poisson(2.0 * math.exp(effect * x)))
            if n:
                deaths.append((u % 2, f"u{u}", date, n, int(rng.binomial(n, 0.3))))
    return weather, deaths


def frames(spark, weather, deaths):
    return (
        spark.createDataFrame(weather, "municipality string, date date, x int"),
        spark.createDataFrame(deaths, "ENT_OCURR int, municipality string, date date, all_deaths int, men int"),
    )


def brute_force(weather, deaths, weighted=True):
    """Expanded strata and a plain Newton fit, in Python."""
    by_unit = {}
    for u, d, x in weather:
        by_unit.setdefault((u, d.year, d.month, d.isoweekday()), []).append((d, x))
    strata = []
    for _, u, date, n, *_ in deaths:
        days = [(d, x) for d, x in by_unit.get((u, date.year, date.month, date.isoweekday()), []) if x is not None]
        case = [x for d, x in days if d == date]
        if case and n > 0:
            strata.append((case[0], [x for _, x in days], n if weighted else 1))
    b = 0.0
    for _ in range(50):
        score = information = 0.0
        for xc, xs, w in strata:
            total = sum(math.exp(b * x) for x in xs)
            mean = sum(x * math.exp(b * x) for x in xs) / total
            score += w * (xc - mean)
            information += w * (sum(x * x * math.exp(b * x) for x in xs) / total - mean**2)
        b += score / information
    return b, 1 / math.sqrt(information), sum(w for *_, w in strata)


@pytest.fixture(scope="module")
def data():
    return simulate()


@pytest.mark.parametrize("weighted", [True, False])
def test_collapsed_fit_equals_expanded_fit(spark, data, weighted):
    weather, deaths = frames(spark, *data)
    row = crossover.odds_ratios(deaths, weather, same_day(["x"]), weighted=weighted).first()
    b, se, n = brute_force(*data, weighted)
    assert row.estimate == pytest.approx(b, abs=1e-9)
    assert row.std_error == pytest.approx(se, abs=1e-9)
    assert row.n_cases == n and row.converged
    assert row["or_high"] == pytest.approx(math.exp(b + 1.96 * se), rel=1e-9)
    assert row.p_value == pytest.approx(math.erfc(abs(b / se) / math.sqrt(2)), rel=1e-6)


def test_recovers_known_effect(spark):
    weather, deaths = frames(spark, *simulate(seed=5, units=12, days=730, effect=0.5))
    row = crossover.odds_ratios(deaths, weather, same_day(["x"])).first()
    assert abs(row.estimate - 0.5) < 4 * row.std_error


def test_expand(spark, data):
    weather, deaths = frames(spark, *data)
    matched = crossover.expand(deaths, weather)
    assert matched.agg(F.sum("case")).first()[0] == deaths.count()
    counts = crossover.control_counts(matched)
    assert {r.n_days for r in counts.select("n_days").distinct().collect()} <= {4, 5}
    assert counts.where("n_cases <> 1 OR n_controls <> n_days - 1").count() == 0
    lonely = deaths.withColumn("municipality", F.lit("elsewhere"))
    assert crossover.expand(lonely, weather).where("case IS NULL").count() == deaths.count()
    assert crossover.odds_ratios(lonely, weather, same_day(["x"])).count() == 0


def test_levels_equal_separate_fits(spark, data):
    weather, deaths = frames(spark, *data)
    rows = crossover.odds_ratios_by_place(deaths, weather, same_day(["x"])).collect()
    found = {r.ENT_OCURR: r for r in rows}
    assert set(found) == {None, 0, 1} and found[None].level == "overall"
    assert found[None].n_cases == found[0].n_cases + found[1].n_cases
    for state in (0, 1):
        alone = crossover.odds_ratios(deaths.where(F.col("ENT_OCURR") == state), weather, same_day(["x"])).first()
        assert found[state].estimate == pytest.approx(alone.estimate, abs=1e-12)


def test_subgroups_equal_separate_fits(spark, data):
    weather, deaths = frames(spark, *data)
    rows = crossover.odds_ratios_by_subgroup(deaths, weather, same_day(["x"]), {"men": "SEXO", "all_deaths": "All"}).collect()
    found = {r.subgroup: r for r in rows}
    alone = crossover.odds_ratios(deaths, weather, same_day(["x"]), weight="men").first()
    assert found["men"].estimate == pytest.approx(alone.estimate, abs=1e-12) and found["men"].subgroup_type == "SEXO"
    assert found["all_deaths"].n_cases > found["men"].n_cases


def day(n):
    return START + datetime.timedelta(days=n)


def test_no_finite_estimate(spark):
    """Always exposed on the case day; no contrast at all; unknown exposure on the case day."""
    weather = [("u", day(7 * k), k % 2, 1, None if k == 1 else 0) for k in range(4)]
    w = spark.createDataFrame(weather, "municipality string, date date, separated int, constant int, unknown int")
    d = spark.createDataFrame([("u", day(7), 3)], "municipality string, date date, all_deaths int")
    rows = {r.variable: r for r in crossover.odds_ratios(d, w, same_day(["separated", "constant", "unknown"])).collect()}
    assert set(rows) == {"separated", "constant"}
    assert rows["separated"].n_informative == 3 and rows["constant"].n_informative == 0
    for r in rows.values():
        assert r.estimate is None and r["or"] is None and r.p_value is None and not r.converged


def test_extreme_imbalance_converges(spark):
    """One unexposed case against very many exposed ones: plain Newton steps would overshoot."""
    patterns = spark.createDataFrame([(1, 1, 4, 1e9), (0, 1, 4, 1.0)], "xc int, n1 int, n0 int, w double")
    row = crossover.fit(patterns.withColumn("g", F.lit(1)), ["g"]).first()
    # score: 1e9 = (1e9 + 1) * r / (4 + r), so r = 4e9
    assert row.estimate == pytest.approx(math.log(4e9), rel=1e-9)


def test_filter_on_results_does_not_repeat_the_fit(spark, data):
    weather, deaths = frames(spark, *data)
    results = crossover.odds_ratios(deaths, weather, same_day(["x"]))
    kept = results.where((F.col("or") > 1) & (F.col("or_low") > 0) & (F.col("p_value") < 1) & (F.col("std_error") > 0))
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("try_divide") <= 1 and kept.count() == 1


def test_published_names(spark, data):
    weather, deaths = frames(spark, *data)
    renamed = crossover.with_published_names(crossover.odds_ratios(deaths, weather, [Exposure("x", LAG_1_DAY)]))
    assert {"std.error", "p.value"} <= set(renamed.columns)
    assert renamed.first()["type"] == "Lag 1 Day"


def test_hot_unit_and_no_cartesian(spark, data):
    """A third of all deaths in one unit gives the same result; the plan has no cross product."""
    weather, deaths = data
    hot = [(0, "u0", d, n * 50, m) for _, u, d, n, m in deaths if u == "u0"]
    heavy = [x for x in deaths if x[1] != "u0"] + hot
    w, d = frames(spark, weather, heavy)
    results = crossover.odds_ratios(d, w, same_day(["x"]))
    plan = results._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    assert results.first().estimate == pytest.approx(brute_force(weather, heavy)[0], abs=1e-9)


def test_reference_value_on_given_tables(spark):
    """Region-days at the 90th percentile: a value fixed from an independent computation."""
    from workload import registry

    row = registry.QUERIES["cc_region_days"](spark, "/root/testdata/sf0.01").first()
    assert row.estimate == pytest.approx(0.025085599381468, abs=1e-6)


def test_two_rows_for_one_unit_and_day_are_an_error(spark):
    from pyspark.errors import PySparkException

    weather = spark.sql("SELECT 'u' AS municipality, explode(sequence(DATE'2001-01-01', DATE'2001-01-31')) AS date, 1 AS x")
    exposure = crossover.same_day(["x"])
    assert crossover.with_reference_counts(weather, exposure).count() == 31
    twice = weather.union(weather.limit(1))
    with pytest.raises(PySparkException, match="two rows for one unit and day"):
        crossover.with_reference_counts(twice, exposure).collect()
