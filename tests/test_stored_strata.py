"""Strata in buckets, mergeable pattern sums, robust errors."""

import datetime
import math
import random

import pytest
from pyspark.sql import functions as F

from heatstrata.operators import crossover
from heatstrata.operators.crossover import same_day
from heatstrata.plans.refresh import BatchedSums, DeathBatches, PatternBatches
from heatstrata.sources import bucketed, writers

X = same_day(["hot"])


def days_and_deaths(spark, years=(2001, 2003), units=4, seed=5):
    rng = random.Random(seed)
    days, deaths = [], []
    for u in range(units):
        day = datetime.date(years[0], 1, 1)
        while day.year <= years[1]:
            days.append((f"u{u}", day, int(rng.random() < 0.2) if rng.random() < 0.95 else None))
            if rng.random() < 0.5:
                deaths.append((f"u{u}", day, f"s{u % 2}", rng.randrange(1, 6)))
            day += datetime.timedelta(days=1)
    return (
        spark.createDataFrame(days, "municipality string, date date, hot int"),
        spark.createDataFrame(deaths, "municipality string, date date, ENT_OCURR string, all_deaths long"),
    )


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("buckets"))
    days, deaths = days_and_deaths(spark)
    days = bucketed.write_bucketed(days, f"{folder}/days", "municipality", 4, ["date"])
    deaths = bucketed.write_bucketed(deaths.withColumn("year_period", F.lit("p")), f"{folder}/deaths", "municipality", 4, ["date"], ["year_period"])
    with bucketed.joined_by_bucket(spark):
        rows = crossover.strata(crossover.one_row_a_day(deaths), days, X)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
        try:
            plan = rows._jdf.queryExecution().executedPlan().toString()
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        return folder, plan, bucketed.write_bucketed(rows, f"{folder}/strata", "municipality", 4, ["date"], ["year_period"])


def test_strata_are_made_without_a_shuffle(stored):
    _, plan, _ = stored
    assert "SortMergeJoin" in plan and "Exchange" not in plan, plan


def test_models_of_stored_strata_shuffle_only_sums(stored):
    _, _, rows = stored
    for model, most in (
        (crossover.models(rows, X, by=["year_period"]), 2),
        (crossover.models_by_place(rows, X, by=["year_period"]), 3),
        (crossover.models_by_subgroup(rows, X, {"all_deaths": "All"}, by=["year_period"]), 2),
    ):
        plan = model._jdf.queryExecution().executedPlan().toString()
        assert exchanges(model) <= most and "Join" not in plan and "Window" not in plan, plan
        below = plan[plan.rindex("Exchange hashpartitioning") :]
        assert "HashAggregate" in below, "sums are taken before the first shuffle"


def test_another_session_opens_the_buckets(spark, stored):
    folder, _, rows = stored
    other = spark.newSession()
    spark.sql(f"DROP TABLE {bucketed._table_name(f'{folder}/strata')}")
    again = bucketed.open_bucketed(other, f"{folder}/strata")
    assert sorted(again.columns) == sorted(rows.columns) and again.count() > 0
    joined = again.groupBy("municipality").count()
    assert exchanges(joined) == 0
    assert again.where("year_period = 'p'").count() == again.count()


def test_stored_and_direct_models_agree(spark, stored):
    folder, _, _ = stored
    days, deaths = days_and_deaths(spark)
    direct = crossover.odds_ratios(deaths, days, X).first()
    kept = crossover.models(bucketed.open_bucketed(spark, f"{folder}/strata"), X).first()
    assert direct.n_cases == kept.n_cases and direct.estimate == pytest.approx(kept.estimate, abs=1e-12)


def test_two_death_rows_of_a_day_are_an_error(spark):
    days, deaths = days_and_deaths(spark, (2001, 2001), 1)
    twice = deaths.union(deaths.limit(1))
    with pytest.raises(Exception, match="two death rows"):
        crossover.one_row_a_day(twice).collect()
    unknown = spark.createDataFrame([(None, None, "s", 1)] * 2, deaths.schema)
    assert crossover.one_row_a_day(unknown).count() == 2
    with pytest.raises(Exception, match="two rows for one unit"):
        crossover.strata(deaths, days.union(days.limit(1)), X).collect()


@pytest.mark.parametrize("weighted", [True, False])
def test_robust_error_equals_single_strata(spark, weighted):
    days, deaths = days_and_deaths(spark)
    fit = crossover.odds_ratios(deaths, days, X, weighted=weighted, robust=True).first()
    rows = crossover.long_strata(crossover.strata(deaths, days, X), X, ["all_deaths"]).where("n1 > 0 AND n0 > 0").collect()
    score2 = information = 0.0
    for r in rows:
        w, p = (r.all_deaths if weighted else 1), r.n1 * math.exp(fit.estimate) / (r.n0 + r.n1 * math.exp(fit.estimate))
        score2 += (w * (r.xc - p)) ** 2
        information += w * p * (1 - p)
    assert fit.robust_se == pytest.approx(math.sqrt(score2) / information, rel=1e-9)
    assert fit.std_error == pytest.approx(1 / math.sqrt(information), rel=1e-9)
    assert (abs(fit.robust_se / fit.std_error - 1) < 0.2) != weighted


def test_years_are_added_and_replaced(spark, tmp_path):
    days, deaths = days_and_deaths(spark)
    rows = crossover.strata(deaths, days, X)
    store = PatternBatches(spark, str(tmp_path / "patterns"), tuple(X), periods=((2001, 2002), (2003, 2003)))
    store.add(rows.where("year(date) <= 2002").withColumn("all_deaths", F.col("all_deaths") * 7))
    store.add(rows.where("year(date) = 2001"))
    store.add(rows.where("year(date) >= 2002"))
    whole = crossover.models(rows.withColumn("year_period", F.when(F.year("date") <= 2002, "2001-2002").otherwise("2003-2003")), X, ["year_period"], robust=True)
    got, expect = ({r.year_period: r for r in f.collect()} for f in (store.fit(), whole))
    assert set(got) == set(expect)
    for period, e in expect.items():
        for c in ("estimate", "std_error", "robust_se", "n_cases", "n_informative"):
            assert getattr(got[period], c) == pytest.approx(getattr(e, c), rel=1e-9), (period, c)


def test_refitting_reads_no_days(spark, tmp_path):
    days, deaths = days_and_deaths(spark, (2001, 2001))
    store = PatternBatches(spark, str(tmp_path / "patterns"), tuple(X))
    store.add(crossover.strata(deaths, days, X))
    assert store._sums().batches().count() <= 2 * 6 * 6
    assert str(tmp_path / "patterns") in store.fit()._jdf.queryExecution().executedPlan().toString()


def test_deaths_by_period_from_batches(spark, tmp_path):
    rows = [("A", 1, "MX1", datetime.date(y, 3, d), 1, None, 2) for y in (1999, 2000, 2004) for d in (1, 2)] + [("A", 1, None, datetime.date(2000, 1, 1), 5, 5, 5)]
    daily = spark.createDataFrame(rows, "ENT_OCURR string, MUN_OCURR int, municipality string, date date, Group_A_SEXO long, Group_B_SEXO long, Group_C_SEXO long")
    store = DeathBatches(spark, str(tmp_path / "deaths"))
    for year in (1999, 2000, 2000, 2004):
        store.add(daily.where(F.year("date") == year))
    assert {(r.year_period, r.deaths_total) for r in store.totals().collect()} == {("1998-2002", 12), ("2003-2007", 6)}


def test_a_stopped_load_is_repeated(spark, tmp_path):
    """A batch whose tasks fail changes nothing; the next try puts it there once."""
    path = str(tmp_path / "sums")
    store = BatchedSums(spark, path, ("k",), ("v",))
    good = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("b", "x", 3)], "batch string, k string, v long")
    store.add(good)
    broken = spark.range(100).select(F.when(F.col("id") < 50, "a").otherwise("c").alias("batch"), F.lit("x").alias("k"), F.expr("if(id = 77, raise_error('stopped'), id) AS v"))
    with pytest.raises(Exception, match="stopped"):
        store.add(broken)
    assert {(r.batch, r.k, r.v) for r in store.batches().collect()} == {("a", "x", 1), ("a", "y", 2), ("b", "x", 3)}
    for _ in range(2):
        store.add(spark.createDataFrame([("a", "x", 5)], good.schema))
    assert {(r.k, r.v) for r in store.merged().collect()} == {("x", 8)}
    sent = spark.createDataFrame([("a", "x", 5), ("b", "x", 3)], good.schema)
    assert writers.unequal_batches(sent, store.batches()).collect() == []
    assert [r.batch for r in writers.unequal_batches(good, store.batches()).collect()] == ["a"]
