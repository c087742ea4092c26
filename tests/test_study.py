"""A whole study from yearly CSV files, on a small made-up fixture."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from heatstrata.operators import crossover
from heatstrata.plans.heat_study import HeatStudy
from heatstrata.sources.schemas import WEATHER_RAW
from heatstrata.sources import readers

HEADER = "ENT_OCURR,MUN_OCURR,DIA_OCURR,MES_OCURR,ANIO_OCUR,CAUSA_DEF,EDAD_AGRU,ESCOLARIDA,SEXO,NACIONALID,EDO_CIVIL,OCUPACION"


@pytest.fixture(scope="module")
def study(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("study")
    rng = np.random.default_rng(11)
    weather = ["ADM2_PCODE,date,tmin,tmax,vp,prcp"]
    paths = []
    for year in (2001, 2002, 2003):
        rows = [HEADER if year != 2002 else HEADER.lower()]
        for k in range(365):
            day = datetime.date(year, 1, 1) + datetime.timedelta(days=k)
            for state, place in ((1, 1), (1, 2), (9, 2)):
                low, high = rng.normal(12, 4), rng.normal(28, 5)
                weather.append(f"MX{state:02d}{place:03d},{day} 00:00:00,{low:.3f},{high:.3f},1.0,0.0")
                for _ in range(rng.poisson(1.5 if high < 36 else 2.5)):
                    codes = ",".join(str(int(rng.integers(1, n))) for n in (31, 10, 3, 3, 7, 60))
                    cause = ("I219", "J189", "F101", "X30", "")[int(rng.integers(0, 5))]
                    rows.append(f"{state},{place},{day.day},{day.month},{year},{cause},{codes}")
        path = folder / f"year={year}" / "deaths.csv"
        path.parent.mkdir()
        path.write_text("\n".join(rows) + "\n")
        paths.append(str(path))
    (folder / "weather.csv").write_text("\n".join(weather) + "\n")
    made = HeatStudy(spark, str(folder / "out"), periods=((2001, 2002), (2003, 2003)))
    return made, made.run(paths, readers.read_csv(spark, str(folder / "weather.csv"), WEATHER_RAW))


def test_all_tables(study):
    _, tables = study
    for name, df in tables.items():
        assert df.count() > 0, name
    assert tables["odds_battery"].count() == 2 * 24
    assert tables["odds_by_subgroup"].select("subgroup").distinct().count() >= 20


def test_tables_agree(study):
    _, t = study
    deaths = t["deaths_daily"].agg(F.sum("Group_A_SEXO") + F.sum("Group_B_SEXO") + F.sum("Group_C_SEXO")).first()[0]
    assert t["deaths_period"].agg(F.sum("deaths_total")).first()[0] == deaths
    assert t["descriptive"].where("section = 'TOTAL'").first()["Total"] == deaths
    by_place = t["attributable_municipality"].agg(F.sum("AN_deaths_est")).first()[0]
    by_state = t["attributable_state"].where("hw_definition = 'hw_99_max_1'").agg(F.sum("AN_deaths_est")).first()[0]
    assert by_place == pytest.approx(by_state)
    key = ["year_period", "variable"]
    all_results = t["odds_by_state"].where("level = 'overall' AND type = 'Same Day'").select(*key, F.col("estimate").alias("a"))
    battery = t["odds_battery"].where("type = 'Same Day'").select(*key, F.col("estimate").alias("b"))
    for r in all_results.join(battery, key).collect():
        assert (r.a is None and r.b is None) or r.a == pytest.approx(r.b, abs=1e-12)


def test_models_read_only_needed_columns(study):
    made, _ = study
    days = made.read("heat_indicators").drop("year_period")
    deaths = made.read("deaths_daily").select("municipality", "date", F.col("Group_A_SEXO").alias("all_deaths"))
    plan = crossover.odds_ratios(deaths, days, crossover.same_day(["hw_99_max_1"]))._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<municipality:string,date:date,hw_99_max_1:int>" in plan
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_misfits_of_a_file_are_stored(spark, tmp_path):
    path = tmp_path / "year=2001" / "d.csv"
    path.parent.mkdir()
    path.write_text(HEADER + "\n1,1,5,1,2001,I219,1,1,1,1,1,1\n1,1,5,1,2001,I219,1,1,x,1,1,\"9,0\"\n")
    made = HeatStudy(spark, str(tmp_path / "out"), periods=((2001, 2001),))
    made.deaths([str(path)])
    assert [(r.n_rows, r.n_misfits) for r in made.read("deaths_misfits").collect()] == [(2, 2)]


def test_entering_the_study_in_the_middle(spark, study, tmp_path):
    """Exported day sums, indicators and odds ratios give what the whole run gave."""
    made, tables = study
    from heatstrata.operators.exposure import INDICATOR_COLUMNS
    from heatstrata.sources import writers

    exported = {n: str(tmp_path / n) for n in ("deaths", "heat", "odds")}
    writers.write_csv(tables["deaths_daily"].drop("municipality", "date", "year_period"), exported["deaths"])
    writers.write_csv(tables["heat_indicators"].select(*INDICATOR_COLUMNS), exported["heat"])
    published = crossover.with_published_names(tables["odds_by_state"])
    state = F.when(F.col("level") == "overall", F.lit("All")).otherwise(F.col("ENT_OCURR").cast("string"))
    writers.write_csv(published.withColumn("ENT_OCURR", state).drop("level"), exported["odds"])
    later = HeatStudy(spark, str(tmp_path / "out"), periods=made.periods)
    later.enter_deaths(exported["deaths"])
    later.enter_heat(exported["heat"])
    later.strata()
    models = later.odds_ratios()
    key = ["year_period", "variable", "type"]
    both = tables["odds_battery"].select(*key, F.col("estimate").alias("a"), "n_cases").join(models["odds_battery"].select(*key, F.col("estimate").alias("b"), F.col("n_cases").alias("m")), key)
    rows = both.collect()
    assert len(rows) == tables["odds_battery"].count()
    assert all(r.n_cases == r.m and (r.a == r.b or r.a == pytest.approx(r.b, abs=1e-9)) for r in rows)
    later.enter_odds(exported["odds"])
    by_state = later.attributable()["attributable_state"]
    a, b = (sorted((r.ENT_OCURR, r.year_period, r.hw_definition, round(r.AN_deaths_est, 6)) for r in t.collect()) for t in (by_state, tables["attributable_state"]))
    assert a == b
