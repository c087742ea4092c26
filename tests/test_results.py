import datetime

import pytest
from pyspark.sql import functions as F

from heatstrata.operators import attribution, reports
from heatstrata.operators.columns import MissingColumns

ODDS = "ENT_OCURR string, year_period string, variable string, type string, or double, or_low double, or_high double"


def tables(spark):
    heat = spark.createDataFrame(
        [("1998-2002", "MX01001", 20), ("1998-2002", "MX01002", 10), ("1998-2002", "MX02001", 5), ("1998-2002", "MX03001", 7)],
        "year_period string, municipality string, hw_99_max_1 int",
    )
    odds = spark.createDataFrame(
        [
            ("All", "1998_2002", "hw_99_max_1", "Same Day", 9.0, 9.0, 9.0),
            ("1", "1998_2002", "hw_99_max_1", "Same Day", 1.25, 0.8, 2.0),
            ("2", "1998_2002", "hw_99_max_1", "Same Day", 0.0, None, -1.0),
            ("1", "1998_2002", "hw_99_max_1", "Lag 1 Day", 5.0, 5.0, 5.0),
        ],
        ODDS,
    )
    deaths = spark.createDataFrame(
        [("MX01001", "1998-2002", 1826), ("MX02001", "1998-2002", 100), ("MX03001", "1998-2002", 100)],
        "municipality string, year_period string, deaths_total int",
    )
    return heat, odds, deaths


def test_attributable_numbers(spark):
    rows = {r.municipality: r for r in attribution.attributable_by_municipality(*tables(spark), "hw_99_max_1").collect()}
    assert len(rows) == 4
    first = rows["MX01001"]
    assert first.PAF_point == pytest.approx(0.2) and first.PAF_lcl == pytest.approx(-0.25)
    assert first.AN_deaths_est == pytest.approx(20 * 0.2) and first.AN_deaths_est_ucl == pytest.approx(10.0)
    assert rows["MX01002"].AN_deaths_est is None  # no deaths
    assert rows["MX02001"].PAF_point is None and rows["MX02001"].OR_point == 0.0
    assert rows["MX03001"].OR_point is None  # no result


def test_state_sums_equal_municipality_sums(spark):
    heat, odds, deaths = tables(spark)
    collapsed = {
        r.ENT_OCURR: r
        for r in attribution.collapse_to_state(
            attribution.attributable_by_municipality(heat, odds, deaths, "hw_99_max_1")
        ).collect()
    }
    direct = {r.ENT_OCURR: r for r in attribution.attributable_by_state(heat, odds, deaths, ["hw_99_max_1"]).collect()}
    assert set(collapsed) == set(direct) == {1, 2, 3}
    for state in direct:
        assert direct[state].AN_deaths_est == pytest.approx(collapsed[state].AN_deaths_est)
    assert direct[3].AN_deaths_est == 0 and direct[3].n_missing_or == 1


def test_observed_days(spark):
    heat, odds, deaths = tables(spark)
    rows = attribution.attributable_by_municipality(
        heat.withColumn("observed_days", F.lit(100)), odds, deaths, "hw_99_max_1", period_length="observed"
    )
    assert rows.where("municipality = 'MX01001'").first().AN_deaths_est == pytest.approx(1826 * 0.2 * 0.2)


def test_missing_columns(spark):
    heat, odds, deaths = tables(spark)
    for broken in ((heat.drop("municipality"), odds, deaths), (heat, odds.drop("or"), deaths), (heat, odds, deaths.drop("deaths_total"))):
        with pytest.raises(MissingColumns):
            attribution.attributable_by_municipality(*broken, "hw_99_max_1")


def test_first_per_key(spark):
    _, odds, _ = tables(spark)
    twice = odds.unionByName(odds.withColumn("variable", F.lit("a"))).where("ENT_OCURR = '1'")
    rows = attribution.first_per_key(twice).collect()
    assert [(r.variable, r.type) for r in rows] == [("a", "Lag 1 Day")]


def long(spark):
    return spark.createDataFrame(
        [("SEXO", "Group_A_SEXO", "1998-2002", 3), ("SEXO", "Group_B_SEXO", "1998-2002", 1), ("SEXO", "Group_B_SEXO", "2003-2007", 5),
         ("EDAD", "Group_A_EDAD", "1998-2002", 2), ("EDAD", "Group_A_EDAD", "1990-1991", 9)],
        "subgroup_type string, subgroup string, year_period string, deaths bigint",
    )


PERIODS = ((1998, 2002), (2003, 2007))


def test_descriptive_table(spark):
    table = reports.descriptive_table(long(spark), PERIODS)
    rows = {(r.section, r.Subgroup): r for r in table.collect()}
    assert rows["TOTAL", "TOTAL"]["Total"] == 9 and rows["TOTAL", "TOTAL"]["1998-2002"] == 4
    assert rows["Age group", "Group_A_EDAD"]["Total"] == 2
    assert [r.section for r in reports.in_report_order(table, PERIODS).collect()] == ["TOTAL", "Age group", "Sex", "Sex"]
    sums = {r.section: r["Total"] for r in reports.section_totals(table, ["Total"]).collect()}
    assert sums == {"TOTAL": 9, "Sex": 9, "Age group": 2}


def test_composition_sums_to_hundred(spark):
    table = reports.section_composition(long(spark).withColumnRenamed("subgroup_type", "section"))
    for r in table.groupBy("section", "year_period").agg(F.sum("share_pct").alias("s")).collect():
        assert r.s == pytest.approx(100.0)
    empty = spark.createDataFrame([("s", "p", 0)], "section string, year_period string, deaths int")
    assert reports.section_composition(empty).first().share_pct is None


def test_divider_rows_become_sections(spark):
    rows = [(0, "— SEX —", ""), (1, "Male", "3"), (2, None, "x"), (3, "— AGE GROUP —", ""), (4, "Old", "1")]
    got = reports.label_forward(spark.createDataFrame(rows, "pos int, Subgroup string, n string"), "pos")
    assert [(r.section, r.Subgroup) for r in got.orderBy("pos").collect()] == [
        ("SEX", "Male"), ("SEX", "Unspecified"), ("AGE GROUP", "Old"),
    ]


def test_combine_sections(spark):
    sex = spark.createDataFrame([("Male", "3"), ("Female", "x")], "g string, `1998-2002` string")
    age = spark.createDataFrame([("Old", "1", "2")], "Subgroup string, `1998-2002` string, Total string")
    table = reports.combine_sections({"Sex": sex, "Age group": age})
    rows = {r.Subgroup: r for r in table.collect()}
    assert rows["Male"]["1998-2002"] == 3.0 and rows["Female"]["1998-2002"] is None and rows["Old"]["Total"] == 2.0
    with pytest.raises(ValueError):
        reports.combine_sections({})


def test_labels_pivot_densify(spark):
    results = spark.createDataFrame(
        [("SEXO", "Group_A_SEXO", "1998-2002", "hw", "Same Day", 1.5, 1.0, 2.0), ("SEXO", "Group_A_SEXO", "1998-2002", "hw", "Lag 1 Day", 2.5, 1.0, 2.0),
         ("CIVIL_STATUS", "CIVIL_DIVORCED_SEPARATED", "2003-2007", "hw", "Same Day", 3.0, 1.0, 2.0)],
        "subgroup_type string, subgroup string, year_period string, variable string, type string, or double, or_low double, or_high double",
    )
    labelled = reports.labelled_odds_ratios(results, "hw")
    assert {(r.subgroup_type, r.subgroup) for r in labelled.collect()} == {("Sex", "Male"), ("Marital status", "CIVIL_DIVORCED_SEPARATED")}
    pivoted = reports.pivot_mean(results, ["subgroup"], "year_period", "or", ["1998-2002", "2003-2007"])
    assert {r.subgroup: (r[1], r[2]) for r in pivoted.collect()} == {
        "Group_A_SEXO": (2.0, None), "CIVIL_DIVORCED_SEPARATED": (None, 3.0),
    }
    grid = reports.key_grid(labelled, ["subgroup"], "year_period", ["1998-2002", "2003-2007"])
    dense = reports.densify(labelled.select("subgroup", "year_period", "or"), grid, ["subgroup", "year_period"])
    assert dense.count() == 4 and dense.where("or IS NULL").count() == 2
    assert reports.rows_mentioning(results, "hw").count() == 3 and reports.rows_mentioning(results, "none").count() == 0


def test_heat_descriptives(spark):
    day = datetime.date(2001, 1, 1)
    rows = [(day, 30.0, 10.0, 1, 0, 0, 0, 0, 0), (day, 34.0, 12.0, 1, 1, 0, 0, 0, 0), (day, 10.0, 1.0, 0, 0, 0, 0, 0, 0)]
    flags = ", ".join(f"hw_99_{s}_{n} int" for n in (1, 2, 3) for s in ("max", "min"))
    table = reports.heat_descriptives(spark.createDataFrame(rows, f"date date, tmax_max double, tmin_max double, {flags}"))
    first = table.where("HW_definition = '99th 1-day'").first()
    assert (first.max_text, first.min_text) == ("32.00 (2.83)", "12.00 (nan)")
    assert table.where("HW_definition = '99th 3-day'").first().max_text == "nan (nan)"
