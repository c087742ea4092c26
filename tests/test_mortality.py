import datetime

import pytest
from pyspark.sql import functions as F

from heatstrata.operators import codebook, columns, mortality, quality

FIELDS = "ENT_OCURR int, MUN_OCURR int, ANIO_OCUR int, MES_OCURR int, DIA_OCURR int, CAUSA_DEF string, EDAD_AGRU int, ESCOLARIDA int, SEXO int, NACIONALID int, EDO_CIVIL int, OCUPACION int"


def records(spark, rows, extra=""):
    return spark.createDataFrame(rows, FIELDS + extra)


def test_clean_one_era(spark):
    raw = records(
        spark,
        [
            (1, 57, 2001, 5, 1, "I219", 30, 5, 1, 1, 4, 41),
            (1, 57, 2001, 2, 30, "T67", 8, 9, 3, 9, 6, 97),
            (1, 57, 2001, 5, 99, "J189", 8, 9, 3, 9, 6, 97),  # unknown day
            (1, 999, 2001, 5, 1, "J189", 8, 9, 3, 9, 6, 97),  # unknown place
            (1, 57, 2001, 5, None, None, None, None, None, None, None, None),
        ],
    )
    first, second, third = sorted(
        mortality.clean_deaths(raw, 2001).collect(), key=lambda r: (r.date_of_occurrence is None, -r.Group_F_EDAD, -r.IS_TX)
    )
    assert first.date_of_occurrence == datetime.date(2001, 5, 1)
    assert (first.IS_I, first.Group_F_EDAD, first.Group_B_ESCOLARIDA, first.Group_A_SEXO) == (1, 1, 1, 1)
    assert (first.CIVIL_DIVORCED_SEPARATED, first.Group_B_OCUPACION) == (1, 1)
    assert second.date_of_occurrence is None and second.IS_TX == 1 and second.Group_C_SEXO == 1
    assert (second.CIVIL_WIDOWED, second.Group_C_OCUPACION, second.Group_E_ESCOLARIDA) == (1, 1, 1)
    assert sum(third[c] for c in codebook.SUBGROUPS) == 0


@pytest.mark.parametrize("year", [1998, 2003, 2004, 2011, 2012, 2013, 2014, 2021, 2022])
def test_row_eras_equal_file_eras(spark, year):
    rows = [(1, 1, 2001, 1, 1, "F101", k % 32, k % 12, k % 10, k % 10, k % 10, k) for k in range(1000)]
    raw = records(spark, [r + (year,) for r in rows], ", year int")
    by_file = mortality.clean_deaths(raw, year)
    by_row = mortality.clean_deaths(raw, "YEAR")
    sums = [F.sum(c).alias(c) for c in codebook.SUBGROUPS]
    assert by_file.agg(*sums).first() == by_row.agg(*sums).first()


def test_known_codes_per_era(spark):
    """Occupation and civil codes that move between groups."""
    raw = records(spark, [(1, 1, 2001, 1, 1, "X30", 1, 1, 1, 1, 2, 11)])

    def groups(year):
        row = mortality.clean_deaths(raw, year).first()
        return {c for c in codebook.SUBGROUPS if row[c] and c.startswith(("CIVIL", "Group_A_OC", "Group_B_OC", "Group_C_OC"))}

    assert groups(2001) == {"CIVIL_MARRIED", "Group_A_OCUPACION"}
    assert groups(2008) == {"CIVIL_WIDOWED", "Group_A_OCUPACION"}
    assert groups(2012) == {"CIVIL_DIVORCED_SEPARATED", "Group_A_OCUPACION"}
    assert groups(2016) == {"CIVIL_DIVORCED_SEPARATED", "Group_C_OCUPACION"}
    assert groups(2022) == {"CIVIL_DIVORCED_SEPARATED", "Group_A_OCUPACION"}


def test_split_civil_book_and_one_spelling(spark):
    raw = records(spark, [(1, 1, 2001, 1, 1, "X30", 1, 1, 1, 1, c, 97) for c in (4, 5)])
    split = mortality.clean_deaths(raw, 2001, codebook.SPLIT_CIVIL_BOOK)
    total = split.agg(F.sum("CIVIL_SEPARATED").alias("s"), F.sum("CIVIL_DIVORCED").alias("d"), F.sum("Group_C_OCUPACION").alias("o")).first()
    assert tuple(total) == (1, 1, 0)
    merged = mortality.one_spelling(split)
    assert merged.agg(F.sum("CIVIL_DIVORCED_SEPARATED")).first()[0] == 2
    other = split.withColumnRenamed("CIVIL_DIVORCED", "CIVIL_DIVORCED_SEPERATED").drop("CIVIL_SEPARATED")
    assert "CIVIL_DIVORCED_SEPARATED" in mortality.one_spelling(other).columns
    mixed = spark.createDataFrame([(1, 0, None), (None, None, 1), (None, None, None)], "CIVIL_DIVORCED int, CIVIL_SEPARATED int, CIVIL_DIVORCED_SEPARATED int")
    assert [r[0] for r in mortality.one_spelling(mixed).select("CIVIL_DIVORCED_SEPARATED").collect()] == [1, 1, 0]


def test_families_have_thirty_subgroups():
    found = codebook.families()
    assert {k: len(v) for k, v in found.items()} == {
        "CAUSE_IS": 4, "EDAD": 6, "ESCOLARIDAD": 5, "SEXO": 3, "NACIONALIDAD": 3, "CIVIL_STATUS": 6, "OCUPACION": 3,
    }


def test_lower_case_headers_and_missing_columns(spark):
    raw = records(spark, [(1, 57, 2001, 5, 1, "I219", 30, 5, 1, 1, 4, 41)])
    assert mortality.clean_deaths(raw.toDF(*[c.lower() for c in raw.columns]), 2013).count() == 1
    with pytest.raises(columns.MissingColumns, match="SEXO"):
        mortality.clean_deaths(raw.drop("SEXO"), 2001)


DAILY = "date_of_occurrence date, ENT_OCURR int, MUN_OCURR int, Group_A_SEXO int, Group_B_SEXO int, Group_C_SEXO int"
DAY = datetime.date(2001, 5, 1)


def test_daily_sum_null_rules(spark):
    df = spark.createDataFrame([(DAY, 1, 1, 1, None, 0), (DAY, 1, 1, 2, None, 0), (None, 1, 1, 5, 1, 0)], DAILY)
    kept = {tuple(r) for r in mortality.daily_sums(df).collect()}
    assert kept == {(DAY, 1, 1, 3, None, 0), (None, 1, 1, 5, 1, 0)}
    assert {tuple(r) for r in mortality.daily_sums(df, nulls="drop").collect()} == {(DAY, 1, 1, 3, 0, 0)}
    with pytest.raises(ValueError):
        mortality.daily_sums(df, nulls="other")


def test_daily_total_null_rules(spark):
    df = mortality.with_municipality(
        spark.createDataFrame([(DAY, 1, 1, 1, None, 0), (DAY, 1, 1, 2, 1, 0), (DAY, 1, 2, 0, 0, 0)], DAILY)
    )
    assert [r.all_deaths for r in mortality.daily_total(df).collect()] == [3]
    assert [r.all_deaths for r in mortality.daily_total(df, null_mode="cell").collect()] == [4]
    assert mortality.daily_total(df, positive=False).count() == 2


def test_unpivot_keeps_sums(spark):
    df = mortality.with_municipality(spark.createDataFrame([(DAY, 1, 1, 1, 2, 0), (DAY, 1, 2, 3, 4, 5)], DAILY))
    wide = mortality.daily_subgroups(df, mortality.SEX_COLUMNS)
    long = mortality.unpivot_subgroups(wide, ["municipality", "date"])
    assert {(r.subgroup, r.s) for r in long.groupBy("subgroup").agg(F.sum("deaths").alias("s")).collect()} == {
        ("Group_A_SEXO", 4), ("Group_B_SEXO", 6), ("Group_C_SEXO", 5),
    }
    assert {r.subgroup_type for r in long.collect()} == {"SEXO"}


def test_schema_helpers(spark):
    df = spark.createDataFrame([(1, 2, 3)], "Anio int, b int, `Date Of Occurrence` int")
    assert columns.find_year_or_date(df) == ("year", "Anio")
    assert columns.find_year_or_date(df.drop("Anio")) == ("date", "Date Of Occurrence")
    with pytest.raises(columns.MissingColumns):
        columns.find_year_or_date(df.select("b"))
    twice = df.select("b", F.col("Anio").alias("b"), "Anio")
    assert columns.drop_repeated_names(twice).columns == ["b", "Anio"]
    assert columns.drop_repeated_names(twice).first().b == 2
    assert columns.reorder(df, ["b", "none"]).columns[0] == "b"
    assert columns.tidy_names(df).columns == ["anio", "b", "date of occurrence"]
    assert columns.numeric_columns(df, ["b"]) == ["Anio", "Date Of Occurrence"]
    assert columns.add_if_absent(df, {"b": F.lit(9), "c": F.lit(1)}).first().b == 2
    assert columns.columns_starting(df, "A") == ["Anio"]


def test_quality(spark):
    df = spark.createDataFrame([("a", " ", None), ("a", None, None), (None, " ", None)], "k string, x string, y string")
    row = quality.emptiness(df).first()
    assert tuple(row) == (3, 1, 2, "x,y")
    assert quality.repeated_keys(df, ["k"]).first().n_rows == 2
    assert tuple(quality.row_counts(df, ["k"]).first()) == (3, 3, 1)
    assert quality.emptiness(df.where("false")).first().n_empty_columns == 3
