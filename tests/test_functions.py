import datetime
import math

import pytest
from pyspark.sql import functions as F

from heatstrata.functions import dates, indicators, labels, numbers, odds, periods, places


def one(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_indicators_are_never_null(spark):
    rows = [("I219", 5), ("X30", 9), (None, None)]
    got = one(
        spark, rows, "c string, k int",
        indicators.prefix_flag(F.col("c"), "I"),
        indicators.member_flag(F.col("c"), ["T67", "X30"]),
        indicators.range_flag(F.col("k"), 1, 5),
        indicators.equal_flag(F.col("k"), 9),
    )
    assert got == [(1, 0, 1, 0), (0, 1, 0, 1), (0, 0, 0, 0)]


def test_sentinel_filter_keeps_null(spark):
    df = spark.createDataFrame([(99,), (1,), (None,)], "d int")
    assert {r.d for r in df.where(indicators.differs_or_null(F.col("d"), 99)).collect()} == {1, None}


def test_any_column_and_blank(spark):
    df = spark.createDataFrame([("x", 1, " "), ("y", None, None)], "a string, b int, c string")
    assert df.where(indicators.any_column_equals(df.columns, "1")).count() == 1
    assert df.where(indicators.blank_or_null(F.col("c"))).count() == 2


def test_impossible_dates_become_null(spark):
    rows = [(2001, 2, 30), (2001, 5, 1), (2001, 5, 99), (None, 5, 1)]
    got = one(spark, rows, "y int, m int, d int", dates.date_from_parts(F.col("y"), F.col("m"), F.col("d")))
    assert [r[0] for r in got] == [None, datetime.date(2001, 5, 1), None, None]


def test_text_dates(spark):
    rows = [("2001-05-01 00:00:00",), ("2001-05-01",), ("bad",), (None,)]
    got = one(spark, rows, "t string", dates.date_from_text(F.col("t")))
    assert [r[0] for r in got] == [datetime.date(2001, 5, 1)] * 2 + [None, None]


def test_layouts_by_row_and_by_column(spark):
    df = spark.createDataFrame([("13/01/2001",), ("02/03/2001",), ("01/14/2001",)], "t string")
    by_row = [r[0] for r in df.select(dates.date_from_layouts(F.col("t"))).collect()]
    assert by_row == [datetime.date(2001, 1, 13), datetime.date(2001, 3, 2), datetime.date(2001, 1, 14)]
    assert dates.column_layout(df, "t") == "dd/MM/yyyy"
    assert dates.column_layout(df.where("false"), "t") is None
    with pytest.raises(ValueError):
        dates.column_layout(spark.createDataFrame([("soon",)], "t string"), "t")


def test_weekdays_and_weeks(spark):
    days = [(datetime.date(2023, 1, d),) for d in (1, 2, 7, 8)]  # Sunday, Monday, Saturday, Sunday
    got = one(spark, days, "d date", dates.iso_weekday(F.col("d")), dates.sunday_weekday(F.col("d")), dates.week_from_january(F.col("d")))
    assert got == [(7, 1, 1), (1, 2, 1), (6, 7, 1), (7, 1, 2)]


def test_periods(spark):
    got = one(
        spark, [(1997,), (1998,), (2002,), (2022,), (2023,)], "y int",
        periods.period_of_year(F.col("y")), periods.period_of_year(F.col("y"), keep_other=True),
    )
    assert got == [(None, "1997"), ("1998-2002",) * 2, ("1998-2002",) * 2, ("2018-2022",) * 2, (None, "2023")]
    labelled = one(spark, [(" 1998_2002 ",), ("2018-2022",)], "p string", periods.normal_label(F.col("p")), periods.period_days(periods.normal_label(F.col("p"))))
    assert labelled == [("1998-2002", 1826), ("2018-2022", 1826)]


def test_places(spark):
    got = one(spark, [(1, 57), (32, 570), (None, 1)], "e int, m int", places.municipality_id(F.col("e"), F.col("m")))
    assert [r[0] for r in got] == ["MX01057", "MX32570", None]
    got = one(spark, [("MX01001",), ("MX1",), (None,)], "m string", places.state_of_id(F.col("m")))
    assert [r[0] for r in got] == [1, None, None]
    with pytest.raises(Exception, match="no state code"):
        one(spark, [("MX",)], "m string", places.state_of_id(F.col("m"), strict=True))


def test_numbers(spark):
    rows = [(" 12 ",), ("1e3",), ("abc",), ("1d",), ("NaN",), (None,)]
    got = [r[0] for r in one(spark, rows, "t string", numbers.number_or_null(F.col("t")))]
    assert got == [12.0, 1000.0, None, None, None, None]
    got = one(spark, [(1, None), (1, 2)], "a int, b int", numbers.row_sum([F.col("a"), F.col("b")]), numbers.row_sum([F.col("a"), F.col("b")], "row"))
    assert got == [(1, None), (3, 3)]
    text = one(spark, [(1.234, None)], "m double, s double", numbers.mean_sd_text(F.col("m"), F.col("s")))
    assert text == [("1.23 (nan)",)]


def test_tail_probability_matches_erfc(spark):
    zs = [0.0, 1e-9, 0.3, -1.0, 1.959963984540054, 2.8, 2.9, -5.5, 9.0, 30.0]
    got = one(spark, [(z,) for z in zs] + [(None,)], "z double", odds.two_sided_p("z"))
    for z, (p,) in zip(zs, got):
        assert p == pytest.approx(math.erfc(abs(z) / math.sqrt(2)), rel=1e-9, abs=1e-300)
    assert got[-1] == (None,)


def test_attributable_fraction(spark):
    got = [r[0] for r in one(spark, [(2.0,), (0.5,), (0.0,), (-1.0,), (None,)], "o double", odds.attributable_fraction(F.col("o")))]
    assert got == [0.5, -1.0, None, None, None]


def test_labels_fall_back(spark):
    got = one(
        spark, [("IS_I",), ("CIVIL_DIVORCED_SEPARATED",)], "s string",
        labels.relabel(F.col("s"), labels.SUBGROUP_LABELS), labels.display_order(F.col("s"), ["x", "IS_I"]),
    )
    assert got == [("Circulatory system issues", 2), ("CIVIL_DIVORCED_SEPARATED", 3)]
