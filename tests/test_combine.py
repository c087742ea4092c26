"""Date layouts by file, the combined and split yearly files, labels carried over blocks."""

import random

import pytest
from pyspark.sql import functions as F

from heatstrata.functions import dates
from heatstrata.operators import reports
from heatstrata.operators.columns import MissingColumns
from heatstrata.plans.combine import combine_and_split
from heatstrata.sources import readers


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return str(path)


def test_layouts_are_chosen_by_file(spark):
    rows = [("iso", "2001-05-06"), ("dm", "03/04/2001"), ("dm", "25/12/2001"), ("md", "03/04/2001"), ("md", "12/25/2001"), ("md", None), ("bad", "?"), ("none", None)]
    df = spark.createDataFrame(rows, "f string, d string")
    votes = dates.layout_votes(df, "d", "f")
    most = {r.f: r.layout for r in dates.chosen_layout(votes, "f").collect()}
    assert most == {"iso": "yyyy-MM-dd", "dm": "dd/MM/yyyy", "md": "MM/dd/yyyy", "bad": None, "none": None}
    first = {r.f: r.layout for r in dates.chosen_layout(votes, "f", "first").collect()}
    assert first["md"] == "dd/MM/yyyy" and first["dm"] == "dd/MM/yyyy" and first["bad"] is None
    read = dates.dates_by_group(df, "d", "f", dates.chosen_layout(votes, "f"))
    got = sorted((r.f, str(r.d)) for r in read.collect())
    assert got == [("bad", "None"), ("dm", "2001-04-03"), ("dm", "2001-12-25"), ("iso", "2001-05-06"), ("md", "2001-03-04"), ("md", "2001-12-25"), ("md", "None"), ("none", "None")]
    with pytest.raises(ValueError):
        dates.chosen_layout(votes, "f", "last")


def test_votes_of_parts_add_up(spark):
    df = spark.createDataFrame([("a", "01/02/2001"), ("a", "13/02/2001")], "f string, d string")
    parts = dates.layout_votes(df.limit(1), "d", "f").union(dates.layout_votes(df.subtract(df.limit(1)), "d", "f"))
    merged = parts.groupBy("f").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("fits")[i]) for i in range(4)]).alias("fits"))
    assert merged.first().n == 2 and dates.chosen_layout(merged, "f").first().layout == "dd/MM/yyyy"


def test_values_are_tried_once(spark):
    rows = [("a", "13/02/2001")] * 5 + [("a", "01/02/2001")] * 3 + [("a", None), ("b", None), (None, "2001-02-03")]
    votes = dates.layout_votes(spark.createDataFrame(rows, "f string, d string"), "d", "f")
    at = {x: i for i, x in enumerate(dates.DATE_LAYOUTS)}
    got = {r.f: (r.n, r.fits[at["dd/MM/yyyy"]], r.fits[at["MM/dd/yyyy"]], r.fits[at["yyyy-MM-dd"]]) for r in votes.collect()}
    assert got == {"a": (8, 8, 3, 0), "b": (0, 0, 0, 0), None: (1, 0, 0, 1)}
    inner = votes._jdf.queryExecution().optimizedPlan().toString().split("Aggregate [")
    assert len(inner) == 3 and "gettimestamp" in inner[1] and "gettimestamp" not in inner[2]


def test_dates_are_read_once(spark):
    df = spark.createDataFrame([("a", "13/02/2001"), ("b", "?")], "f string, d string")
    layouts = spark.createDataFrame([("a", "dd/MM/yyyy"), ("b", None)], "f string, layout string")
    dated = dates.dates_by_group(df, "d", "f", layouts)
    later = dated.where((F.year("d") > 2000) & (F.year("d") < 2010)).withColumn("m", F.month("d"))
    assert later._jdf.queryExecution().optimizedPlan().toString().count("gettimestamp") == len(dates.DATE_LAYOUTS)
    assert dated.columns == ["f", "d"] and [(r.f, str(r.d), r.m) for r in later.collect()] == [("a", "2001-02-13", 2)]


def test_headers_are_found_without_python(spark, tmp_path):
    put(tmp_path / "1.csv", "a,b\n" + "1,2\n" * 1000)
    put(tmp_path / "2.csv", "b,a\n")
    found = readers.header_catalogue(spark, str(tmp_path))
    assert "InArrow" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(readers.headers_by_file(spark, str(tmp_path)).values()) == [("a", "b"), ("b", "a")]


def test_combine_and_split(spark, tmp_path):
    a = put(tmp_path / "1.csv", "date_of_occurrence,ENT_OCURR,MUN_OCURR,IS_I\n1998-01-31,1,2,1\n2003-01-01,1,2,0\n1950-01-01,1,1,1\nbad,1,1,1\n")
    b = put(tmp_path / "2.csv", "IS_I,MUN_OCURR,ENT_OCURR,Date_of_Occurrence,EXTRA\n9.0,4,3,01/31/1999,q\nx,4,3,02/03/1999,r\n")
    out = str(tmp_path / "out")
    split = combine_and_split(spark, [a, b], out)
    rows = {(str(r.DATE_OF_OCCURRENCE), r.ENT_OCURR, r.IS_I, r.EXTRA, r.year_period) for r in split.collect()}
    assert rows == {
        ("1998-01-31", 1, 1, None, "1998-2002"), ("2003-01-01", 1, 0, None, "2003-2007"),
        ("1999-01-31", 3, 9, "q", "1998-2002"), ("1999-02-03", 3, None, "r", "1998-2002"),
    }
    assert spark.read.parquet(f"{out}/combined").count() == 6
    assert {(r.file[-5:], r.n_rows, r.n_misfits) for r in spark.read.parquet(f"{out}/misfits").collect()} == {("1.csv", 4, 0), ("2.csv", 2, 1)}
    assert {(r._file[-5:], r.layout, r.n) for r in spark.read.parquet(f"{out}/layouts").collect()} == {("1.csv", "yyyy-MM-dd", 4), ("2.csv", "MM/dd/yyyy", 2)}


def test_a_year_column_goes_first(spark, tmp_path):
    a = put(tmp_path / "1.csv", "date_of_occurrence,anio,ENT_OCURR\n?,1998.0,1\n2003-01-01,1999,2\n2003-01-01,,3\n")
    split = combine_and_split(spark, [a], str(tmp_path / "out"))
    assert {(r.ENT_OCURR, r.year_period) for r in split.collect()} == {(1, "1998-2002"), (2, "1998-2002")}


def test_nothing_to_split_by(spark, tmp_path):
    bad = put(tmp_path / "1.csv", "date_of_occurrence,ENT_OCURR\n?,1\n??,2\n")
    with pytest.raises(ValueError, match="no date"):
        combine_and_split(spark, [bad], str(tmp_path / "out"))
    with pytest.raises(MissingColumns):
        combine_and_split(spark, [put(tmp_path / "2.csv", "ENT_OCURR\n1\n")], str(tmp_path / "out2"))


def brute_carry(rows):
    last, out = {}, []
    for f, b, p, v in sorted(rows, key=lambda r: r[:3]):
        last[f] = v if v is not None else last.get(f)
        out.append((f, b, p, last[f]))
    return out


def test_labels_are_carried_over_blocks(spark):
    rng = random.Random(4)
    rows = []
    for f in ("x", "y", "z"):
        p = 0
        for b in range(0, 40, 4):
            for _ in range(rng.choice([1, 1, 30])):
                p += 1
                rows.append((f, b, p, rng.choice([None, None, None, None, f"{f}{p}"]) if f != "z" else None))
    df = spark.createDataFrame(rows, "_file string, _block long, _row long, v string").repartition(5)
    carried = reports.carry_forward(df, F.col("v"), "label")
    got = sorted(((r._file, r._block, r._row, r.label) for r in carried.collect()), key=lambda r: r[:3])
    assert got == brute_carry(rows)
    plan = carried._jdf.queryExecution().executedPlan().toString()
    assert "Exchange SinglePartition" not in plan


def test_labels_by_position_alone(spark, monkeypatch):
    monkeypatch.setattr(reports, "SEGMENT_ROWS", 7)
    rows = [(i, f"— S{i} —" if i % 20 == 0 else None if i % 9 == 0 else f"r{i}") for i in range(200)]
    got = {r.pos: (r.section, r.Subgroup) for r in reports.label_forward(spark.createDataFrame(rows, "pos long, Subgroup string"), "pos").collect()}
    assert got == {i: (f"S{i - i % 20}", "Unspecified" if t is None else t) for i, t in rows if i % 20}
