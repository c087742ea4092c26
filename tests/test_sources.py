import os

import pytest
from pyspark.sql import functions as F

from heatstrata.sources import readers, schemas, writers
from heatstrata.sources.work_folder import work_folder


def write_text(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return str(path)


def test_types_go_by_name(spark, tmp_path):
    path = write_text(tmp_path / "w.csv", "tmax,ADM2_PCODE,note,date,tmin\n30.5,MX01001,a,2001-05-01,x\n")
    df = readers.read_csv(spark, path, schemas.WEATHER_RAW)
    row = df.first()
    assert (row.tmax, row.ADM2_PCODE, row.note, row.tmin) == (30.5, "MX01001", "a", None)
    assert readers.read_wanted(spark, path, ["tmax", "vp", "date"], schemas.WEATHER_RAW).columns == ["tmax", "date"]


def test_years_with_drifting_headers(spark, tmp_path):
    a = write_text(tmp_path / "year=2012" / "a.csv", "ENT_OCURR,MUN_OCURR\n1,2\n")
    b = write_text(tmp_path / "year=2013" / "b.csv", "mun_ocurr,ent_ocurr,EXTRA\n3,4,z\n")
    c = write_text(tmp_path / "year=2014" / "c.csv", "ENT_OCURR,MUN_OCURR\n5,bad\n")
    with pytest.raises(FileNotFoundError):
        readers.read_years(spark, [a, b, c, str(tmp_path / "none.csv")], schemas.DEATHS_RAW)
    skipped: list[str] = []
    df = readers.read_years(spark, [a, b, c, str(tmp_path / "none.csv")], schemas.DEATHS_RAW, tag="path", skipped=skipped)
    assert skipped == [str(tmp_path / "none.csv")]
    got = {(readers_year, r.ENT_OCURR, r.MUN_OCURR, r.EXTRA) for r in df.withColumn("y", readers.year_in_path("path")).collect() for readers_year in [r.y]}
    assert got == {(2012, 1, 2, None), (2013, 4, 3, "z"), (2014, 5, None, None)}
    with pytest.raises(FileNotFoundError):
        readers.read_years(spark, [str(tmp_path / "none.csv")], schemas.DEATHS_RAW)


def test_period_from_name(spark, tmp_path):
    for label, n in (("1998_2002", 1), ("2003_2007", 2)):
        write_text(tmp_path / f"combined_sum_{label}.csv", f"ENT_OCURR,MUN_OCURR\n{n},1\n")
    df = readers.read_period_files(spark, str(tmp_path), schemas.DEATHS_DAILY)
    assert {(r.ENT_OCURR, r.year_period) for r in df.collect()} == {(1, "1998-2002"), (2, "2003-2007")}


def test_sections_skip_absent(spark, tmp_path):
    write_text(tmp_path / "Sex" / "s.csv", "Subgroup,Total\nMale,3\n")
    with pytest.raises(FileNotFoundError):
        readers.read_sections(spark, str(tmp_path), ["Sex", "Occupation"])
    absent: list[str] = []
    found = readers.read_sections(spark, str(tmp_path), ["Sex", "Occupation"], skipped=absent)
    assert absent == ["Occupation"] and list(found) == ["Sex"] and found["Sex"].first().Total == "3"


def test_files_of_a_folder_are_matched_by_their_own_headers(spark, tmp_path):
    write_text(tmp_path / "y" / "a.csv", "ENT_OCURR,MUN_OCURR,SEXO\n1,2,1\n")
    write_text(tmp_path / "y" / "b.csv", "MUN_OCURR,SEXO,ENT_OCURR\n4,2,3\n")
    expected = {(1, 2, 1), (3, 4, 2)}
    read = lambda df: {(r.ENT_OCURR, r.MUN_OCURR, r.SEXO) for r in df.collect()}
    assert read(readers.read_csv(spark, str(tmp_path / "y"), schemas.DEATHS_RAW)) == expected
    assert read(readers.read_csv(spark, str(tmp_path / "y" / "*.csv"), schemas.DEATHS_RAW)) == expected
    assert read(readers.read_years(spark, [str(tmp_path / "y")], schemas.DEATHS_RAW)) == expected
    write_text(tmp_path / "p" / "combined_sum_1998_2002.csv", "date_of_occurrence,ENT_OCURR,MUN_OCURR\n2001-01-05,9,1\n")
    write_text(tmp_path / "p" / "combined_sum_2003_2007.csv", "MUN_OCURR,ENT_OCURR,date_of_occurrence\n2,8,2004-01-05\n")
    rows = readers.read_period_files(spark, str(tmp_path / "p"), schemas.DEATHS_DAILY).collect()
    assert {(r.ENT_OCURR, r.MUN_OCURR, str(r.date_of_occurrence), r.year_period) for r in rows} == {
        (9, 1, "2001-01-05", "1998-2002"), (8, 2, "2004-01-05", "2003-2007"),
    }


def test_whole_numbers_written_as_floats(spark, tmp_path):
    path = write_text(tmp_path / "f.csv", "ENT_OCURR,MUN_OCURR\n9.0,2\n1.5,x\n,3\n")
    rows = readers.read_csv(spark, path, schemas.DEATHS_RAW, misfits="lost").collect()
    assert [(r.ENT_OCURR, r.MUN_OCURR, r.lost) for r in rows] == [(9, 2, 0), (None, None, 2), (None, 3, 0)]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "1998-2002"), (2, "2003-2007")], "n int, year_period string")
    path = str(tmp_path / "t")
    writers.write_by_period(df, path)
    assert {d for d in os.listdir(path) if d.startswith("year_period")} == {"year_period=1998-2002", "year_period=2003-2007"}
    assert writers.count_written(df, path) == 2
    one = spark.read.parquet(path).where(F.col("year_period") == "1998-2002")
    assert "PartitionFilters: [isnotnull(year_period" in one._jdf.queryExecution().executedPlan().toString()
    writers.write_table(df, path)
    assert writers.count_written(df, path) == 2
    csv = str(tmp_path / "c")
    writers.append_csv(df, csv)
    writers.append_csv(df, csv)
    assert spark.read.option("header", True).csv(csv).count() == 4
    writers.write_csv(df, csv)
    assert spark.read.option("header", True).csv(csv).count() == 2


def test_work_folder_is_below_the_shared_one(spark):
    base = spark.conf.get("spark.checkpoint.dir")
    first, second = work_folder(spark), work_folder(spark)
    assert first.startswith(base) and first != second


def jobs_of(spark, action):
    """How many jobs an action runs."""
    group = f"count-{os.urandom(4).hex()}"
    spark.sparkContext.setJobGroup(group, group)
    try:
        action()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext._jsc.clearJobGroup()


def test_headers_of_all_files_in_one_job(spark, tmp_path):
    for n in (3, 40):
        folder = tmp_path / f"n{n}"
        for i in range(n):
            write_text(folder / f"year={2000 + i}" / "a b.csv", ("ENT_OCURR,MUN_OCURR" if i % 2 else "MUN_OCURR,ENT_OCURR") + f"\n{i},{i}\n" * 3)
        write_text(folder / "year=1999" / "empty.csv", "")
        names = readers.headers_by_file(spark, str(folder))
        assert len(names) == n and set(names.values()) == {("ENT_OCURR", "MUN_OCURR"), ("MUN_OCURR", "ENT_OCURR")}
        # Spark lists more than 32 folders by a job of its own.
        assert jobs_of(spark, lambda: readers.headers_by_file(spark, str(folder))) <= 1 + (n > 32)  # noqa: B023
        assert readers.read_years(spark, [str(folder)], schemas.DEATHS_RAW).count() == 3 * n


def test_a_header_is_found_in_its_first_block_only(spark, tmp_path):
    path = write_text(tmp_path / "long.csv", "ENT_OCURR,MUN_OCURR\n" + "1,2\n" * 20_000)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        assert list(readers.headers_by_file(spark, path).values()) == [("ENT_OCURR", "MUN_OCURR")]
        rows = readers.with_place_in_file(spark, path, ["ENT_OCURR", "MUN_OCURR"])
        assert rows.select("_block").distinct().count() > 1 and rows.count() == 20_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_header_names_as_spark_reads_them(spark, tmp_path):
    for i, line in enumerate(('"a,b",c', "﻿x,y", "a,,b", "a,A,b,a", ' a ,b', '"q\\"r",s')):
        path = write_text(tmp_path / str(i) / "h.csv", line + "\n" + "1," * (line.count(",") + 1) + "\n")
        assert list(readers.headers_by_file(spark, path).values()) == [tuple(readers.header_names(spark, path))], line


def test_misfits_are_counted_by_file(spark, tmp_path):
    write_text(tmp_path / "year=2001" / "a.csv", 'ENT_OCURR,SEXO\n1,"9,0"\n2,9.0\nx,y\n')
    write_text(tmp_path / "year=2002" / "b.csv", "SEXO,ENT_OCURR\n1,2\n")
    rows = readers.read_years(spark, [str(tmp_path)], schemas.DEATHS_RAW, tag="path", misfits="lost")
    got = {(r.file[-6:-4], r.n_rows, r.n_misfits) for r in readers.misfits_by_file(rows, "path", "lost").collect()}
    assert got == {("/a", 3, 3), ("/b", 1, 0)}


def test_sections_in_one_table(spark, tmp_path):
    write_text(tmp_path / "r" / "Sex + age" / "s.csv", "Sex,Total\nMale,3\n,x\n")
    write_text(tmp_path / "r" / "Cause" / "c.csv", "Cause,1998,Total\nCirculatory,1,2\n")
    absent: list[str] = []
    got = readers.read_section_table(spark, str(tmp_path / "r"), ["Sex + age", "Cause", "Nation"], absent=absent)
    rows = {(r.section, r.Subgroup, r.Total, r["1998"]) for r in got.collect()}
    assert rows == {("Sex + age", "Male", 3.0, None), ("Sex + age", None, None, None), ("Cause", "Circulatory", 2.0, 1.0)} and absent == ["Nation"]
    with pytest.raises(FileNotFoundError):
        readers.read_section_table(spark, str(tmp_path / "r"), ["Cause", "Nation"])


def test_a_csv_load_that_is_repeated_is_there_once(spark, tmp_path):
    path = str(tmp_path / "csv")
    df = spark.createDataFrame([(1, "x"), (2, "y"), (2, "z")], "batch int, v string")
    for part in (df, df.where("batch = 2"), df.where("batch = 2").union(spark.createDataFrame([(3, "w")], df.schema))):
        writers.replace_batches(part, path, kind="csv")
    back = spark.read.option("header", True).schema("v string, batch int").csv(path)
    assert sorted((r.batch, r.v) for r in back.collect()) == [(1, "x"), (2, "y"), (2, "z"), (3, "w")]


def test_a_clustered_split_has_few_files_and_skips(spark, tmp_path):
    df = spark.range(20_000).select(
        F.concat(F.lit("MX"), F.lpad((F.col("id") % 500).cast("string"), 5, "0")).alias("municipality"), (F.col("id") % 3).cast("string").alias("year_period"), "id"
    ).repartition(16)
    plain, sorted_ = str(tmp_path / "plain"), str(tmp_path / "sorted")
    writers.write_by_period(df, plain)
    writers.write_by_period(df, sorted_, sort=["municipality"], files=6)
    files = lambda path: [f for _, _, names in os.walk(path) for f in names if f.endswith(".parquet")]
    assert len(files(plain)) == 48 and len(files(sorted_)) <= 9
    ranges = []
    for folder, _, names in os.walk(sorted_):
        for f in names:
            if f.endswith(".parquet"):
                r = spark.read.parquet(os.path.join(folder, f)).agg(F.min("municipality"), F.max("municipality")).first()
                ranges.append((folder, *r))
    for folder in {r[0] for r in ranges}:
        parts = sorted(r[1:] for r in ranges if r[0] == folder)
        assert all(a[1] <= b[0] for a, b in zip(parts, parts[1:])), "files of a period hold separate ranges"
    assert sorted(spark.read.parquet(sorted_).select("id").toPandas()["id"]) == list(range(20_000))


def test_work_of_an_application_can_be_removed(spark):
    from heatstrata.sources.work_folder import owner, remove_work

    other = f"{spark.conf.get('spark.checkpoint.dir')}/another-application/t"
    for path in (work_folder(spark), work_folder(spark), other):
        spark.range(3).write.mode("overwrite").parquet(path)
    assert owner(spark) in work_folder(spark)
    assert remove_work(spark) and not remove_work(spark)
    assert spark.read.parquet(other).count() == 3
    assert work_folder(spark) != work_folder(spark)
