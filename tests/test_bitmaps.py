"""Distinct counts and key filters by bitmaps."""

import random

from pyspark.sql import functions as F

from heatstrata.operators import bitmaps


def test_distinct_counts_are_exact_and_add_up(spark):
    rng = random.Random(1)
    rows = [(rng.choice("ab"), rng.choice([None, *range(-70_000, 70_000, 7)]), rng.choice([None, 5, 32767, 32768, -1, 2**40])) for _ in range(4000)]
    df = spark.createDataFrame(rows, "part string, x long, y long")
    codes = {"x": F.col("x"), "y": F.col("y")}
    expect = {(p, n, len({r[i] for r in rows if r[0] == p and r[i] is not None})) for p in "ab" for i, n in ((1, "x"), (2, "y"))}
    parts = bitmaps.distinct_bitmaps(df, codes, ["part"])
    assert {(r.part, r.name, r.n) for r in bitmaps.distinct_counts(parts, ["part"]).collect()} == expect
    later = bitmaps.distinct_bitmaps(df.where("part = 'a'"), codes).union(bitmaps.distinct_bitmaps(df.where("part = 'b'"), codes))
    for whole in (parts, later):
        assert {(r.name, r.n) for r in bitmaps.distinct_counts(whole).collect()} == {(n, len({r[i] for r in rows if r[i] is not None})) for i, n in ((1, "x"), (2, "y"))}
    plan = bitmaps.distinct_counts(parts)._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan
    assert bitmaps.distinct_counts(bitmaps.distinct_bitmaps(df.limit(0), codes)).collect() == []


def test_no_key_is_lost_and_few_others_pass(spark):
    keys = spark.range(0, 3000, 3).select(F.concat(F.lit("k"), "id").alias("k"), (F.col("id") % 5).alias("d"))
    table = spark.range(20_000).select(F.when(F.col("id") % 50 != 1, F.concat(F.lit("k"), "id")).alias("k"), (F.col("id") % 5).alias("d"), "id")
    filter_ = bitmaps.key_filter(keys, ["k", "d"], buckets=4)
    assert filter_.count() <= 4
    passed = bitmaps.may_have_key(table, filter_, ["k", "d"], buckets=4)
    wanted = table.join(keys, ["k", "d"], "left_semi").select("id")
    got = {r.id for r in passed.select("id").collect()}
    assert {r.id for r in wanted.collect()} <= got and len(got) < 1200
    assert passed.columns == table.columns
    none = bitmaps.may_have_key(table, bitmaps.key_filter(keys.limit(0), ["k"]), ["k"])
    assert none.count() == 0


def test_filters_of_parts_are_merged(spark):
    keys = spark.range(1000)
    parts = bitmaps.key_filter(keys.where("id < 300"), ["id"], 2).union(bitmaps.key_filter(keys.where("id >= 300"), ["id"], 2))
    one = bitmaps.key_filter(keys, ["id"], 2)
    as_set = lambda f: {(r.bucket, bytes(r.bits)) for r in f.collect()}
    assert as_set(bitmaps.merge_filters(parts)) == as_set(one)


def test_the_filter_cuts_what_a_join_shuffles(spark, tmp_path):
    """With broadcasts of tables off, the big side's exchange holds only rows that may match."""
    spark.range(50_000).select("id", F.lit("x" * 50).alias("v")).write.parquet(str(tmp_path / "big"))
    spark.range(0, 50_000, 500).select("id").write.parquet(str(tmp_path / "keys"))
    big, keys = spark.read.parquet(str(tmp_path / "big")), spark.read.parquet(str(tmp_path / "keys"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        cut = bitmaps.may_have_key(big, bitmaps.key_filter(keys, ["id"]), ["id"])
        joined = keys.join(cut, "id", "left")
        assert sorted(map(tuple, joined.collect())) == sorted(map(tuple, keys.join(big, "id", "left").collect()))
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert plan.count("BroadcastHashJoin") >= 3 and "Cartesian" not in plan and "NestedLoop" not in plan
        assert cut.count() < 120
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
