"""Plans of the registered queries: no cross product, no Python in tasks, filters at the scan."""

import pytest

from workload import registry

# These write tables while they are built.
WRITING = {
    "scan_csv", "scan_projected", "scan_union_years", "scan_period_from_path", "split_by_period", "scan_drifting_order", "scan_float_codes",
    "scan_sections", "report_sections", "append_repeated", "combine_and_split", "split_clustered", "cc_stored_battery", "cc_stored_subgroups",
    "cc_by_subgroup_battery", "cc_refreshed", "deaths_period_refreshed", "scan_indicators", "union_results",
}


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - WRITING))
def test_no_cross_product_and_no_python(spark, sf_dir, name):
    plan = registry.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "ArrowEvalPython", "BatchEvalPython", "Pandas"):
        assert bad not in plan, plan


def test_period_filter_reaches_the_scan(spark, sf_dir):
    plan = registry.QUERIES["filter_period"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_shipdate), GreaterThanOrEqual(l_shipdate" in plan
    assert "ReadSchema: struct<l_orderkey:bigint,l_linenumber:int,l_shipdate:timestamp_ntz>" in plan


def test_study_period_filter_reaches_the_scan(spark, tmp_path):
    from heatstrata.functions.periods import within_periods
    from pyspark.sql import functions as F

    path = str(tmp_path / "w")
    spark.sql("SELECT date'2001-01-01' AS date, 1 AS x").write.parquet(path)
    plan = spark.read.parquet(path).where(within_periods(F.col("date")))._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(date,1998-01-01), LessThanOrEqual(date,2022-12-31)" in plan


def test_generated_cleaning_code_stays_compilable(spark, tmp_path):
    """The JVM compiles no method beyond 8,000 bytes of bytecode."""
    import contextlib
    import io
    import re

    from heatstrata.operators import mortality
    from heatstrata.sources import schemas

    path = str(tmp_path / "raw")
    row = [(1, 1, 1, 1, 2001, "I219", 1, 1, 1, 1, 1, 1)]
    spark.createDataFrame(row, schemas.DEATHS_RAW).selectExpr("*", "2001 AS YEAR").write.parquet(path)
    text = io.StringIO()
    spark.conf.set("spark.sql.adaptive.enabled", False)  # an adaptive plan has no code before it runs
    try:
        with contextlib.redirect_stdout(text):
            mortality.daily_sums(mortality.clean_deaths(spark.read.parquet(path), "YEAR")).explain("codegen")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", True)
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", text.getvalue())]
    assert sizes and max(sizes) < 8000
