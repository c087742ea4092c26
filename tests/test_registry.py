"""Every registered query against its SQL on the smallest tables."""

import pytest

from workload import compare, registry


@pytest.fixture(scope="module")
def con(sf_dir):
    return compare.connect(sf_dir)


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query_equals_sql(spark, con, sf_dir, name):
    assert compare.compare(spark, con, sf_dir, registry.QUERIES[name], registry.ORACLES[name]) == []


def test_entry(spark):
    import __spark_entry__ as driver

    assert driver.entry(spark).count() == 1
    assert set(driver.oracle_sql()) <= set(driver.queries())
