"""Every query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from tests.oracle import connect, differences

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_check_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    df = entry.queries()[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert differences(df, con, entry.oracle_sql()[name]) is None


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql())))
def test_query_without_sql_has_rows(spark, name):
    assert entry.queries()[name](spark, SF).count() > 0


def test_comparison_notices_a_difference(spark, con):
    sql = entry.oracle_sql()["a01_counts"].replace("SELECT run_date, env, total,", "SELECT run_date, env, total + 1 AS total,")
    assert differences(entry.queries()["a01_counts"](spark, SF), con, sql) is not None


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() == 60 and "valid" in df.columns
