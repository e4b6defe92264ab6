"""Every registered query against its SQL on the smallest tables; names and types must agree too."""

import pytest
from check import compare, connect

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
SLOW = {"des_search", "search_params", "registry_migrate", "study_run", "fit_linear_svm"}


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", [n for n in entry.queries() if n in entry.oracle_sql()])
def test_query_equals_sql(spark, con, name):
    df = entry.queries()[name](spark, SF)
    plan = df._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    assert compare(df, con, entry.oracle_sql()[name]) == ""


@pytest.mark.parametrize("name", [n for n in entry.queries() if n not in entry.oracle_sql() and n not in SLOW])
def test_query_without_sql_gives_rows(spark, name):
    assert entry.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    df = entry.entry(spark)
    assert set(df.columns) == {"row_id", "y", "score", "rejected", "pred"}
    assert df.where("rejected").count() == int(0.2 * df.count())
    assert df.where("rejected and pred is not null").count() == 0
