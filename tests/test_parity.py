"""Every registered query against its SQL, and a guard on its physical plan."""

import pytest
from parity import compare, connect

from __spark_entry__ import entry
from passagemill.plans.catalog import QUERIES
from passagemill.plans.oracle import ORACLE

SF = "/root/testdata/sf0.001"
ROWS_ONLY: set[str] = set()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, con, name):
    plans = []
    problem, rows, _, _ = compare(spark, con, name, SF, plans)
    assert problem is None, problem
    assert rows > 0
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "CollectLimit"):
        assert bad not in plans[0]


def test_every_query_has_sql_or_is_known_not_to():
    assert set(QUERIES) - set(ORACLE) == ROWS_ONLY


def test_entry_has_a_stable_schema(spark):
    df = entry(spark)
    assert df.columns == ["query_id", "markdown", "used_sources", "warnings"]
    assert df.count() == 40
