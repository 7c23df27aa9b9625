"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as contract
from tests.compare import connect, difference

QUERIES = contract.queries()
ORACLE = contract.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


def no_pairwise_join(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, sf, con, name):
    found = QUERIES[name](spark, sf)
    assert no_pairwise_join(found)
    assert difference(found, con, ORACLE[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_gives_rows(spark, sf, name):
    found = QUERIES[name](spark, sf)
    assert no_pairwise_join(found)
    assert found.count() > 0


def test_contract(spark):
    assert set(ORACLE) <= set(QUERIES)
    assert contract.entry(spark).count() > 0
