"""Every registered query against its SQL, over the whole given tables."""

import pytest

import __spark_entry__ as entry
from tests.oracle import difference
from workload.queries import ORACLES, QUERIES


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("slug", sorted(ORACLES))
def test_query_matches_sql(slug, spark, con, sf_dir):
    result = QUERIES[slug](spark, sf_dir)
    plan = result._jdf.queryExecution().executedPlan().toString()
    for costly in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "SinglePartition"):
        assert costly not in plan
    assert difference(result, con, ORACLES[slug]) is None


def test_entry_has_rows(spark):
    assert not entry.entry(spark).isEmpty()
