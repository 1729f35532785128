import pytest

from clinflow.plans import registry
from tests.oracle import connect, same


@pytest.fixture(scope="module")
def con(tiny):
    return connect(tiny)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, con, tiny, name):
    same(spark, con, registry.QUERIES[name], registry.ORACLE_SQL[name], tiny)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["stay_id", "subject_id", "label", "landmark_us", "event_us"]


def test_scan_is_pruned(spark, tiny):
    plan = registry.QUERIES["projected_scan"](spark, tiny)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_shipdate)" in plan and "l_tax" not in plan
