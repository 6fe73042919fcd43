"""Every registered query against its SQL, on the smallest data."""

import pytest

from workload import load
from workload.check import compare, duck

SF = "/root/testdata/sf0.001"
QUERIES, SQL = load()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    problem, n, _ = compare(spark, con, SF, name, QUERIES[name], SQL.get(name))
    assert not problem
    assert n >= 0


def test_most_queries_have_sql():
    assert set(QUERIES) - set(SQL) == {"extract_html_rows"}


def test_plans_have_no_nested_loops(spark):
    """OR matches and stop rules are equi-joins; only one-row scalars may be crossed in."""
    for name in ("resolve_run", "take_until", "mark_duplicates", "reconcile_status", "join_latest_run"):
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "CartesianProduct" not in plan, name


def test_scan_prunes_columns(spark):
    plan = QUERIES["filter_popular"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "text" not in plan.split("ReadSchema:")[1].split("\n")[0]
