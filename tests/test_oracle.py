"""Every registered query with SQL against DuckDB, value by value, on the smallest tables."""

import pytest

import __spark_entry__ as entry
from catalog import registry
from tests import oracle

SF = "/root/testdata/sf0.001"
PLANS, SQL = registry.plans(), registry.sql()


@pytest.fixture(scope="module")
def db():
    return oracle.connect(SF)


def test_every_query_has_sql():
    assert set(SQL) == set(PLANS) and len(PLANS) > 90
    assert set(PLANS) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(PLANS))
def test_query(spark, db, name):
    df = PLANS[name](spark, SF)
    assert oracle.compare(df, db, SQL[name]) is None
    assert oracle.types(df, db, SQL[name]) == {}


def test_entry(spark):
    out = entry.entry(spark)
    assert out.columns == ["tool_name", "calls", "errors", "avg_latency_ms", "p95_latency_ms"] and out.count() > 0
