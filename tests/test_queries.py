"""Every query against its SQL, and what its plan may not contain."""

import re

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check import compare, connect
from tests.conftest import SMALL_TABLES
from workloads.queries import QUERIES


@pytest.fixture(scope="module")
def tables():
    return connect(SMALL_TABLES)


@pytest.mark.parametrize("name", QUERIES)
def test_same_rows_as_sql(spark, tables, name):
    assert compare(spark, SMALL_TABLES, name, tables) is None


def test_every_query_has_sql():
    assert QUERIES.keys() <= oracle_sql().keys() <= queries().keys()


def test_entry(spark):
    df = entry(spark)
    assert df.count() == spark.read.parquet(f"{SMALL_TABLES}/orders.parquet").count()


def test_known_counts(spark):
    """Counts of the fixture by DuckDB (FIXTURES 3.1)."""
    row = queries()["quality_report"](spark, SMALL_TABLES).first()
    assert (row.total, row.matched, row.invalid_year, row.unmatched, row.ambiguous) == (1500, 164, 13, 1323, 114)


def plan_of(df):
    return df._jdf.queryExecution().toString()


@pytest.mark.parametrize("name", QUERIES)
def test_no_all_pairs_joins_and_no_python(spark, name):
    physical = plan_of(queries()[name](spark, SMALL_TABLES)).split("== Physical Plan ==")[1]
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "MapInPandas", "BatchEvalPython", "ArrowEvalPython"):
        assert operator not in physical, f"{name} uses {operator}"


def test_flagship_plan(spark):
    """Columns are pruned and keys are combined before shuffles.

    Shuffles: points, properties and buildings once each; the lookup and the representatives, which
    are short, once for their aggregate and once for a join that can split hot keys; matches per
    address.
    """
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        physical = plan_of(entry(spark)).split("== Physical Plan ==")[1]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(re.findall(r"Exchange hashpartitioning", physical)) == 7
    assert "Window" not in physical
    assert physical.count("partial_min_by") >= 3
    read = re.findall(r"ReadSchema: struct<([^>]*)>", physical)
    assert not any("o_totalprice" in r or "l_discount" in r for r in read)
