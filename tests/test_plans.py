"""Plan checks: pushdown and pruning reach the scans; no Python, Cartesian
or nested-loop operators in the SQL-checkable queries."""

import pytest

from conftest import SF_SMALL

FORBIDDEN = ("BatchEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin", "ArrowEvalPython")
MODEL_OR_DENSITY = {"kdistance", "kdistance_eps", "cluster_metrics"}


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_snapshot_scan_pushdown(spark):
    from segmint.plans import base
    from segmint.sources.snapshot import customer_snapshot
    from segmint.sources.tables import Tables

    at = base.as_of(spark, SF_SMALL)
    df = customer_snapshot(Tables(spark, SF_SMALL), at)
    text = df._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )
    assert "LessThanOrEqual(o_orderdate" in text
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint,o_totalprice:double,o_orderdate:timestamp_ntz>" in text
    assert "o_orderpriority" not in text and "l_extendedprice" not in text
    for bad in FORBIDDEN:
        assert bad not in text


def test_sql_checked_queries_have_clean_plans(spark):
    import __spark_entry__ as e

    qs, sqls = e.queries(), e.oracle_sql()
    for name in sqls:
        if name in MODEL_OR_DENSITY:
            continue
        plan = _plan(qs[name](spark, SF_SMALL))
        for bad in FORBIDDEN:
            assert bad not in plan, (name, bad)
