"""Every registered query against its SQL, on whole tables."""

import os

import pytest

from queries import load_all
from tests.oracle import compare, connect

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
QUERIES, SQL = load_all()


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    problem, rows, _ = compare(spark, con, QUERIES[name], SQL.get(name), SF_DIR)
    assert problem is None, problem
    if name not in SQL:
        assert rows > 0


def test_entry(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.count() == 6 and set(entry.oracle_sql()) <= set(entry.queries())


def plan_of(spark, name):
    df = QUERIES[name](spark, SF_DIR)
    return df._jdf.queryExecution().executedPlan().toString()


def test_fused_rules_scan_once(spark):
    plan = plan_of(spark, "fused_scorecard")
    assert plan.count("FileScan") == 1 and plan.count("Exchange") == 1


def test_pushdown(spark):
    plan = plan_of(spark, "source_view")
    assert "PushedFilters: [IsNotNull(o_orderstatus)" in plan
    assert "o_custkey" not in plan and "o_orderdate" not in plan


def test_key_checks_aggregate_before_the_shuffle(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(spark, "fk_lineitem_orders")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "partial_count" in plan and plan.count("Exchange hashpartitioning") == 2
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_samples_are_pruned_before_the_shuffle(spark):
    assert plan_of(spark, "sample_topk").count("WindowGroupLimit") == 4


@pytest.mark.parametrize("name", ["xtable_ship_after_order", "duplicate_lineitems", "orphan_documents",
                                  "summary_view", "rule_stats", "quality_score", "dashboard"])
def test_no_cross_joins(spark, name):
    plan = plan_of(spark, name)
    assert "Cartesian" not in plan and "NestedLoop" not in plan
