import datetime as dt

import pytest
from pyspark.sql import functions as F

from veriframe.plans import analytics as A

DAY = dt.date(2024, 1, 8)


@pytest.fixture(scope="module")
def results(spark):
    rows = []
    for d in range(10):
        day = DAY - dt.timedelta(days=d)
        at = dt.datetime.combine(day, dt.time(3))
        rate = 40.0 if d == 0 else 1.0 + d % 2
        rows.append((f"run{d}", "r1", "a1", "t", ["c"], "accuracy", "high", 100, int(rate), 100 - int(rate),
                     rate, "fail", 250, at, day))
        rows.append((f"run{d}", "r2", "a2", "t", ["c", "d"], "completeness", "low", 0, 0, 0,
                     None if d == 0 else 0.0, "error" if d == 0 else "pass", 100, at, day))
    return spark.createDataFrame(
        rows, "run_id string, rule_id string, assignment_id string, table_name string, column_names array<string>, "
        "rule_category string, severity_level string, records_checked bigint, records_failed bigint, "
        "records_passed bigint, failure_rate double, status string, execution_duration_ms bigint, "
        "validation_timestamp timestamp, run_date date")


def test_find(results):
    assert A.find_results(results, rule_id="r1", limit=3).count() == 3
    assert A.find_results(results, status="error").first().run_id == "run0"
    assert A.find_results(results, since=DAY - dt.timedelta(days=1), until=DAY).count() == 4
    assert A.kept_results(results, DAY, days=3).count() == 6


def test_statistics(spark, results):
    rules = spark.createDataFrame([("r1", "one"), ("r2", "two"), ("r3", "three")], "rule_id string, rule_name string")
    rows = {r.rule_id: r for r in A.rule_statistics(rules, results).collect()}
    assert (rows["r1"].total_executions, rows["r1"].fail_count, rows["r1"].avg_duration_ms) == (10, 10, 250.0)
    assert (rows["r2"].pass_count, rows["r2"].error_count) == (9, 1)
    assert (rows["r3"].total_executions, rows["r3"].pass_count, rows["r3"].last_execution) == (0, 0, None)


def test_dashboard_and_trend(spark, results):
    rules = spark.range(5)
    assignments = spark.createDataFrame([(True,), (False,), (True,)], "is_active boolean")
    row = A.dashboard_totals(rules, assignments, results, DAY).first()
    assert tuple(row) == (5, 2, 2, 100.0, True)
    quiet = A.dashboard_totals(rules, assignments, results, dt.date(2030, 1, 1)).first()
    assert tuple(quiet) == (5, 2, 0, 0.0, False)
    rows = A.trend(results, DAY + dt.timedelta(days=2)).orderBy("run_date").collect()
    assert [(r.passed, r.failed) for r in rows] == [(1, 1)] * 4 + [(0, 2), (0, 0), (0, 0)]


def test_scores_and_alerts(results):
    score = A.quality_scores(results).where(F.col("score_date") == F.lit(DAY)).first()
    assert (score.overall_score, score.accuracy_score, score.completeness_score) == (60.0, 60.0, None)
    assert (score.total_rules_applied, score.rules_passed, score.rules_failed) == (2, 0, 2)
    assert [r.rule_id for r in A.alerts(results).collect()] == ["r1", "r2"]
    assert [r.rule_id for r in A.alerts(results, severities=("critical", "high")).collect()] == ["r1"]
    run = A.run_alerts(results).where("run_id = 'run0'").first()
    assert (run.validations, run.failures, run.has_failures, run.is_alarming) == (2, 2, True, True)


def test_anomalies(results):
    rows = A.rate_anomalies(results).where("is_anomaly").collect()
    assert [(r.rule_id, r.run_id, r.previous_rate) for r in rows] == [("r1", "run0", 2.0)]


def test_metrics(results):
    rows = A.metric_rows(results.where("run_id = 'run0'")).collect()
    found = {(r.RuleId, r.metric): r.value for r in rows}
    assert found[("r1", "ValidationDuration")] == 0.25 and found[("r1", "FailureRate")] == 40.0
    assert found[("r2", "ValidationStatus")] == 0.0 and ("r2", "FailureRate") not in found
    assert len(found) == 9


def test_lineage(results):
    rows = A.lineage_rows(results).collect()
    assert len(rows) == 10 and all(r.rules_applied == ["r1", "r2"] for r in rows)
