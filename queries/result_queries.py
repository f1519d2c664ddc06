"""Analytics over a history of results: four rules over orders, one result per rule and day."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from queries.base import counts_sql, query, result_sql, rules_from, run_of, table
from veriframe.operators.row_checks import check_rows
from veriframe.plans import analytics as A
from veriframe.plans.metadata import (
    current_versions, execution_states, mark_current_versions, resolve_assignments,
)

HISTORY_RULES = [
    ("or_priority_list", ["o_orderpriority"], "accuracy", "high", 30.0,
     "is_in_list(col('o_orderpriority'), ['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED'])",
     "o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED')"),
    ("or_total_range", ["o_totalprice"], "accuracy", "critical", 5.0,
     "range_check(col('o_totalprice'), 2000, 480000)", "o_totalprice BETWEEN 2000 AND 480000"),
    ("or_status_present", ["o_orderstatus"], "completeness", "medium", None,
     "is_not_empty(col('o_orderstatus'))", "NOT (o_orderstatus IS NULL OR trim(o_orderstatus) = '')"),
    ("or_key_above_customer", ["o_orderkey", "o_custkey"], "consistency", "low", 10.0,
     "greater_than(col('o_orderkey'), col('o_custkey'))", "o_orderkey > o_custkey"),
]

HISTORY_SQL = "history AS (SELECT 'run-' || CAST(day AS VARCHAR) AS run_id, " \
    "'as-' || rule_id AS assignment_id, CAST(day AS TIMESTAMP) AS validation_timestamp, " \
    "day AS run_date, CAST((records_checked * 7) % 1000 AS BIGINT) AS execution_duration_ms, " \
    "* EXCLUDE (day) FROM (" + result_sql(
        "\nUNION ALL ".join(
            counts_sql("orders", s, "CAST(o_orderdate AS DATE) AS day, ", "GROUP BY CAST(o_orderdate AS DATE)")
            for s in HISTORY_RULES
        ), "orders", "day, ") + "))"

WITH_HISTORY = f"WITH {HISTORY_SQL}\n"


def history(spark, sf_dir):
    """Results of the four rules for every order date, dated on that day."""
    orders = table(spark, sf_dir, "orders").withColumn("day", F.to_date("o_orderdate"))
    results = check_rows(orders, rules_from(HISTORY_RULES), run_of("orders"), by=["day"])
    return results.withColumns({
        "run_id": F.concat(F.lit("run-"), F.col("day").cast("string")),
        "assignment_id": F.concat(F.lit("as-"), "rule_id"),
        "validation_timestamp": F.col("day").cast("timestamp_ntz"),
        "run_date": F.col("day"),
        "execution_duration_ms": (F.col("records_checked") * 7) % 1000,
    }).drop("day")


def rules_table(spark):
    rows = [(s[0], s[0].replace("_", " "), "single_field" if len(s[1]) == 1 else "multi_field", s[2],
             s[3], s[5], s[4], True, dt.datetime(2023, 1, 1 + i)) for i, s in enumerate(HISTORY_RULES)]
    rows.append(("or_never_run", "or never run", "single_field", "custom", "low", "true", None, False,
                 dt.datetime(2023, 1, 31)))
    return spark.createDataFrame(
        rows, "rule_id string, rule_name string, rule_type string, rule_category string, "
        "severity_level string, rule_logic string, threshold_value double, is_active boolean, "
        "created_at timestamp")


RULES_SQL = "rules(rule_id, rule_name, rule_type, rule_category, severity_level, is_active, created_at) AS (VALUES " + ", ".join(
    f"('{s[0]}', '{s[0].replace('_', ' ')}', '{'single_field' if len(s[1]) == 1 else 'multi_field'}', "
    f"'{s[2]}', '{s[3]}', true, TIMESTAMP '2023-01-{1 + i:02d} 00:00:00')"
    for i, s in enumerate(HISTORY_RULES)
) + ", ('or_never_run', 'or never run', 'single_field', 'custom', 'low', false, TIMESTAMP '2023-01-31 00:00:00'))"


def sources_table(spark):
    return spark.createDataFrame(
        [("src-1", "Orders lake", "s3", {"bucket": "orders"}, True, dt.datetime(2023, 1, 1)),
         ("src-2", "Old orders", "oracle", {"host": "db"}, False, dt.datetime(2023, 1, 2))],
        "source_id string, source_name string, source_type string, "
        "connection_config map<string,string>, is_active boolean, created_at timestamp")


def assignments_table(spark):
    rows = [(f"as-{s[0]}", s[0], "src-1" if i < 3 else "src-2", "sales", "orders", s[1], i != 2, 3 - i // 2,
             dt.datetime(2023, 2, 1 + i)) for i, s in enumerate(HISTORY_RULES)]
    return spark.createDataFrame(
        rows, "assignment_id string, rule_id string, source_id string, schema_name string, "
        "table_name string, column_names array<string>, is_active boolean, priority_order int, "
        "created_at timestamp")


ASSIGN_SQL = "assignments(assignment_id, rule_id, source_id, schema_name, table_name, is_active, priority_order, created_at) AS (VALUES " + ", ".join(
    f"('as-{s[0]}', '{s[0]}', '{'src-1' if i < 3 else 'src-2'}', 'sales', 'orders', {str(i != 2).lower()}, "
    f"{3 - i // 2}, TIMESTAMP '2023-02-{1 + i:02d} 00:00:00')" for i, s in enumerate(HISTORY_RULES)
) + ")"
SOURCES_SQL = "sources(source_id, source_name) AS (VALUES ('src-1', 'Orders lake'), ('src-2', 'Old orders'))"


@query("result_history", WITH_HISTORY + "SELECT run_id, assignment_id, rule_id, table_name, "
       "rule_category, records_checked, records_failed, failure_rate, status, run_date, "
       "execution_duration_ms FROM history")
def result_history(spark, sf_dir):
    """The history itself."""
    return history(spark, sf_dir).select(
        "run_id", "assignment_id", "rule_id", "table_name", "rule_category", "records_checked",
        "records_failed", "failure_rate", "status", "run_date", "execution_duration_ms")


@query("find_results", WITH_HISTORY + "SELECT rule_id, run_date, records_failed, failure_rate, status "
       "FROM history WHERE status = 'fail' AND rule_id = 'or_priority_list' "
       "AND run_date BETWEEN DATE '1996-01-01' AND DATE '1998-12-31' "
       "ORDER BY validation_timestamp DESC, rule_id, assignment_id, run_id LIMIT 100")
def find_results(spark, sf_dir):
    """The hundred newest failures of a rule in a range of dates."""
    found = A.find_results(
        history(spark, sf_dir), rule_id="or_priority_list", status="fail", table_name="orders",
        since=dt.date(1996, 1, 1), until=dt.date(1998, 12, 31))
    return found.select("rule_id", "run_date", "records_failed", "failure_rate", "status")


@query("summary_view", f"WITH {HISTORY_SQL}, {RULES_SQL}, {ASSIGN_SQL}, {SOURCES_SQL}\n"
       "SELECT r.rule_id, r.rule_name, r.rule_category, r.severity_level, s.source_name, a.schema_name, "
       "a.table_name, h.validation_timestamp, h.records_checked, h.records_failed, h.status, "
       "h.execution_duration_ms FROM history h JOIN rules r ON h.rule_id = r.rule_id "
       "JOIN assignments a ON h.assignment_id = a.assignment_id JOIN sources s ON a.source_id = s.source_id")
def summary_view(spark, sf_dir):
    """Results with the names of rule, source and table."""
    return A.validation_summary(
        history(spark, sf_dir), rules_table(spark), assignments_table(spark), sources_table(spark))


@query("rule_stats", f"WITH {HISTORY_SQL}, {RULES_SQL}\n"
       "SELECT r.rule_id, r.rule_name, count(h.run_id) AS total_executions, "
       "count(*) FILTER (WHERE h.status = 'pass') AS pass_count, "
       "count(*) FILTER (WHERE h.status = 'fail') AS fail_count, "
       "count(*) FILTER (WHERE h.status = 'error') AS error_count, "
       "round(avg(h.execution_duration_ms), 6) AS avg_duration_ms, "
       "max(h.validation_timestamp) AS last_execution FROM rules r LEFT JOIN history h "
       "ON r.rule_id = h.rule_id GROUP BY ALL")
def rule_stats(spark, sf_dir):
    """Runs and outcomes per rule, also of a rule that never ran."""
    stats = A.rule_statistics(rules_table(spark), history(spark, sf_dir))
    return stats.withColumn("avg_duration_ms", F.round("avg_duration_ms", 6))


DAY = dt.date(1998, 7, 7)


@query("dashboard", f"WITH {HISTORY_SQL}, {RULES_SQL}, {ASSIGN_SQL},\n"
       f"today AS (SELECT count(*) AS n, count(*) FILTER (WHERE status <> 'pass') AS bad FROM history "
       f"WHERE run_date = DATE '{DAY}')\n"
       "SELECT (SELECT count(*) FROM rules) AS total_rules, "
       "(SELECT count(*) FROM assignments WHERE is_active) AS active_assignments, "
       "n AS validations_today, round(CASE WHEN n > 0 THEN 100.0::DOUBLE * bad / n ELSE 0 END, 1) AS failure_rate, "
       "CASE WHEN n > 0 THEN 100.0::DOUBLE * bad / n ELSE 0 END > 10 AS is_alarming FROM today")
def dashboard(spark, sf_dir):
    """Totals of one day."""
    return A.dashboard_totals(
        rules_table(spark), assignments_table(spark), history(spark, sf_dir), DAY)


@query("trend7", WITH_HISTORY +
       f"SELECT CAST(d AS DATE) AS run_date, count(h.run_id) FILTER (WHERE status = 'pass') AS passed, "
       f"count(h.run_id) FILTER (WHERE status <> 'pass') AS failed "
       f"FROM generate_series(DATE '{DAY}' - INTERVAL 6 DAY, DATE '{DAY}', INTERVAL 1 DAY) AS t(d) "
       "LEFT JOIN history h ON h.run_date = CAST(d AS DATE) GROUP BY ALL")
def trend7(spark, sf_dir):
    """Passed and failed validations of seven days."""
    return A.trend(history(spark, sf_dir), DAY)


@query("quality_score", WITH_HISTORY + """,
per AS (SELECT table_name, run_date, rule_category,
 100.0::DOUBLE * sum(records_passed) / sum(records_checked) AS score, count(*) AS applied,
 count(*) FILTER (WHERE status = 'pass') AS passed FROM history GROUP BY ALL)
SELECT table_name, run_date AS score_date, round(avg(score), 2) AS overall_score,
 round(max(score) FILTER (WHERE rule_category = 'completeness'), 2) AS completeness_score,
 round(max(score) FILTER (WHERE rule_category = 'accuracy'), 2) AS accuracy_score,
 round(max(score) FILTER (WHERE rule_category = 'consistency'), 2) AS consistency_score,
 round(max(score) FILTER (WHERE rule_category = 'integrity'), 2) AS integrity_score,
 round(max(score) FILTER (WHERE rule_category = 'timeliness'), 2) AS timeliness_score,
 CAST(sum(applied) AS BIGINT) AS total_rules_applied, CAST(sum(passed) AS BIGINT) AS rules_passed,
 CAST(sum(applied) - sum(passed) AS BIGINT) AS rules_failed FROM per GROUP BY ALL""".replace(",\nper", ", per", 1))
def quality_score(spark, sf_dir):
    """Scores per table and day."""
    return A.quality_scores(history(spark, sf_dir))


@query("alerts", WITH_HISTORY + "SELECT rule_id, run_date, severity_level, records_failed, failure_rate, "
       "status FROM history WHERE severity_level IN ('critical', 'high') AND status = 'fail' AND failure_rate > 10")
def alerts(spark, sf_dir):
    """Failures worth telling about."""
    found = A.alerts(history(spark, sf_dir), severities=("critical", "high"))
    return found.select("rule_id", "run_date", "severity_level", "records_failed", "failure_rate", "status")


@query("run_alerts", WITH_HISTORY + "SELECT run_id, count(*) AS validations, "
       "count(*) FILTER (WHERE status IN ('fail', 'error')) AS failures, "
       "count(*) FILTER (WHERE status IN ('fail', 'error')) > 0 AS has_failures, "
       "100.0 * count(*) FILTER (WHERE status IN ('fail', 'error')) / count(*) > 10 AS is_alarming "
       "FROM history GROUP BY run_id")
def run_alerts(spark, sf_dir):
    """Per run, whether anything failed."""
    return A.run_alerts(history(spark, sf_dir))


@query("rate_anomalies", WITH_HISTORY + """, w AS (SELECT rule_id, run_date, failure_rate,
 lag(failure_rate) OVER s AS previous_rate,
 avg(failure_rate) OVER (s ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS m,
 stddev_samp(failure_rate) OVER (s ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS sd
 FROM history WINDOW s AS (PARTITION BY rule_id, table_name ORDER BY validation_timestamp, run_id))
SELECT rule_id, run_date, failure_rate, previous_rate, round(m, 7) AS mean_rate,
 coalesce(CASE WHEN sd > 1e-9 THEN abs((failure_rate - m) / sd) > 3 END, false) AS is_anomaly FROM w""")
def rate_anomalies(spark, sf_dir):
    """Failure rates far from those of the seven runs before."""
    found = A.rate_anomalies(history(spark, sf_dir))
    return found.select("rule_id", "run_date", "failure_rate", "previous_rate",
                        F.round("mean_rate", 7).alias("mean_rate"), "is_anomaly")


@query("kept_results", WITH_HISTORY + "SELECT rule_id, run_date, status FROM history "
       "WHERE run_date > DATE '2001-08-01' - INTERVAL 90 DAY")
def kept_results(spark, sf_dir):
    """Results within the retention time."""
    kept = A.kept_results(history(spark, sf_dir), dt.date(2001, 8, 1))
    return kept.select("rule_id", "run_date", "status")


@query("metric_rows", WITH_HISTORY + """, wide AS (SELECT rule_id AS RuleId, assignment_id AS AssignmentId,
 status AS Status, 'src-1' AS SourceId, validation_timestamp AS timestamp,
 execution_duration_ms / 1000.0::DOUBLE AS ValidationDuration, records_checked::DOUBLE AS RecordsChecked,
 records_failed::DOUBLE AS RecordsFailed, CASE WHEN status = 'pass' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS ValidationStatus,
 100.0::DOUBLE * records_failed / records_checked AS FailureRate FROM history)
SELECT RuleId, AssignmentId, Status, SourceId, timestamp, metric, round(value, 6) AS value,
 CASE metric WHEN 'ValidationDuration' THEN 'Seconds' WHEN 'FailureRate' THEN 'Percent' ELSE 'Count' END AS unit
FROM (UNPIVOT wide ON ValidationDuration, RecordsChecked, RecordsFailed, ValidationStatus, FailureRate
 INTO NAME metric VALUE value)""")
def metric_rows(spark, sf_dir):
    """Results as metrics."""
    return A.metric_rows(history(spark, sf_dir), "src-1").withColumn("value", F.round("value", 6))


@query("lineage_rows", WITH_HISTORY + "SELECT run_id, table_name, string_agg(rule_id, ',' ORDER BY rule_id) "
       "AS rules_applied, max(validation_timestamp) AS created_at FROM history GROUP BY run_id, table_name")
def lineage_rows(spark, sf_dir):
    """Rules applied to each table in each run."""
    rows = A.lineage_rows(history(spark, sf_dir), "files/orders")
    return rows.select(
        "run_id", "table_name", F.concat_ws(",", "rules_applied").alias("rules_applied"), "created_at")


@query("resolved_assignments", f"WITH {HISTORY_SQL}, {RULES_SQL}, {ASSIGN_SQL}, {SOURCES_SQL}\n"
       "SELECT a.assignment_id, r.rule_name, s.source_name, a.priority_order, "
       "count(*) AS runs, CAST(sum(h.records_failed) AS BIGINT) AS records_failed "
       "FROM assignments a JOIN rules r USING (rule_id) JOIN sources s USING (source_id) "
       "JOIN history h ON h.assignment_id = a.assignment_id "
       "WHERE a.is_active AND r.is_active GROUP BY ALL")
def resolved_assignments(spark, sf_dir):
    """Active assignments in the order they apply, with what their runs found."""
    active = resolve_assignments(assignments_table(spark), rules_table(spark), sources_table(spark))
    found = history(spark, sf_dir).groupBy("assignment_id").agg(
        F.count(F.lit(1)).alias("runs"), F.sum("records_failed").alias("records_failed"))
    return active.join(found, "assignment_id").orderBy("priority_order", F.desc("created_at")).select(
        "assignment_id", "rule_name", "source_name", "priority_order", "runs", "records_failed")


# A log of runs spelled out of the events: a user's day is a run, its events are the log entries.
LOG_SQL = """log AS (SELECT strftime(ts, '%Y-%m-%d') AS run_id, CAST(user_id AS VARCHAR) AS assignment_id,
 CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'completed' ELSE 'running' END AS status,
 ts AS event_time, CAST(round(value * 100) AS BIGINT) AS records_processed FROM events)"""


def log_events(spark, sf_dir):
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        F.date_format("ts", "yyyy-MM-dd").alias("run_id"),
        F.col("user_id").cast("string").alias("assignment_id"),
        F.when(kind == "error", "failed").when(kind == "purchase", "completed").otherwise("running").alias("status"),
        F.col("ts").alias("event_time"),
        F.round(F.col("value") * 100).cast("bigint").alias("records_processed"),
    )


@query("execution_states", f"WITH {LOG_SQL} SELECT run_id, assignment_id, "
       "arg_max(status, struct_pack(a := event_time, b := status <> 'running')) AS status, "
       "min(event_time) AS start_time, max(event_time) FILTER (WHERE status <> 'running') AS end_time, "
       "max(records_processed) AS records_processed, CAST(datesub('millisecond', min(event_time), "
       "max(event_time) FILTER (WHERE status <> 'running')) AS BIGINT) AS execution_duration_ms "
       "FROM log GROUP BY run_id, assignment_id")
def execution_state_query(spark, sf_dir):
    """Latest state and duration of every run."""
    return execution_states(log_events(spark, sf_dir))


# Rule versions spelled out of conversations: a conversation is a rule, each turn a new version.
def version_history(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("rule_id"), F.col("turn").alias("version_number"),
        F.concat(F.lit("rule "), F.col("conv_id").cast("string")).alias("rule_name"),
        F.col("text").alias("rule_logic"), F.col("role").alias("changed_by"))


@query("rule_versions_current", "SELECT conv_id AS rule_id, turn AS version_number, "
       "'rule ' || CAST(conv_id AS VARCHAR) AS rule_name, text AS rule_logic, role AS changed_by "
       "FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1")
def rule_versions_current(spark, sf_dir):
    """The current version of each rule."""
    return current_versions(version_history(spark, sf_dir))


@query("rule_versions_marked", "SELECT conv_id AS rule_id, turn AS version_number, role AS changed_by, "
       "turn = max(turn) OVER (PARTITION BY conv_id) AS is_current_version FROM conversations")
def rule_versions_marked(spark, sf_dir):
    """The whole version history with the current versions marked."""
    marked = mark_current_versions(version_history(spark, sf_dir))
    return marked.select("rule_id", "version_number", "changed_by", "is_current_version")
