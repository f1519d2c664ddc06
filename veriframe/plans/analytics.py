"""Questions about results: who failed, how often, since when, how badly."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veriframe.operators.skew import frequent_keys, spread_join
from veriframe.plans.rules import RULE_CATEGORIES

# Scored categories, alert limit in percent, days results are kept.
SCORED_CATEGORIES = ("completeness", "accuracy", "consistency", "integrity", "timeliness")
ALERT_RATE = 10.0
RETENTION_DAYS = 90


def find_results(
    results: DataFrame,
    rule_id: str | None = None,
    assignment_id: str | None = None,
    run_id: str | None = None,
    status: str | None = None,
    table_name: str | None = None,
    since: dt.date | None = None,
    until: dt.date | None = None,
    limit: int | None = 100,
) -> DataFrame:
    """Newest results first, at most `limit`; the date range prunes `run_date` partitions."""
    equal = {"rule_id": rule_id, "assignment_id": assignment_id, "run_id": run_id,
             "status": status, "table_name": table_name}
    for name, value in equal.items():
        if value is not None:
            results = results.where(F.col(name) == value)
    if since is not None:
        results = results.where(F.col("run_date") >= F.lit(since))
    if until is not None:
        results = results.where(F.col("run_date") <= F.lit(until))
    # Ties in time are broken by ids, so the same rows are shown every time.
    newest = results.orderBy(F.desc("validation_timestamp"), "rule_id", "assignment_id", "run_id")
    return newest.limit(limit) if limit else newest


def validation_summary(
    results: DataFrame, rules: DataFrame, assignments: DataFrame, sources: DataFrame
) -> DataFrame:
    """Every result with the names of its rule, table and source, newest first.

    Spark broadcasts rule tables that are small enough. Larger ones are joined with the results of
    a rule that holds many of them spread over tasks.
    """
    wanted = results.select(
        "rule_id", "assignment_id", "validation_timestamp", "records_checked", "records_failed",
        "status", "execution_duration_ms",
    )
    rule = rules.select("rule_id", "rule_name", "rule_category", "severity_level")
    target = assignments.select("assignment_id", "source_id", "schema_name", "table_name").join(
        sources.select("source_id", "source_name"), "source_id"
    )
    named = spread_join(spread_join(wanted, rule, ["rule_id"]), target, ["assignment_id"],
                        frequent=frequent_keys(wanted, ["assignment_id"]))
    return named.select(
        "rule_id", "rule_name", "rule_category", "severity_level", "source_name", "schema_name",
        "table_name", "validation_timestamp", "records_checked", "records_failed", "status",
        "execution_duration_ms",
    ).orderBy(F.desc("validation_timestamp"))


def rule_statistics(rules: DataFrame, results: DataFrame) -> DataFrame:
    """Runs, outcomes, mean duration and last run of each rule; zeros for rules that never ran.

    Results are summed per rule before they meet the rules.
    """
    per_rule = results.groupBy("rule_id").agg(
        F.count(F.lit(1)).alias("total_executions"),
        *[F.count_if(F.col("status") == s).alias(f"{s}_count") for s in ("pass", "fail", "error")],
        F.avg("execution_duration_ms").alias("avg_duration_ms"),
        F.max("validation_timestamp").alias("last_execution"),
    )
    counts = ["total_executions", "pass_count", "fail_count", "error_count"]
    return rules.select("rule_id", "rule_name").join(per_rule, "rule_id", "left").fillna(0, counts)


def dashboard_totals(
    rules: DataFrame, assignments: DataFrame, results: DataFrame, day: dt.date
) -> DataFrame:
    """One row: rules, active assignments, validations of the day, their failure rate, warning."""
    names = ["total_rules", "active_assignments", "validations_today", "failed_today"]
    today = results.where(F.col("run_date") == F.lit(day))

    def part(df, **counts):
        return df.agg(*[counts.get(n, F.lit(0).cast("bigint")).alias(n) for n in names])

    one = F.count(F.lit(1))
    parts = (
        part(rules, total_rules=one)
        .unionByName(part(assignments, active_assignments=F.count_if("is_active")))
        .unionByName(part(today, validations_today=one,
                          failed_today=F.count_if(F.col("status") != "pass")))
    )
    totals = parts.agg(*[F.sum(n).alias(n) for n in names])
    rate = F.when(
        F.col("validations_today") > 0, 100.0 * F.col("failed_today") / F.col("validations_today")
    ).otherwise(0.0)
    return totals.select(
        *names[:3], F.round(rate, 1).alias("failure_rate"), (rate > ALERT_RATE).alias("is_alarming")
    )


def trend(results: DataFrame, last_day: dt.date, days: int = 7) -> DataFrame:
    """Passed and failed validations of each of the last days, also of days without any."""
    first_day = last_day - dt.timedelta(days=days - 1)
    spine = results.sparkSession.range(1).select(
        F.explode(F.sequence(F.lit(first_day), F.lit(last_day))).alias("run_date")
    )
    per_day = (
        results.where(F.col("run_date").between(F.lit(first_day), F.lit(last_day)))
        .groupBy("run_date")
        .agg(
            F.count_if(F.col("status") == "pass").alias("passed"),
            F.count_if(F.col("status") != "pass").alias("failed"),
        )
    )
    return spine.join(per_day, "run_date", "left").fillna(0, ["passed", "failed"])


def quality_scores(results: DataFrame) -> DataFrame:
    """Per table and day: share of passed records per category, their mean, rules passed and failed.

    Rules that could not be evaluated count as applied and failed but not in the shares.
    """
    checked, passed = F.sum("records_checked"), F.sum("records_passed")
    per_category = results.groupBy("table_name", "run_date", "rule_category").agg(
        F.when(checked > 0, 100.0 * passed / checked).alias("score"),
        F.count(F.lit(1)).alias("applied"),
        F.count_if(F.col("status") == "pass").alias("passed"),
    )
    of = {c: F.max(F.when(F.col("rule_category") == c, F.col("score"))) for c in RULE_CATEGORIES}
    return per_category.groupBy("table_name", F.col("run_date").alias("score_date")).agg(
        F.round(F.avg("score"), 2).alias("overall_score"),
        *[F.round(of[c], 2).alias(f"{c}_score") for c in SCORED_CATEGORIES],
        F.sum("applied").alias("total_rules_applied"),
        F.sum("passed").alias("rules_passed"),
        (F.sum("applied") - F.sum("passed")).alias("rules_failed"),
    )


def alerts(
    results: DataFrame,
    min_rate: float = ALERT_RATE,
    severities: Sequence[str] = ("critical", "high", "medium", "low"),
) -> DataFrame:
    """Results to tell somebody about: errors, and failures above the limit, worst first."""
    rank = F.array_position(F.array(*[F.lit(s) for s in severities]), F.col("severity_level"))
    wanted = F.col("severity_level").isin(list(severities)) & (
        (F.col("status") == "error")
        | ((F.col("status") == "fail") & (F.col("failure_rate") > min_rate))
    )
    return results.where(wanted).orderBy(rank, F.desc("failure_rate"), "rule_id", "run_date")


def run_alerts(results: DataFrame, max_failed_share: float = ALERT_RATE) -> DataFrame:
    """Per run: whether anything failed, and whether too many of its validations did."""
    failed = F.count_if(F.col("status").isin("fail", "error"))
    share = 100.0 * failed / F.count(F.lit(1))
    return results.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("validations"),
        failed.alias("failures"),
        (failed > 0).alias("has_failures"),
        (share > max_failed_share).alias("is_alarming"),
    )


def rate_anomalies(results: DataFrame, runs: int = 7, z_limit: float = 3.0) -> DataFrame:
    """Failure rate of each result against the previous runs of the same rule on the same table.

    Results are numbered day by day, so no task has to sort a whole series. Then each result sends
    its rate to the `runs` results after it, which sum up what they receive.
    """
    series = ["rule_id", "table_name"]
    rated = results.where(F.col("failure_rate").isNotNull())
    earlier = Window.partitionBy(*series).orderBy("run_date").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = (
        rated.groupBy(*series, "run_date")
        .agg(F.count(F.lit(1)).alias("results_of_day"))
        .withColumn("offset", F.coalesce(F.sum("results_of_day").over(earlier), F.lit(0)))
        .drop("results_of_day")
    )
    of_day = Window.partitionBy(*series, "run_date").orderBy("validation_timestamp", "run_id")
    numbered = (
        rated.withColumn("number", F.row_number().over(of_day))
        .join(offsets, [*series, "run_date"])
        .withColumn("number", F.col("number") + F.col("offset"))
        .drop("offset")
    )
    received = (
        numbered.select(
            *series, "failure_rate", F.col("number").alias("sender"),
            F.explode(F.sequence(F.col("number") + 1, F.col("number") + runs)).alias("number"),
        )
        .groupBy(*series, "number")
        .agg(
            F.max_by("failure_rate", "sender").alias("previous_rate"),
            F.avg("failure_rate").alias("mean_rate"),
            F.stddev_samp("failure_rate").alias("stddev_rate"),
        )
    )
    distance = F.when(
        F.col("stddev_rate") > 0, (F.col("failure_rate") - F.col("mean_rate")) / F.col("stddev_rate")
    )
    return (
        numbered.join(received, [*series, "number"], "left")
        .withColumn("z_score", distance)
        .withColumn("is_anomaly", F.coalesce(F.abs("z_score") > z_limit, F.lit(False)))
        .drop("number")
    )


def rule_impact(assignments: DataFrame) -> DataFrame:
    """How many tables and columns each rule touches."""
    table = F.struct("source_id", "schema_name", "table_name")
    touched = assignments.select(
        "rule_id", table.alias("target"), F.explode("column_names").alias("column_name")
    ).distinct()
    per_table = touched.groupBy("rule_id", "target").agg(F.count(F.lit(1)).alias("column_count"))
    return per_table.groupBy("rule_id").agg(
        F.count(F.lit(1)).alias("tables"), F.sum("column_count").alias("columns")
    )


def kept_results(results: DataFrame, today: dt.date, days: int = RETENTION_DAYS) -> DataFrame:
    """Results still within the retention time."""
    return results.where(F.col("run_date") > F.lit(today - dt.timedelta(days=days)))


# Metric names and units.
METRICS = {
    "ValidationDuration": "Seconds",
    "RecordsChecked": "Count",
    "RecordsFailed": "Count",
    "ValidationStatus": "Count",
    "FailureRate": "Percent",
}


def metric_rows(results: DataFrame, source_id: str | None = None) -> DataFrame:
    """Results as long rows: dimensions, metric, value, unit."""
    checked, failed = F.col("records_checked"), F.col("records_failed")
    wide = results.select(
        F.col("rule_id").alias("RuleId"),
        F.col("assignment_id").alias("AssignmentId"),
        F.col("status").alias("Status"),
        F.lit(source_id).cast("string").alias("SourceId"),
        F.col("validation_timestamp").alias("timestamp"),
        (F.col("execution_duration_ms") / 1000.0).alias("ValidationDuration"),
        checked.cast("double").alias("RecordsChecked"),
        failed.cast("double").alias("RecordsFailed"),
        F.when(F.col("status") == "pass", 1.0).otherwise(0.0).alias("ValidationStatus"),
        F.when(checked > 0, 100.0 * failed / checked).alias("FailureRate"),
    )
    unit = F.create_map(*[F.lit(x) for pair in METRICS.items() for x in pair])
    dimensions = ["RuleId", "AssignmentId", "Status", "SourceId", "timestamp"]
    return (
        wide.unpivot(dimensions, list(METRICS), "metric", "value")
        .where("value IS NOT NULL")
        .withColumn("unit", unit[F.col("metric")])
    )


def lineage_rows(results: DataFrame, snapshot_location: str | None = None) -> DataFrame:
    """Which rules were applied to which table in which run."""
    return results.groupBy("run_id", "table_name").agg(
        F.sort_array(F.collect_set("rule_id")).alias("rules_applied"),
        F.lit(snapshot_location).cast("string").alias("snapshot_location"),
        F.max("validation_timestamp").alias("created_at"),
    )
