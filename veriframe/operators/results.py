"""From counts to result rows: one schema for every kind of check."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veriframe.plans.rules import Rule


@dataclass(frozen=True)
class Run:
    """One execution: its id, its time, and whether low-severity failures only warn."""

    run_id: str = "adhoc"
    at: dt.datetime | None = None
    table_name: str = ""
    warn_on_low: bool = False

    @property
    def timestamp(self) -> Column:
        if self.at is None:
            return F.current_timestamp()
        return F.lit(self.at.isoformat(sep=" ")).cast("timestamp")


# Attributes a rule brings to its result row, in the order `_entry` lists them.
_ENTRY = (
    "rule_id", "rule_name", "assignment_id", "column_names", "rule_category", "severity_level",
    "threshold_value", "records_checked", "records_failed", "error_message",
)


def sql_literal(text: str | None) -> str:
    """A string as a Spark SQL literal."""
    if text is None:
        return "CAST(NULL AS STRING)"
    escaped = text.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


def _entry(rule: Rule, checked: str, failed: str, error: str | None) -> str:
    columns = ", ".join(map(sql_literal, rule.columns))
    threshold = "NULL" if rule.threshold_value is None else repr(float(rule.threshold_value))
    return ", ".join((
        sql_literal(rule.rule_id),
        sql_literal(rule.rule_name or rule.rule_id),
        sql_literal(rule.assignment_id),
        f"CAST(array({columns}) AS ARRAY<STRING>)",
        sql_literal(rule.rule_category),
        sql_literal(rule.severity_level),
        f"CAST({threshold} AS DOUBLE)",
        f"CAST({checked} AS BIGINT)",
        f"CAST({failed} AS BIGINT)",
        sql_literal(error),
    ))


def spread_counts(
    counts: DataFrame,
    good: Sequence[tuple[Rule, str, str]],
    bad: Sequence[tuple[Rule, str]] = (),
    by: Sequence[str] = (),
) -> DataFrame:
    """One row per rule out of one wide row of counts.

    `good` holds (rule, name of the checked column, name of the failed column); `bad` holds rules
    that could not be evaluated, with the reason. Rule attributes travel as literals, so no join.
    """
    entries = [_entry(rule, checked, failed, None) for rule, checked, failed in good]
    entries += [_entry(rule, "NULL", "NULL", message) for rule, message in bad]
    structs = ", ".join(f"struct({e})" for e in entries)
    return counts.select(*by, F.expr(f"inline(array({structs}))").alias(*_ENTRY))


def error_rows(spark: SparkSession, bad: Sequence[tuple[Rule, str]]) -> DataFrame:
    """Result entries for rules of which nothing could be evaluated."""
    return spread_counts(spark.range(1), [], bad)


def finish(rows: DataFrame, run: Run, by: Sequence[str] = ()) -> DataFrame:
    """Add rate, threshold and status to rows that hold checked and failed counts.

    A rule passes when its failure rate (percent) is at most its threshold, or 0 without one.
    """
    failed, checked = F.col("records_failed"), F.col("records_checked")
    error = F.col("error_message").isNotNull()
    rate = F.when(error, None).when(checked > 0, 100.0 * failed / checked).otherwise(0.0)
    within = F.coalesce(rate <= F.coalesce("threshold_value", F.lit(0.0)), F.lit(False))
    over = (
        F.when(F.col("severity_level") == "low", "warning").otherwise("fail")
        if run.warn_on_low
        else F.lit("fail")
    )
    return rows.select(
        *by,
        F.lit(run.run_id).alias("run_id"),
        "rule_id", "rule_name", "assignment_id",
        F.lit(run.table_name).alias("table_name"),
        "column_names", "rule_category", "severity_level",
        F.coalesce(checked, F.lit(0).cast("bigint")).alias("records_checked"),
        F.coalesce(failed, F.lit(0).cast("bigint")).alias("records_failed"),
        F.coalesce(checked - failed, F.lit(0).cast("bigint")).alias("records_passed"),
        F.round(rate, 4).alias("failure_rate"),
        "threshold_value",
        F.when(error, None)
        .otherwise(F.coalesce(rate <= F.col("threshold_value"), F.lit(True)))
        .alias("threshold_passed"),
        F.when(error, "error").when(within, "pass").otherwise(over).alias("status"),
        "error_message",
        F.lit(None).cast("bigint").alias("execution_duration_ms"),
        run.timestamp.alias("validation_timestamp"),
        run.timestamp.cast("date").alias("run_date"),
    )


def error_class() -> Column:
    """The class of a result row's error, without its message; null for rules that could be evaluated."""
    message = F.col("error_message")
    found = F.regexp_extract(message, r"^\[([A-Z0-9_.]+)\]", 1)
    return F.when(message.isNotNull(), F.when(found != "", found).otherwise("RULE"))
