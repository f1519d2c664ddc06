"""How a query is registered: its Spark function and, next to it, the equal SQL text."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from veriframe.operators.results import Run
from veriframe.plans.rules import Rule
from veriframe.session import configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

# Results carry a fixed time so that two engines can agree on them.
RUN_AT = dt.datetime(2024, 2, 1, 0, 0)

REPORT = [
    "rule_id", "table_name", "rule_category", "severity_level", "records_checked",
    "records_failed", "records_passed", "failure_rate", "threshold_value", "threshold_passed",
    "status",
]


def query(name: str, sql: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame under `name`."""

    def keep(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(configure(spark), sf_dir)

        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return fn

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def run_of(table_name: str, **kw) -> Run:
    return Run(run_id="run-1", at=RUN_AT, table_name=table_name, **kw)


def report(results: DataFrame, *extra: str) -> DataFrame:
    return results.select(*extra, *REPORT)


def rules_from(specs) -> list[Rule]:
    """Rules out of (id, columns, category, severity, threshold, text, ...) tuples."""
    return [
        Rule(
            rule_id=s[0],
            rule_logic=s[5],
            columns=tuple(s[1]),
            rule_type="single_field" if len(s[1]) == 1 else "multi_field",
            rule_category=s[2],
            severity_level=s[3],
            threshold_value=s[4],
            null_policy=s[7] if len(s) > 7 else "fail",
        )
        for s in specs
    ]


def literal(value) -> str:
    return "CAST(NULL AS DOUBLE)" if value is None else f"CAST({value} AS DOUBLE)"


def counts_sql(source: str, spec, extra: str = "", group: str = "") -> str:
    """SQL counting one rule: its attributes, rows checked, rows failed."""
    rule_id, _, category, severity, threshold, _, predicate, *policy = spec
    bad = f"NOT ({predicate})" if policy == ["skip"] else f"NOT coalesce(({predicate}), false)"
    return (
        f"SELECT {extra}'{rule_id}' AS rule_id, '{category}' AS rule_category, "
        f"'{severity}' AS severity_level, {literal(threshold)} AS threshold_value, "
        f"count(*) AS checked, count(*) FILTER (WHERE {bad}) AS failed FROM {source} {group}"
    )


def result_sql(counts: str, table_name: str, extra: str = "") -> str:
    """SQL adding rate, threshold and status to (rule attributes, checked, failed) rows."""
    return f"""
WITH counts AS ({counts}),
rates AS (SELECT *, CASE WHEN checked > 0 THEN 100.0::DOUBLE * failed / checked ELSE 0.0::DOUBLE END
          AS rate FROM counts)
SELECT {extra}rule_id, '{table_name}' AS table_name, rule_category, severity_level,
  CAST(checked AS BIGINT) AS records_checked, CAST(failed AS BIGINT) AS records_failed,
  CAST(checked - failed AS BIGINT) AS records_passed, round(rate, 4) AS failure_rate,
  threshold_value, coalesce(rate <= threshold_value, true) AS threshold_passed,
  CASE WHEN rate <= coalesce(threshold_value, 0) THEN 'pass' ELSE 'fail' END AS status
FROM rates"""


def scorecard_sql(source: str, specs, table_name: str | None = None) -> str:
    return result_sql("\nUNION ALL ".join(counts_sql(source, s) for s in specs), table_name or source)


def integrity_sql(
    rule: tuple, counts: str, table_name: str
) -> str:
    """`rule` = (id, category, severity, threshold); `counts` = SELECT checked, failed."""
    rule_id, category, severity, threshold = rule
    return result_sql(
        f"SELECT '{rule_id}' AS rule_id, '{category}' AS rule_category, '{severity}' AS "
        f"severity_level, {literal(threshold)} AS threshold_value, checked, failed FROM ({counts})",
        table_name,
    )

