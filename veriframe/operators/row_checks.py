"""Rules about one row: all rules of a table are counted in a single scan."""

from __future__ import annotations

import logging
from collections.abc import Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.logger import PySparkLogger
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriframe.errors import RuleError
from veriframe.functions.ruletext import first_line, to_sql
from veriframe.operators.results import Run, finish, spread_counts
from veriframe.plans.rules import Rule

# Counts per aggregate. Hundreds of counts in one aggregate still beat a second scan; far beyond
# that the generated code grows too large, so more rules mean one more scan per this many.
RULES_PER_SCAN = 400

# From this many shuffle partitions on, counts of single tasks are merged in this many groups first.
MANY_TASKS = 1000
MERGE_GROUPS = 256


def violation(predicate: str, null_policy: str = "fail") -> str:
    """SQL that is true where the condition in parentheses does not hold, and never null.

    With `fail` an unknown outcome (null) violates the rule, with `skip` it does not.
    """
    if null_policy == "skip":
        return f"coalesce(NOT {predicate}, false)"
    return f"NOT coalesce({predicate}, false)"


def _types(df: DataFrame, predicates: Sequence[str]) -> list[str]:
    """Types of the predicates on this table; raises when Spark cannot resolve one of them."""
    quiet = PySparkLogger.getLogger("SQLQueryContextLogger")
    level = quiet.level
    quiet.setLevel(logging.CRITICAL)
    try:
        named = df.selectExpr(*[f"{p} AS p{i}" for i, p in enumerate(predicates)])
        types = [f.dataType.simpleString() for f in named.schema]
        if predicates and set(types) == {"boolean"}:
            df.where(" OR ".join(predicates))  # refuses aggregates, windows and generators
        return types
    finally:
        quiet.setLevel(level)


def _why_not(df: DataFrame, rule: Rule, predicate: str) -> str | None:
    """The reason why the predicate cannot be evaluated on this table, if there is one."""
    try:
        kind = _types(df, [predicate])[0]
    except AnalysisException as e:
        return first_line(e)
    return None if kind == "boolean" else f"rule is {kind}, not boolean: {rule.rule_logic}"


def resolve(
    df: DataFrame, rules: Sequence[Rule]
) -> tuple[list[tuple[Rule, str]], list[tuple[Rule, str]]]:
    """Split rules into (rule, SQL condition valid for `df`) and (rule, error message)."""
    parsed, bad = [], []
    for rule in rules:
        if rule.rule_type == "single_field" and len(rule.columns) > 1:
            bad.append((rule, "a single-field rule needs exactly one column"))
            continue
        try:
            parsed.append((rule, to_sql(rule.rule_logic, rule.mapping)))
        except RuleError as e:
            bad.append((rule, str(e)))
    # One analysis for all; only when it fails each rule is looked at by itself.
    try:
        if set(_types(df, [p for _, p in parsed])) <= {"boolean"}:
            return parsed, bad
    except AnalysisException:
        pass
    good = []
    for rule, predicate in parsed:
        message = _why_not(df, rule, predicate)
        if message is None:
            good.append((rule, predicate))
        else:
            bad.append((rule, message))
    return good, bad


def count_violations(
    df: DataFrame, resolved: Sequence[tuple[Rule, str]], by: Sequence[str] = ()
) -> DataFrame:
    """One wide row (per group): `checked`, and `failed_<i>` for the i-th rule."""
    failed = [
        F.expr(f"count_if({violation(predicate, rule.null_policy)}) AS failed_{i}")
        for i, (rule, predicate) in enumerate(resolved)
    ]
    counts = [F.count(F.lit(1)).alias("checked"), *failed]
    if by or not _many_tasks(df):
        return df.groupBy(*by).agg(*counts)
    # Hundreds of thousands of tasks bring one row each: merge them in groups before the last merge.
    merged = df.groupBy(F.pmod(F.spark_partition_id(), F.lit(MERGE_GROUPS)).alias("_group")).agg(*counts)
    names = ["checked", *(f"failed_{i}" for i in range(len(resolved)))]
    return merged.agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names])


def _many_tasks(df: DataFrame) -> bool:
    """Whether the session is set up for a cluster on which a scan has very many tasks."""
    if df.isStreaming:
        return False
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) >= MANY_TASKS


def check_rows(
    df: DataFrame,
    rules: Sequence[Rule],
    run: Run = Run(),
    by: Sequence[str] = (),
    rules_per_scan: int = RULES_PER_SCAN,
) -> DataFrame:
    """Result rows for row rules; with `by`, one row per rule and group (partition, day, ...)."""
    good, bad = resolve(df, rules)
    frames = []
    for start in range(0, max(len(good), 1), rules_per_scan):
        part = good[start : start + rules_per_scan]
        entries = [(rule, "checked", f"failed_{i}") for i, (rule, _) in enumerate(part)]
        failed_rules = bad if start == 0 else ()
        if part or by:
            counts = count_violations(df, part, by)
        else:
            counts = df.sparkSession.range(1)
        if entries or failed_rules:
            frames.append(spread_counts(counts, entries, failed_rules, by))
    if not frames:
        raise RuleError("no rules given")
    return finish(reduce(DataFrame.unionByName, frames), run, by)


def with_predicates(df: DataFrame, rules: Sequence[Rule], prefix: str = "ok_") -> DataFrame:
    """The table with one boolean column per rule (`true` = satisfied)."""
    good, bad = resolve(df, rules)
    if bad:
        raise RuleError("; ".join(f"{r.rule_id}: {m}" for r, m in bad))
    flags = [
        f"NOT {violation(p, r.null_policy)} AS `{prefix}{r.rule_id}`" for r, p in good
    ]
    return df.selectExpr("*", *flags)
