"""Rows that violate rules: marked, sampled, masked, and split from the good ones."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    BooleanType, DataType, DateType, NumericType, StringType, TimestampNTZType, TimestampType,
)

from veriframe.errors import RuleError
from veriframe.functions.names import named, quoted
from veriframe.operators.results import Run, sql_literal
from veriframe.operators.row_checks import resolve, violation
from veriframe.operators.topk import top_per_group
from veriframe.plans.rules import Rule

SAMPLE_SIZE = 100
PLACE = "_rule_place"  # of a rule in the list of those that are sampled

# Types whose values can be written as SQL text and read back unchanged.
_COMPARED = (BooleanType, DateType, NumericType, StringType, TimestampNTZType, TimestampType)


def _violations(df: DataFrame, rules: Sequence[Rule]) -> list[tuple[Rule, str]]:
    good, _ = resolve(df, rules)
    if not good:
        raise RuleError("no rule can be evaluated on this table")
    return [(rule, violation(predicate, rule.null_policy)) for rule, predicate in good]


def _ids(violations: Sequence[tuple[Rule, str]]) -> str:
    """SQL array with the id of each violated rule, and null for each satisfied one."""
    hits = (f"CASE WHEN {v} THEN {sql_literal(rule.rule_id)} END" for rule, v in violations)
    return f"array({', '.join(hits)})"


def _any(violations: Sequence[tuple[Rule, str]]) -> str:
    return " OR ".join(f"({v})" for _, v in violations)


def mark_violations(df: DataFrame, rules: Sequence[Rule], name: str = "violated") -> DataFrame:
    """The table with an array of the ids of all rules each row violates."""
    return df.withColumn(name, F.expr(f"array_compact({_ids(_violations(df, rules))})"))


def split_rows(df: DataFrame, rules: Sequence[Rule]) -> tuple[DataFrame, DataFrame]:
    """(rows satisfying every rule, rows violating at least one with the ids of those rules).

    Both are plain filters; ids are only put together for rows that violate something.
    """
    violations = _violations(df, rules)
    bad = df.where(_any(violations))
    ids = F.expr(f"array_compact({_ids(violations)})")
    return df.where(f"NOT ({_any(violations)})"), bad.withColumn("violated", ids)


def store_split(df: DataFrame, rules: Sequence[Rule], path: str) -> tuple[DataFrame, DataFrame]:
    """Good and bad rows written below `path` in one scan and one write, and read back as by `split_rows`.

    The folders are `rows=good` and `rows=bad`; good rows have an empty list of violated rules there.
    """
    violations = _violations(df, rules)
    marked = df.withColumns({
        "violated": F.when(F.expr(_any(violations)), F.expr(f"array_compact({_ids(violations)})")).otherwise(F.array().cast("array<string>")),
        "rows": F.when(F.expr(_any(violations)), "bad").otherwise("good")})
    # both parts are replaced, also one that no row falls into any more
    marked.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("rows").parquet(path)
    stored = df.sparkSession.read.schema(marked.schema).parquet(path)
    return stored.where("rows = 'good'").select(*map(named, df.columns)), stored.where("rows = 'bad'").drop("rows")


def violating_rows(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """One row per row and rule it violates, with `rule_id`."""
    return _exploded(df, _violations(df, rules))


def _exploded(df: DataFrame, violations: Sequence[tuple[Rule, str]]) -> DataFrame:
    exploded = df.where(_any(violations)).withColumn("rule_id", F.explode(F.expr(_ids(violations))))
    return exploded.where("rule_id IS NOT NULL")


def _by_place(df: DataFrame, violations: Sequence[tuple[Rule, str]]) -> DataFrame:
    """One row per row and violated entry of the list, with its place there: a rule may be assigned twice."""
    hits = ", ".join(f"CASE WHEN {v} THEN {i} END" for i, (_, v) in enumerate(violations))
    exploded = df.where(_any(violations)).withColumn(PLACE, F.explode(F.expr(f"array({hits})")))
    return exploded.where(f"{PLACE} IS NOT NULL")


def masked(column: str, method: str) -> Column:
    """A sensitive value made unreadable: `hash`, `mask` (shape kept) or `redact`."""
    c = named(column).cast("string")
    if method == "hash":
        return F.sha2(c, 256)
    if method == "mask":
        return F.mask(c)
    if method == "redact":
        return F.when(c.isNotNull(), F.lit("***"))
    raise ValueError(f"unknown masking method: {method}")


def mask_columns(df: DataFrame, sensitive: Mapping[str, str]) -> DataFrame:
    """The table with sensitive columns replaced by their masked text."""
    return df.withColumns({c: masked(c, how) for c, how in sensitive.items()}) if sensitive else df


def _value(value, data_type: DataType) -> str:
    """A value of a row as SQL; its type is that of the column it comes from."""
    kind = data_type.simpleString()
    if value is None:
        return f"CAST(NULL AS {kind})"
    if kind == "timestamp":  # microseconds: a moment on its way through Python knows no time zone
        return f"timestamp_micros({value})"
    if isinstance(value, float) and not math.isfinite(value):
        return f"CAST('{value}' AS {kind})"
    return f"CAST({sql_literal(value if isinstance(value, str) else str(value))} AS {kind})"


def _bounded(
    df: DataFrame, violations: Sequence[tuple[Rule, str]], key: Sequence[str], n: int, fraction: float
) -> list[tuple[Rule, str]]:
    """Violations that can be among the first `n` of their rule.

    The n-th violation of some of the rows cannot come before the n-th of all rows. So the n-th
    one of a small share of the table bounds each rule, and rows behind it need not be sorted. A
    rule with fewer violations in that share stays as it is.
    """
    types = {f.name: f.dataType for f in df.schema}
    if any(not isinstance(types[k], _COMPARED) for k in key):
        return list(violations)
    columns = [named(k) for k in key]
    some = _by_place(df.sample(fraction=fraction, seed=11), violations).select(PLACE, *columns)
    last = top_per_group(some, [PLACE], columns, n).where(F.col("rank") == n)
    moments = {k: F.unix_micros(named(k)) for k in key if types[k].simpleString() == "timestamp"}
    last = last.withColumns(moments).collect() if moments else last.collect()
    row = "struct(" + ", ".join(map(quoted, key)) + ")"
    bounds = {
        r[PLACE]: "struct(" + ", ".join(_value(r[k], types[k]) for k in key) + ")" for r in last
    }
    return [
        (rule, f"({v}) AND {row} <= {bounds[i]}" if i in bounds else v)
        for i, (rule, v) in enumerate(violations)
    ]


def sample_violations(
    df: DataFrame,
    rules: Sequence[Rule],
    key: Sequence[str],
    sample_size: int = SAMPLE_SIZE,
    sensitive: Mapping[str, str] | None = None,
    run: Run = Run(),
    bound_from: float = 0.01,
) -> DataFrame:
    """At most `sample_size` failing rows per rule and assignment, the first ones by `key`.

    Every entry of `rules` has a sample of its own, also where one rule is listed for several columns.
    Places of violated entries are exploded from one scan; a share `bound_from` of the table tells
    beforehand which rows come too late to be in the sample. The record, JSON of the columns the
    rule is assigned to, is only rendered for rows that stay.
    """
    wanted = [c for c in dict.fromkeys([*key, *(c for r in rules for c in r.columns)])]
    violations = _violations(df, rules)
    if bound_from:
        violations = _bounded(df, violations, key, sample_size, bound_from)
    exploded = _by_place(df, violations).select(PLACE, *[named(c) for c in wanted if c in df.columns])
    ranked = top_per_group(exploded, [PLACE], [named(k) for k in key], sample_size)
    shown = mask_columns(ranked, {c: m for c, m in (sensitive or {}).items() if c in wanted})
    record = F.lit(None).cast("string")
    for i, (rule, _) in enumerate(violations):
        columns = [c for c in rule.columns if c in df.columns] or list(key)
        record = F.when(
            F.col(PLACE) == i, F.to_json(F.struct(*map(named, columns)), {"ignoreNullFields": "false"})
        ).otherwise(record)
    entries = ", ".join(
        f"struct({sql_literal(r.rule_id)}, {sql_literal(r.assignment_id)}, "
        f"CAST(array({', '.join(map(sql_literal, r.columns))}) AS ARRAY<STRING>))" for r, _ in violations)
    entry = F.expr(f"element_at(array({entries}), {PLACE} + 1)")
    return shown.select(
        F.lit(run.run_id).alias("run_id"),
        entry["col1"].alias("rule_id"),
        "rank",
        F.to_json(F.struct(*map(named, key)), {"ignoreNullFields": "false"}).alias("record_key"),
        record.alias("record"),
        run.timestamp.cast("date").alias("run_date"),
        entry["col2"].alias("assignment_id"),
        entry["col3"].alias("column_names"),
    )


def attach_samples(results: DataFrame, samples: DataFrame) -> DataFrame:
    """Results with `sample_failed_records`; each list is as short as the sample it comes from.

    A result and a sample belong together by rule, assignment and columns.
    """
    lists = samples.groupBy(
        F.col("rule_id").alias("_rule"), F.col("assignment_id").alias("_assignment"), F.col("column_names").alias("_columns")
    ).agg(F.sort_array(F.collect_list(F.struct("rank", "record"))).alias("ranked"))
    same = (
        (F.col("rule_id") == F.col("_rule")) & F.col("assignment_id").eqNullSafe(F.col("_assignment"))
        & F.col("column_names").eqNullSafe(F.col("_columns"))
    )
    return (
        results.join(lists, same, "left")
        .withColumn(
            "sample_failed_records",
            F.coalesce(F.col("ranked.record"), F.array().cast("array<string>")),
        )
        .drop("ranked", "_rule", "_assignment", "_columns")
    )
