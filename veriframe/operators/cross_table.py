"""Rules over two tables: a condition on joined rows, and the comparison of their totals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from veriframe.functions.names import named
from veriframe.operators.results import Run, error_rows, finish, spread_counts
from veriframe.operators.row_checks import count_violations, resolve
from veriframe.operators.skew import spread_join
from veriframe.plans.rules import Rule


def joined(
    left: DataFrame,
    right: DataFrame,
    left_keys: Sequence[str],
    right_keys: Sequence[str],
    frequent: Sequence[Row] | None = None,
) -> DataFrame:
    """Rows of both tables with equal keys, all columns of both, hot keys of either side spread out.

    Columns of the same name are told apart as `left.name` and `right.name`; a key of the same name
    on both sides is one column.
    """
    on = []
    left, right = left.alias("left"), right.alias("right")
    for i, (key, other) in enumerate(zip(left_keys, right_keys, strict=True)):
        if key == other:
            on.append(key)
        else:
            on.append(f"_key{i}")
            left, right = left.withColumn(on[-1], named(key)), right.withColumn(on[-1], named(other))
    return spread_join(left, right, on, "inner", frequent).drop(*[k for k in on if k.startswith("_key")])


def check_cross_table(
    left: DataFrame,
    right: DataFrame,
    left_keys: Sequence[str],
    right_keys: Sequence[str],
    rules: Sequence[Rule],
    run: Run = Run(),
    frequent: Sequence[Row] | None = None,
) -> DataFrame:
    """Row rules over each pair of rows with equal keys; rows without a partner are not checked.

    All rules of the same pair of tables share one join.
    """
    pairs = joined(left, right, left_keys, right_keys, frequent)
    good, bad = resolve(pairs, rules)
    if not good:
        return finish(error_rows(left.sparkSession, bad), run)
    counts = count_violations(pairs, good)
    entries = [(rule, "checked", f"failed_{i}") for i, (rule, _) in enumerate(good)]
    return finish(spread_counts(counts, entries, bad), run)


def check_totals(
    left: DataFrame,
    right: DataFrame,
    left_keys: Sequence[str],
    right_keys: Sequence[str],
    left_value: Column,
    right_value: Column,
    rule: Rule,
    run: Run = Run(),
    tolerance: float = 0.005,
) -> DataFrame:
    """Per key, the total on both sides must agree; a key missing on one side fails.

    Both sides are aggregated to one row per key before they meet.
    """
    names = [f"k{i}" for i in range(len(left_keys))]

    def totals(df, keys, value, name):
        renamed = [F.col(k).alias(n) for k, n in zip(keys, names, strict=True)]
        return df.groupBy(*renamed).agg(F.sum(value).alias(name))

    both = totals(left, left_keys, left_value, "left_total").join(
        totals(right, right_keys, right_value, "right_total"), names, "full"
    )
    agrees = F.abs(F.col("left_total") - F.col("right_total")) <= tolerance
    counts = both.agg(
        F.count(F.lit(1)).alias("checked"),
        F.count_if(~F.coalesce(agrees, F.lit(False))).alias("failed"),
    )
    return finish(spread_counts(counts, [(rule, "checked", "failed")]), run)


def check_row_counts(
    left: DataFrame, right: DataFrame, rule: Rule, run: Run = Run()
) -> DataFrame:
    """Both tables hold the same number of rows; the difference counts as failed."""
    sides = left.select(F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(
        right.select(F.lit(0).alias("l"), F.lit(1).alias("r"))
    )
    counts = sides.agg(
        F.coalesce(F.greatest(F.sum("l"), F.sum("r")), F.lit(0)).alias("checked"),
        F.coalesce(F.abs(F.sum("l") - F.sum("r")), F.lit(0)).alias("failed"),
    )
    return finish(spread_counts(counts, [(rule, "checked", "failed")]), run)
