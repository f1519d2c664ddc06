"""Rules about many rows: uniqueness and foreign keys.

Both group by the key first. The partial aggregate runs before the shuffle, so a key held by a
third of all rows arrives as one row per task, and the join of a foreign key reuses the
partitioning of its aggregate.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from veriframe.functions.names import named
from veriframe.operators.results import Run, finish, spread_counts
from veriframe.operators.skew import spread_join
from veriframe.plans.rules import Rule


def _complete(keys: Sequence[str]) -> Column:
    return reduce(Column.__and__, [named(k).isNotNull() for k in keys])


def key_counts(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every key with the number of rows that hold it."""
    return df.groupBy(*map(named, keys)).agg(F.count(F.lit(1)).alias("copies"))


def _total(condition: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, F.col("copies"))), F.lit(0))


def check_unique(df: DataFrame, rule: Rule, run: Run = Run()) -> DataFrame:
    """Every member of a group of equal keys fails; keys with a null part are exempt."""
    keys = list(rule.columns)
    counts = key_counts(df, keys).agg(
        F.coalesce(F.sum("copies"), F.lit(0)).alias("checked"),
        _total(_complete(keys) & (F.col("copies") > 1)).alias("failed"),
    )
    return finish(spread_counts(counts, [(rule, "checked", "failed")]), run)


def check_primary_key(df: DataFrame, rule: Rule, run: Run = Run()) -> DataFrame:
    """Unique and without nulls: rows with an incomplete key fail too."""
    keys = list(rule.columns)
    counts = key_counts(df, keys).agg(
        F.coalesce(F.sum("copies"), F.lit(0)).alias("checked"),
        _total(~_complete(keys) | (F.col("copies") > 1)).alias("failed"),
    )
    return finish(spread_counts(counts, [(rule, "checked", "failed")]), run)


def _parent_keys(parent: DataFrame, parent_keys: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Distinct complete parent keys under the child's column names."""
    renamed = parent.select(*[named(p).alias(k) for p, k in zip(parent_keys, keys, strict=True)])
    return renamed.where(_complete(keys)).distinct()


def check_foreign_key(
    child: DataFrame, parent: DataFrame, parent_keys: Sequence[str], rule: Rule, run: Run = Run()
) -> DataFrame:
    """Rows whose key has no parent fail; a key with a null part refers to nothing and passes."""
    keys = list(rule.columns)
    known = _parent_keys(parent, parent_keys, keys).withColumn("known", F.lit(True))
    counts = (
        key_counts(child, keys)
        .join(known, keys, "left")
        .agg(
            F.coalesce(F.sum("copies"), F.lit(0)).alias("checked"),
            _total(_complete(keys) & F.col("known").isNull()).alias("failed"),
        )
    )
    return finish(spread_counts(counts, [(rule, "checked", "failed")]), run)


def duplicate_rows(
    df: DataFrame, keys: Sequence[str], frequent: Sequence[Row] | None = None
) -> DataFrame:
    """All rows whose complete key occurs more than once."""
    repeated = key_counts(df, keys).where(_complete(keys) & (F.col("copies") > 1)).drop("copies")
    return _rows_with_keys(df, keys, repeated, frequent)


def orphan_rows(
    child: DataFrame,
    parent: DataFrame,
    keys: Sequence[str],
    parent_keys: Sequence[str],
    frequent: Sequence[Row] | None = None,
) -> DataFrame:
    """All rows whose complete key has no parent."""
    return spread_join(
        child.where(_complete(keys)),
        _parent_keys(parent, parent_keys, keys),
        keys,
        "left_anti",
        frequent,
    )


def _rows_with_keys(
    df: DataFrame, keys: Sequence[str], wanted: DataFrame, frequent: Sequence[Row] | None
) -> DataFrame:
    return spread_join(df.where(_complete(keys)), wanted, keys, "left_semi", frequent)

