"""Timeliness of a whole table, and the rows that are new since the last check."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriframe.functions.predicates import is_fresh
from veriframe.operators.results import Run, finish, spread_counts
from veriframe.plans.rules import Rule


def check_freshness(
    df: DataFrame, rule: Rule, max_age_days: int, reference: Column | None = None, run: Run = Run()
) -> DataFrame:
    """All rows fail when the newest value of the rule's column is too old (or there is none)."""
    newest = df.agg(F.count(F.lit(1)).alias("checked"), F.max(rule.columns[0]).alias("newest"))
    fresh = F.coalesce(is_fresh(F.col("newest"), max_age_days, reference), F.lit(False))
    counts = newest.withColumn("failed", F.when(fresh, 0).otherwise(F.col("checked")))
    return finish(spread_counts(counts, [(rule, "checked", "failed")]), run)


def last_value(df: DataFrame, column: str):
    """The highest value seen so far (one row reaches the driver), or None."""
    return df.agg(F.max(column)).first()[0]


def rows_since(df: DataFrame, column: str, since: dt.datetime | dt.date | int | None) -> DataFrame:
    """Only rows newer than `since`; a plain literal filter, so files and partitions are skipped."""
    return df if since is None else df.where(F.col(column) > F.lit(since))


def rows_of_partitions(df: DataFrame, column: str, values: list) -> DataFrame:
    """Only the named partitions; pruned when `column` is a partition column."""
    return df.where(F.col(column).isin(list(values)))
