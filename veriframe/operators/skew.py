"""Joins that stay balanced when a few keys hold a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from veriframe.functions.names import named
from veriframe.operators.topk import _hashable

# A key is only worth splitting when it alone would keep one task busy much longer than the rest.
# At most this many keys are split, so the list of them has a fixed size bound.
MAX_FREQUENT_KEYS = 256
MIN_SAMPLED_COPIES = 100
SALTS = 32
SALT_CLASSES = (2, 8, 32, 128, 512)


def key_shares(
    df: DataFrame, keys: Sequence[str], fraction: float = 0.01, top: int = MAX_FREQUENT_KEYS
) -> list[tuple[Row, float]]:
    """The most frequent keys of a sample, at most `top` of them, and their shares of its rows.

    The sample only decides how rows are spread over tasks. Which keys it finds never changes a
    result, so a key it misses costs time, not rows.
    """
    columns = [named(k) for k in keys]
    complete = reduce(Column.__and__, [c.isNotNull() for c in columns])
    sampled = df.select(*columns).sample(fraction=fraction, seed=7)
    counts = sampled.groupBy(*columns).agg(F.count(F.lit(1)).alias("_copies"))
    found = (
        counts.where((F.col("_copies") >= MIN_SAMPLED_COPIES) & complete)
        .orderBy(F.desc("_copies"), *columns)
        .limit(min(top, MAX_FREQUENT_KEYS))
        .collect()
    )
    # the share among the listed keys, so never less than that of all rows
    total = sum(row["_copies"] for row in found)
    return [(Row(*keys)(*row[:len(keys)]), row["_copies"] / total) for row in found]


def frequent_keys(
    df: DataFrame, keys: Sequence[str], fraction: float = 0.01, top: int = MAX_FREQUENT_KEYS
) -> list[Row]:
    """The most frequent keys of a sample, at most `top` of them."""
    return [row for row, _ in key_shares(df, keys, fraction, top)]


def is_frequent(keys: Sequence[str], frequent: Sequence[Row]) -> Column:
    """Whether the row's key is one of the given ones."""
    if not frequent:
        return F.lit(False)
    if len(keys) == 1:
        return F.coalesce(named(keys[0]).isin([row[0] for row in frequent]), F.lit(False))
    matches = [
        reduce(Column.__and__, [named(k) == F.lit(v) for k, v in zip(keys, row, strict=True)])
        for row in frequent
    ]
    return F.coalesce(reduce(Column.__or__, matches), F.lit(False))


def _classes(df: DataFrame, shares: Sequence[tuple[Row, float]]) -> list[tuple[int, list[Row]]]:
    """Keys by the number of groups each is dealt to: twice the tasks its share would fill, rounded up to a class."""
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    classes: dict[int, list[Row]] = {}
    for row, share in shares:
        wanted = 2 * share * tasks
        classes.setdefault(next((n for n in SALT_CLASSES if n >= wanted), SALT_CLASSES[-1]), []).append(row)
    return sorted(classes.items())


def _groups(on: Sequence[str], classes: Sequence[tuple[int, Sequence[Row]]]) -> Column:
    """The number of groups of the row's key; 1 for keys that are not frequent."""
    groups = F.lit(1)
    for n, rows in classes:
        groups = F.when(is_frequent(on, rows), F.lit(n)).otherwise(groups)
    return groups


def _own_group(df: DataFrame, on: Sequence[str], classes) -> Column:
    """A group by the row itself and its partition: sorted rows use all groups, and so do equal rows of several tasks.

    Both are the same when a task is repeated.
    """
    mixed = F.xxhash64(*_hashable(df), F.spark_partition_id())
    return F.pmod(mixed, _groups(on, classes)).cast("int") if classes else F.lit(0)


def _all_groups(on: Sequence[str], classes) -> Column:
    return F.explode(F.sequence(F.lit(0), _groups(on, classes) - 1)) if classes else F.lit(0)


def spread_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    frequent: Sequence[Row] | None = None,
    salts: int = SALTS,
    right_frequent: Sequence[Row] | None = None,
) -> DataFrame:
    """Equi-join (inner, left, left_semi, left_anti) with frequent keys spread over tasks.

    Left rows of a key that is frequent on the left are dealt to groups, and only the right rows of
    those keys are repeated once per group: every left row still meets every right row of its key,
    exactly once. Inner joins treat keys that are frequent on the right in the same way; a key that is
    frequent on both sides has groups in both directions. For semi and anti joins the right side only
    needs each key once. Without lists of frequent keys both sides are sampled, and a key gets groups
    in proportion to its share; keys that are given get `salts` groups each. All other keys take an
    ordinary shuffle join.
    """
    on = list(on)
    if frequent is None:
        left_classes = _classes(left, key_shares(left, on))
        if how == "inner" and right_frequent is None:
            right_classes = _classes(right, key_shares(right, on))
        else:
            right_classes = [(salts, right_frequent)] if right_frequent else []
    else:
        left_classes = [(salts, frequent)] if frequent else []
        right_classes = [(salts, right_frequent)] if right_frequent else []
    if right_classes and how != "inner":
        raise ValueError("only an inner join can spread keys of its right side")
    if how in ("left_semi", "left_anti"):
        right = right.select(*map(named, on)).distinct()
    if not left_classes and not right_classes:
        return left.join(right, on, how)
    dealt = left.withColumn("_salt", _own_group(left, on, left_classes)).withColumn("_other", _all_groups(on, right_classes))
    repeated = right.withColumn("_other", _own_group(right, on, right_classes)).withColumn("_salt", _all_groups(on, left_classes))
    return dealt.join(repeated, [*on, "_salt", "_other"], how).drop("_salt", "_other")
