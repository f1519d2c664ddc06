"""The first n rows of each group, without bringing a whole group into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veriframe.functions.names import named


def top_per_group(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[Column],
    n: int,
    rank_name: str = "rank",
    spread: int = 64,
) -> DataFrame:
    """First `n` rows per group in the given order, numbered from 1.

    Ranking takes two rounds: first within `spread` parts of each group, then among the survivors
    (at most `spread * n` per group). Spark prunes to n rows before each shuffle.
    """
    part = F.pmod(F.xxhash64(*_hashable(df)), F.lit(spread))
    first = Window.partitionBy(*group, "_part").orderBy(*order)
    second = Window.partitionBy(*group).orderBy(*order)
    return (
        df.withColumn("_part", part)
        .withColumn("_rank", F.row_number().over(first))
        .where(F.col("_rank") <= n)
        .withColumn(rank_name, F.row_number().over(second))
        .where(F.col(rank_name) <= n)
        .drop("_part", "_rank")
    )


def _hashable(df: DataFrame) -> list[Column]:
    """Columns whose mix deals the rows of a group to parts."""
    kinds = [(f.name, f.dataType.simpleString()) for f in df.schema]
    return [named(c) for c, kind in kinds if "map<" not in kind and "variant" not in kind]
