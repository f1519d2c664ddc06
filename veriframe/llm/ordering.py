"""Global order and running sums of tables of any size, by range partitions.

Rows are range-partitioned and written, so every task owns one range of the order. What comes
before a range is a sum over the totals of earlier ranges, a table with one row for each range and
group; inside a range a window adds up. No task sees more than a range, however large a group is.
Orders must be total up to rows that may change places: pass a row number as last column, by which
repeated rows are spread over ranges, too.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veriframe.session import shared_folder


def written(frame: DataFrame, name: str) -> DataFrame:
    """The frame as a table in the shared folder."""
    path = shared_folder(frame.sparkSession, name)
    frame.write.parquet(path)
    return frame.sparkSession.read.parquet(path)


def ranges(frame: DataFrame, *order: Column) -> DataFrame:
    """The rows in ranges of the order; `_part` numbers the ranges."""
    return written(frame.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")


def running(rows: DataFrame, order: list[Column], values: dict[str, str], group: tuple[str, ...] = (),
            lookup: DataFrame | None = None) -> DataFrame:
    """Rows of `ranges` with running sums, `values` maps new names to columns that are added up.

    `<name>` is the sum up to and with the row, `<name>_all` that of all rows, both within rows of
    equal `group`, in which nulls are equal. Null values count as zero. `order` must begin with `group`.
    `lookup` has one row for each group; its other columns come with the group's sums, so that rows of
    a large group are not joined by their group.
    """
    sums = rows.groupBy("_part", *group).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(n) for n, c in values.items()])
    # one row for each range and group that meet, so the groups' windows hold ranges, not rows
    whole = Window.partitionBy(*group)
    earlier = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        F.col("_part").alias("_at"), *[F.col(g).alias(f"_of_{g}") for g in group],
        *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"_before_{n}") for n in values],
        *[F.sum(n).over(whole).alias(f"{n}_all") for n in values],
    )
    more = []
    if lookup is not None:
        more = [c for c in lookup.columns if c not in group]
        named = lookup.select(*[F.col(g).alias(f"_for_{g}") for g in group], *more)
        offsets = offsets.join(named, reduce(lambda a, b: a & b, [F.col(f"_of_{g}").eqNullSafe(F.col(f"_for_{g}")) for g in group]))
    own = Window.partitionBy("_part", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    met = reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"_of_{g}")) for g in group], F.col("_part") == F.col("_at"))
    summed = rows.select("*", *[F.sum(F.coalesce(c, F.lit(0))).over(own).alias(n) for n, c in values.items()])
    return summed.join(offsets, met).select(
        *rows.columns, *[(F.col(n) + F.col(f"_before_{n}")).alias(n) for n in values], *[f"{n}_all" for n in values], *more)
