"""Exact quantiles by radix selection: a histogram of leading digits a pass, for all columns and ranks.

Numbers are dealt to buckets by a function that never falls: in the first pass by sign and by parts
of an octave, that is by their leading bits, then by equal steps between the smallest and the largest
number of a bucket. A pass counts all buckets in one scan, summed up before the shuffle, and keeps
for each rank the bucket that holds it. A bucket whose smallest and largest number are equal is the
answer. No value is ever sorted, and whatever the numbers are, a pass splits every bucket it reads.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veriframe.functions.names import named

OCTAVE_PARTS = 64
BUCKETS = 4096
_BEYOND = 1 << 20  # more than the parts of all octaves


def number(column: str) -> Column:
    """The column as a number; NaN is not one."""
    value = named(column).cast("double")
    return F.when(~F.isnan(value), value)


def _leading(x: Column) -> Column:
    """Bucket of the first pass: sign and part of an octave."""
    size = F.abs(x)
    part = F.when(size == float("inf"), F.lit(_BEYOND)).otherwise(F.floor(F.log2(size) * OCTAVE_PARTS).cast("bigint")) + 2 * _BEYOND
    return F.when(x > 0, part).when(x < 0, -part).otherwise(F.lit(0).cast("bigint"))


def _between(x: Column, low: float, high: float) -> Column:
    """Bucket of a later pass. The bounds come from one part of an octave: no difference overflows or vanishes."""
    return F.floor((x - F.lit(low)) / F.lit(high - low) * BUCKETS).cast("bigint")


@dataclass
class Bracket:
    """Numbers of a column between two bounds that hold a rank, counted from the bracket's first number."""

    column: str
    low: float | None = None  # no bounds: all numbers
    high: float | None = None

    def bucket(self) -> Column:
        x = number(self.column)
        if self.low is None:
            return _leading(x)
        return F.when(x.between(F.lit(self.low), F.lit(self.high)), _between(x, self.low, self.high))


def _histogram(df: DataFrame, brackets: Sequence[Bracket]) -> DataFrame:
    """(bracket, bucket, rows, low, high) of all brackets, one scan."""
    dealt = F.array(*[
        F.struct(F.lit(i).alias("bracket"), b.bucket().alias("bucket"), number(b.column).alias("x"))
        for i, b in enumerate(brackets)
    ])
    return df.select(F.inline(dealt)).where("bucket IS NOT NULL AND x IS NOT NULL").groupBy("bracket", "bucket").agg(
        F.count(F.lit(1)).alias("rows"), F.min("x").alias("low"), F.max("x").alias("high"))


def _buckets_of(df: DataFrame, brackets: Sequence[Bracket], wanted: Sequence[Column]) -> list:
    """The bucket of each wanted rank: (bracket, place of the rank, rank in the bucket, low, high)."""
    by_bucket = Window.partitionBy("bracket").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    # a window holds the buckets of one bracket, whose number is bounded, whatever the table is
    counted = _histogram(df, brackets).withColumn("up_to", F.sum("rows").over(by_bucket)).withColumn(
        "total", F.sum("rows").over(Window.partitionBy("bracket")))
    ranks = F.element_at(F.array(*wanted), F.col("bracket") + 1)
    placed = counted.select("*", F.posexplode(ranks).alias("place", "rank"))
    held = placed.where("rank <= up_to AND rank > up_to - rows")
    return held.select("bracket", "place", (F.col("rank") - F.col("up_to") + F.col("rows")).alias("rank"), "low", "high").collect()


def quantiles(
    df: DataFrame, columns: Sequence[str], probabilities: Sequence[float]
) -> dict[str, list[float | None]]:
    """Exact quantiles: the value at rank ceil(p * n) of the numbers of each column, None without numbers.

    Infinite numbers are in order with the others; -0.0 and 0.0 are equal. One row for each column and
    probability reaches the driver in every pass.
    """
    found: dict[tuple[str, int], float] = {}
    first = F.array(*[F.greatest(F.lit(1), F.ceil(F.col("total") * F.lit(p))).cast("bigint") for p in probabilities])
    brackets = [Bracket(c) for c in dict.fromkeys(columns)]
    # for each bracket: which (column, probability) its ranks stand for
    meant = [[(b.column, i) for i in range(len(probabilities))] for b in brackets]
    wanted: list[Column] = [first] * len(brackets)
    while brackets and probabilities:
        inside: dict[tuple, list] = {}
        for row in _buckets_of(df, brackets, wanted):
            column, place = meant[row.bracket][row.place]
            if row.low == row.high:
                found[column, place] = row.low
            else:
                inside.setdefault((column, row.low, row.high), []).append((place, row["rank"]))
        brackets = [Bracket(*key) for key in inside]
        meant = [[(key[0], place) for place, _ in ranks] for key, ranks in inside.items()]
        wanted = [F.array(*[F.lit(rank).cast("bigint") for _, rank in ranks]) for ranks in inside.values()]
    return {c: [found.get((c, i)) for i in range(len(probabilities))] for c in columns}
