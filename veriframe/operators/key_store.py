"""Uniqueness over time: key counts kept in a bucketed table, to which new rows are added.

A batch brings each of its keys once, with the number of its rows, hashed into the table's buckets.
Old keys are read bucket by bucket and never shuffled again: adding up, and looking up the keys of a
new batch, only move the batch. Batches are partitions, so a batch that comes again replaces itself.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veriframe.errors import RuleError
from veriframe.functions.names import named
from veriframe.operators.integrity import key_counts
from veriframe.operators.results import Run, finish, spread_counts
from veriframe.plans.rules import Rule

BATCH = "_batch"


class KeyStore:
    """Counts of the keys of all batches so far, in a catalog table of `buckets` buckets.

    As many buckets as a shuffle has partitions, or more, keep joins from shuffling the old keys.
    """

    def __init__(self, spark: SparkSession, name: str, keys: Sequence[str], buckets: int = 200, path: str | None = None):
        self.spark, self.name, self.keys, self.buckets, self.path = spark, name, list(keys), buckets, path

    def _exists(self) -> bool:
        return self.spark.catalog.tableExists(self.name)

    def add(self, df: DataFrame, batch: str) -> None:
        """Add the keys of a batch of rows, or put them in the place of those the batch had before."""
        # dealt by bucket first, so that every bucket is one file of the batch
        counts = key_counts(df, self.keys).repartition(self.buckets, *map(named, self.keys)).withColumn(BATCH, F.lit(batch))
        if not self._exists():
            writer = counts.write.partitionBy(BATCH).bucketBy(self.buckets, *self.keys).sortBy(*self.keys)
            if self.path:
                writer = writer.option("path", self.path)
            writer.saveAsTable(self.name)
            return
        stored = [c for c in self.spark.table(self.name).columns if c not in (*self.keys, "copies", BATCH)]
        if stored:
            raise RuleError(f"{self.name} holds other keys: {', '.join(stored)}")
        before = self.spark.conf.get("spark.sql.sources.partitionOverwriteMode")
        self.spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
        try:
            counts.write.mode("overwrite").insertInto(self.name)
        finally:
            self.spark.conf.set("spark.sql.sources.partitionOverwriteMode", before)

    def counts(self, without: str | None = None) -> DataFrame:
        """Every key with the number of rows that hold it, of all batches or all but one."""
        stored = self.spark.table(self.name)
        if without is not None:
            stored = stored.where(F.col(BATCH) != without)
        return stored.groupBy(*map(named, self.keys)).agg(F.sum("copies").alias("copies"))

    def _complete(self) -> Column:
        return reduce(Column.__and__, [named(k).isNotNull() for k in self.keys])

    def check(self, rule: Rule, run: Run = Run()) -> DataFrame:
        """The result of a uniqueness rule on all rows so far; rows with an incomplete key are exempt."""
        if list(rule.columns) != self.keys:
            raise RuleError(f"{self.name} holds the keys {', '.join(self.keys)}")
        repeated = F.when(self._complete() & (F.col("copies") > 1), F.col("copies"))
        total = self.counts().agg(
            F.coalesce(F.sum("copies"), F.lit(0)).alias("checked"), F.coalesce(F.sum(repeated), F.lit(0)).alias("failed"))
        return finish(spread_counts(total, [(rule, "checked", "failed")]), run)

    def repeated_in(self, batch: str) -> DataFrame:
        """Complete keys of a batch that occur more than once by now: `copies` in the batch, `earlier` in others."""
        own = self.spark.table(self.name).where(F.col(BATCH) == batch).drop(BATCH).where(self._complete())
        others = self.counts(batch).withColumnRenamed("copies", "earlier")
        both = own.join(others, self.keys, "left").fillna(0, ["earlier"])
        return both.where(F.col("copies") + F.col("earlier") > 1)

    def known(self, df: DataFrame) -> DataFrame:
        """Keys of new rows that are in the store already, with `copies` and `earlier`; nothing is stored."""
        return key_counts(df, self.keys).join(self.counts().withColumnRenamed("copies", "earlier"), self.keys)
