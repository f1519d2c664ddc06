"""Results per time window of a stream, with an exact account of the rows that came too late.

Every batch is summed up by window and stored in a folder of its own; windows add up over batches.
The watermark of a batch is the newest time of all earlier batches less `late_by`, kept in a log
with one row for each batch. A row is late when all its windows have ended by then: it is counted
in the log and kept in a table, but not in the windows. Counts are data of the batch's own output
and not metrics of its run, so a task that is repeated, and a batch that is repeated after a
failure, leave them as they are, and any number of batches adds up.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from veriframe.errors import RuleError
from veriframe.functions.names import named
from veriframe.operators.results import Run, finish, spread_counts
from veriframe.operators.row_checks import resolve, violation
from veriframe.plans.rules import Rule
from veriframe.streaming.checks import _available

LOG_SCHEMA = "row_count bigint, rows_without_time bigint, late_rows bigint, watermark_micros bigint, newest_micros bigint"
_ATTRIBUTES = ["rule_id", "rule_name", "assignment_id", "column_names", "rule_category", "severity_level",
               "threshold_value", "error_message"]


def _micros(spark: SparkSession, interval: str) -> int:
    """Microseconds of a fixed interval such as `30 minutes`."""
    return spark.sql(f"SELECT unix_micros(timestamp'1970-01-01 00:00:00Z' + interval {interval})").first()[0]


def _last_start(time_column: str, slide: int) -> Column:
    """Start of the last window that holds a row, in microseconds; null without a time."""
    at = F.unix_micros(named(time_column).cast("timestamp"))
    return at - F.pmod(at, F.lit(slide))


def _starts(time_column: str, width: int, slide: int) -> Column:
    """Starts of all windows that hold a row, the last one first."""
    at, last = F.unix_micros(named(time_column).cast("timestamp")), _last_start(time_column, slide)
    every = F.array(*[last - k * slide for k in range(-(-width // slide))])
    return F.filter(every, lambda s: s > at - width)


def _log_of(spark: SparkSession, path: str, batch_id: int):
    """The log row of a batch, or None when there is none."""
    try:
        return spark.read.schema(LOG_SCHEMA).parquet(f"{path}/log/batch_id={batch_id}").first()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise


def check_windows(
    stream: DataFrame, rules: Sequence[Rule], time_column: str, width: str, path: str, checkpoint: str,
    slide: str | None = None, late_by: str = "0 seconds",
) -> StreamingQuery:
    """Check what is new on the stream; stores counts by window, the log and late rows below `path`.

    One scan per batch counts all rules in all windows; a second one reads late rows, if there are
    any. Rows without a time belong to no window and are only counted in the log.
    """
    spark = stream.sparkSession
    good, bad = resolve(stream, rules)
    if bad:
        raise RuleError("; ".join(f"{r.rule_id}: {m}" for r, m in bad))
    size, step = _micros(spark, width), _micros(spark, slide or width)
    if step <= 0 or size < step:
        raise RuleError(f"windows of {width} cannot start every {slide}")
    delay = _micros(spark, late_by)
    last = _last_start(time_column, step)

    newest_of: dict[int, int | None] = {}  # newest time after a batch, of those of this run

    def store(batch: DataFrame, batch_id: int) -> None:
        own = batch.sparkSession
        if batch_id - 1 not in newest_of:
            before = _log_of(own, path, batch_id - 1) if batch_id else None
            newest_of[batch_id - 1] = None if before is None else before.newest_micros
        newest = newest_of[batch_id - 1]
        watermark = None if newest is None else newest - delay
        timed = batch.withColumn("_last", last).withColumn("_start", F.explode_outer(_starts(time_column, size, step)))
        counts = timed.groupBy("_start").agg(
            F.count(F.lit(1)).alias("checked"),
            F.count_if(F.col("_start").eqNullSafe(F.col("_last"))).alias("row_count"),
            F.max(F.unix_micros(named(time_column).cast("timestamp"))).alias("newest"),
            *[F.expr(f"count_if({violation(p, r.null_policy)}) AS failed_{i}") for i, (r, p) in enumerate(good)],
        )
        closed = F.lit(False) if watermark is None else F.coalesce(F.col("_start") + size <= watermark, F.lit(False))
        counted = counts.select(
            "*", F.timestamp_micros("_start").alias("window_start"), F.timestamp_micros(F.col("_start") + size).alias("window_end"), closed.alias("late"))
        entries = [(rule, "checked", f"failed_{i}") for i, (rule, _) in enumerate(good)]
        by_window = ["window_start", "window_end", "late", "row_count", "newest"]
        folder = f"{path}/results/batch_id={batch_id}"
        spread_counts(counted, entries, by=by_window).write.mode("overwrite").parquet(folder)
        total = own.read.parquet(folder).select(*by_window).distinct().agg(
            F.coalesce(F.sum("row_count"), F.lit(0)).alias("row_count"),
            F.coalesce(F.sum(F.when(F.col("window_start").isNull(), F.col("row_count"))), F.lit(0)).alias("rows_without_time"),
            F.coalesce(F.sum(F.when(F.col("late"), F.col("row_count"))), F.lit(0)).alias("late_rows"),
            F.max("newest").alias("newest"),
        ).first()
        if total.late_rows:
            late = batch.where(F.coalesce(last + size <= watermark, F.lit(False)))
            late.write.mode("overwrite").parquet(f"{path}/late/batch_id={batch_id}")
        times = [x for x in (total.newest, newest) if x is not None]
        newest_of[batch_id] = max(times, default=None)
        row = (total.row_count, total.rows_without_time, total.late_rows, watermark, newest_of[batch_id])
        log = own.createDataFrame([row], "row_count bigint, rows_without_time bigint, late_rows bigint, watermark_micros bigint, newest_micros bigint")
        # last: the next batch goes on from here
        log.coalesce(1).write.mode("overwrite").parquet(f"{path}/log/batch_id={batch_id}")

    return _available(stream.writeStream.foreachBatch(store), checkpoint)


def window_results(spark: SparkSession, path: str, run: Run = Run()) -> DataFrame:
    """Result rows per rule and window out of all batches so far, without rows that came too late."""
    stored = spark.read.parquet(f"{path}/results").where("NOT late AND window_start IS NOT NULL")
    summed = stored.groupBy("window_start", "window_end", *_ATTRIBUTES).agg(
        F.sum("records_checked").alias("records_checked"), F.sum("records_failed").alias("records_failed"))
    return finish(summed, run, ["window_start", "window_end"])


def batch_log(spark: SparkSession, path: str) -> DataFrame:
    """One row for each batch: rows read, without a time, too late, the watermark, the newest time so far."""
    log = spark.read.schema(f"{LOG_SCHEMA}, batch_id int").parquet(f"{path}/log")
    return log.select(
        "row_count", "rows_without_time", "late_rows", F.timestamp_micros("watermark_micros").alias("watermark"),
        F.timestamp_micros("newest_micros").alias("newest"), "batch_id")


def late_rows(spark: SparkSession, path: str, schema) -> DataFrame:
    """The rows that came too late, with their batch."""
    try:
        return spark.read.parquet(f"{path}/late")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], schema).withColumn("batch_id", F.lit(0))
        raise


def late_row_count(spark: SparkSession, path: str) -> int:
    """Rows of all batches that came too late."""
    return batch_log(spark, path).agg(F.coalesce(F.sum("late_rows"), F.lit(0))).first()[0]
