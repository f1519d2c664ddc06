"""The same rules on a stream: split rows, results per batch, metrics per window, keys."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from veriframe.errors import RuleError
from veriframe.operators.results import Run, finish, spread_counts
from veriframe.operators.row_checks import check_rows, count_violations, resolve
from veriframe.operators.samples import split_rows
from veriframe.operators.skew import spread_join
from veriframe.operators.topk import _hashable
from veriframe.plans.rules import Rule


def file_stream(
    spark: SparkSession, folder: str, schema: StructType | str, fmt: str = "parquet",
    glob: str | None = None, files_per_batch: int | None = None,
) -> DataFrame:
    """New files of a folder as a stream."""
    reader = spark.readStream.format(fmt).schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(folder)


def split_stream(stream: DataFrame, rules: Sequence[Rule]) -> tuple[DataFrame, DataFrame]:
    """(good rows, bad rows with the ids of violated rules); stateless, for append mode."""
    return split_rows(stream, rules)


def _available(writer, checkpoint: str) -> StreamingQuery:
    """Process everything that is there now, then stop; the next run goes on from the checkpoint."""
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def catch_up(stream: DataFrame, path: str, checkpoint: str, fmt: str = "parquet") -> StreamingQuery:
    """Append what is new since the last run to files at `path`, exactly once."""
    return _available(stream.writeStream.format(fmt).outputMode("append").option("path", path), checkpoint)


def each_batch(
    stream: DataFrame,
    make: Callable[[DataFrame, int], DataFrame],
    path: str,
    checkpoint: str,
    mode: str = "append",
) -> StreamingQuery:
    """Write `make(batch, batch_id)` of every batch into a folder of its own.

    A batch that is repeated after a failure replaces its folder, so no row is stored twice.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        make(batch, batch_id).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return _available(stream.writeStream.outputMode(mode).foreachBatch(store), checkpoint)


def read_batches(spark: SparkSession, path: str) -> DataFrame | None:
    """What `each_batch` has written so far, with `batch_id`; None when no batch has run."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise


def check_batches(
    stream: DataFrame, rules: Sequence[Rule], path: str, checkpoint: str, table_name: str = ""
) -> StreamingQuery:
    """Result rows of every batch, one scan per batch."""
    def results(batch: DataFrame, batch_id: int) -> DataFrame:
        return check_rows(batch, rules, Run(run_id=f"batch-{batch_id}", table_name=table_name))

    return each_batch(stream, results, path, checkpoint)


def total_results(results: DataFrame, run: Run = Run()) -> DataFrame:
    """Results of many batches as if they had been one."""
    attributes = ["rule_id", "rule_name", "assignment_id", "column_names", "rule_category",
                  "severity_level", "threshold_value", "error_message"]
    summed = results.groupBy(*attributes).agg(
        F.sum("records_checked").alias("records_checked"),
        F.sum("records_failed").alias("records_failed"),
    )
    return finish(summed, run)


def windowed_results(
    stream: DataFrame,
    rules: Sequence[Rule],
    time_column: str,
    width: str,
    slide: str | None = None,
    late_by: str = "0 seconds",
    run: Run = Run(),
) -> DataFrame:
    """Result rows per rule and time window; the state is one row of counts per open window."""
    good, bad = resolve(stream, rules)
    if bad:
        raise RuleError("; ".join(f"{r.rule_id}: {m}" for r, m in bad))
    window = F.window(time_column, width, slide) if slide else F.window(time_column, width)
    timed = stream.withWatermark(time_column, late_by).withColumn("window", window)
    counts = count_violations(timed, good, ["window"])
    entries = [(rule, "checked", f"failed_{i}") for i, (rule, _) in enumerate(good)]
    rows = spread_counts(counts, entries, by=["window"])
    named = rows.withColumns({"window_start": F.col("window.start"), "window_end": F.col("window.end")})
    return finish(named.drop("window"), run, ["window_start", "window_end"])


def latest_windows(updates: DataFrame) -> DataFrame:
    """The newest state of each (window, rule) out of the updates of all batches."""
    key = ["window_start", "window_end", "rule_id"]
    rest = [c for c in updates.columns if c not in (*key, "batch_id")]
    newest = updates.groupBy(*key).agg(F.max_by(F.struct(*rest), "batch_id").alias("newest"))
    return newest.select(*key, "newest.*")


def repeated_keys(
    stream: DataFrame, keys: Sequence[str], time_column: str, width: str, late_by: str = "0 seconds"
) -> DataFrame:
    """Complete keys and how often they occur, per window; more than once is a violation."""
    timed = stream.withWatermark(time_column, late_by).dropna(subset=list(keys))
    counts = timed.groupBy(F.window(time_column, width).alias("window"), *keys).agg(
        F.count(F.lit(1)).alias("copies")
    )
    return counts.select(
        F.col("window.start").alias("window_start"), *keys, "copies",
        (F.col("copies") > 1).alias("is_violation"),
    )


def first_rows(stream: DataFrame, keys: Sequence[str], time_column: str, late_by: str, salts: int = 1) -> DataFrame:
    """The first row of each key; later ones are dropped while the watermark remembers the key.

    With `salts` a key's rows are first dealt to that many groups by the rows themselves, of which each
    keeps its first one; what is left of a hot key is at most one row for each group. The state
    holds up to `salts` rows more for each key.
    """
    timed = stream.withWatermark(time_column, late_by)
    if salts > 1:
        group = F.pmod(F.xxhash64(*_hashable(stream)), F.lit(salts))
        timed = timed.withColumn("_salt", group).dropDuplicatesWithinWatermark([*keys, "_salt"]).drop("_salt")
    return timed.dropDuplicatesWithinWatermark(list(keys))


def mark_orphans(
    df: DataFrame,
    parent: DataFrame,
    keys: Sequence[str],
    parent_keys: Sequence[str],
    frequent: Sequence[Row] | None = None,
) -> DataFrame:
    """Each row with `is_orphan`: its key is complete and not among the keys of a static table.

    On a stream `frequent` must be given (maybe empty); for a batch it is found by sampling.
    """
    known = parent.select(*[F.col(p).alias(k) for p, k in zip(parent_keys, keys, strict=True)])
    known = known.dropna().distinct().withColumn("_known", F.lit(True))
    complete = reduce(Column.__and__, [F.col(k).isNotNull() for k in keys])
    joined = spread_join(df, known, keys, "left", frequent)
    return joined.withColumn("is_orphan", F.col("_known").isNull() & complete).drop("_known")


def store_keys(parent: DataFrame, parent_keys: Sequence[str], path: str) -> DataFrame:
    """The distinct complete keys of a table written once, so that batches do not read all of it."""
    parent.select(*parent_keys).dropna().distinct().write.mode("overwrite").parquet(path)
    return parent.sparkSession.read.parquet(path)


def mark_orphans_per_batch(
    stream: DataFrame,
    parent: DataFrame,
    keys: Sequence[str],
    parent_keys: Sequence[str],
    path: str,
    checkpoint: str,
) -> StreamingQuery:
    """Mark orphans batch by batch, spreading keys that are frequent in the batch."""
    def marked(batch: DataFrame, _: int) -> DataFrame:
        return mark_orphans(batch, parent, keys, parent_keys)

    return each_batch(stream, marked, path, checkpoint)

