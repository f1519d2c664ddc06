"""Column profiles, value patterns, suggested rules and anomalous values."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veriframe.functions.names import named
from veriframe.operators.selection import number, quantiles
from veriframe.operators.sketches import distinct_values, value_digest
from veriframe.operators.topk import top_per_group

QUANTILES = (0.25, 0.5, 0.75)
QUANTILE_ACCURACY = 10_000
MAX_LISTED_VALUES = 20
COLUMNS_PER_SCAN = 10
DISTINCT_ERROR = 0.01  # relative, one standard deviation


def _kind(data_type: T.DataType) -> str:
    if isinstance(data_type, T.NumericType):
        return "number"
    if isinstance(data_type, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "time"
    return "text" if isinstance(data_type, (T.StringType, T.BooleanType)) else "other"


def _null(kind: str) -> Column:
    return F.lit(None).cast(kind)


def _moments(column: str, data_type: T.DataType) -> Column:
    """Statistics that Spark aggregates in generated code."""
    c, kind = named(column), _kind(data_type)
    number = c.cast("double") if kind == "number" else None
    when = c.cast("timestamp") if kind == "time" else None
    length = F.length(c.cast("string")) if kind == "text" else None

    def each(value, default, **aggregates):
        return [
            (f(value) if value is not None else _null(default)).alias(name)
            for name, f in aggregates.items()
        ]

    return F.struct(
        F.lit(column).alias("column_name"),
        F.lit(data_type.simpleString()).alias("data_type"),
        F.count(F.lit(1)).alias("row_count"),
        F.count_if(c.isNull()).alias("null_count"),
        *each(number, "double", min_value=F.min, max_value=F.max, mean_value=F.avg,
              stddev_value=F.stddev_samp),
        *each(when, "timestamp", min_time=F.min, max_time=F.max),
        *each(length, "int", max_length=F.max),
    )


def _sketches(column: str, data_type: T.DataType, distinct: bool) -> Column:
    """Statistics with a buffer of their own: distinct values, quartiles, first and last text."""
    c, kind = named(column), _kind(data_type)
    quartiles = F.percentile_approx(c.cast("double"), list(QUANTILES), QUANTILE_ACCURACY)
    text = c.cast("string")
    return F.struct(
        F.lit(column).alias("column_name"),
        (F.approx_count_distinct(value_digest(column, data_type) if kind == "other" else c, DISTINCT_ERROR) if distinct
         else _null("bigint")).alias("distinct_count"),
        (quartiles if kind == "number" else _null("array<double>")).alias("quantiles"),
        (F.min(text) if kind == "text" else _null("string")).alias("min_text"),
        (F.max(text) if kind == "text" else _null("string")).alias("max_text"),
    )


def _per_column(df: DataFrame, columns: Sequence[str], statistics) -> DataFrame:
    """One row per column. A wide table is read in groups of columns, each column in one of them,
    because an aggregate over very many values is not compiled."""
    fields = {f.name: f.dataType for f in df.schema}
    frames = []
    for start in range(0, len(columns), COLUMNS_PER_SCAN):
        group = columns[start : start + COLUMNS_PER_SCAN]
        one = df.agg(*[statistics(c, fields[c]).alias(f"c{i}") for i, c in enumerate(group)])
        frames.append(one.select(F.inline(F.array(*one.columns))))
    return reduce(DataFrame.unionByName, frames)


def profile(
    df: DataFrame, columns: Sequence[str] | None = None, distinct: str = "approx"
) -> DataFrame:
    """One row per column: counts, nulls, distinct values, bounds, moments, quartiles, lengths.

    Counts and moments take one compiled scan, sketches another: together they would run
    uncompiled. With `distinct="exact"` distinct counts come from grouping digests of values of any
    type, pre-aggregated before the shuffle.
    """
    wanted = list(columns or df.columns)
    rows = _per_column(df, wanted, _moments).join(
        _per_column(df, wanted, lambda c, t: _sketches(c, t, distinct == "approx")), "column_name"
    )
    if distinct != "exact":
        return rows
    return rows.drop("distinct_count").join(distinct_values(df, wanted), "column_name")


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, value as text, copies) for every distinct value that is not null."""
    fields = {f.name: f.dataType for f in df.schema}
    countable = [c for c in columns if _kind(fields[c]) != "other"]
    pairs = F.array(*[
        F.struct(F.lit(c).alias("column_name"), named(c).cast("string").alias("value"))
        for c in countable
    ])
    return (
        df.select(F.inline(pairs))
        .where("value IS NOT NULL")
        .groupBy("column_name", "value")
        .agg(F.count(F.lit(1)).alias("copies"))
    )


def distinct_counts(counts: DataFrame) -> DataFrame:
    return counts.groupBy("column_name").agg(F.count(F.lit(1)).alias("distinct_count"))


def top_values(df: DataFrame, columns: Sequence[str], n: int = 10) -> DataFrame:
    """The n most frequent values of each column."""
    order = [F.desc("copies"), F.asc("value")]
    return top_per_group(value_counts(df, columns), ["column_name"], order, n)


# Letters and digits, and what stands for them in a shape.
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWER = _UPPER.lower()
_DIGITS = "0123456789"
_SHAPE_FROM = _UPPER + _LOWER + _DIGITS
_SHAPE_TO = "A" * 26 + "a" * 26 + "9" * 10


def shape(c: Column) -> Column:
    """The value with letters and digits replaced by A, a and 9."""
    return F.translate(c, _SHAPE_FROM, _SHAPE_TO)


def patterns(df: DataFrame, columns: Sequence[str], n: int = 10) -> DataFrame:
    """The n most frequent shapes of each text column, with the share of rows that have them."""
    shapes = df.select(*[shape(named(c)).alias(c) for c in columns])
    return top_values(shapes, columns, n).withColumnRenamed("value", "pattern")


def suggest_rules(df: DataFrame, max_values: int = MAX_LISTED_VALUES) -> DataFrame:
    """Rules the data satisfies today: not null, unique, in list, range; one row each.

    The suggestion is rule text that can be stored as it is.
    """
    stats = profile(df, distinct="exact")
    fields = {f.name: f.dataType for f in df.schema}
    counts = value_counts(df, df.columns)
    few = (
        distinct_counts(counts).where(F.col("distinct_count") <= max_values).select("column_name")
    )
    # At most one row per column of the table on this side, and `max_values` values per list.
    listed = (
        counts.join(F.broadcast(few), "column_name")
        .groupBy("column_name")
        .agg(F.sort_array(F.collect_list("value")).alias("listed"))
    )
    numbers = [c for c, t in fields.items() if _kind(t) == "number"]
    texts = [c for c, t in fields.items() if _kind(t) == "text"]
    c = F.concat(F.lit("col('"), "column_name", F.lit("')"))
    full = (F.col("null_count") == 0) & (F.col("row_count") > 0)
    unique = full & (F.col("distinct_count") == F.col("row_count"))
    quoted = F.transform(
        "listed", lambda v: F.concat(F.lit("'"), F.replace(v, F.lit("'"), F.lit("\\'")), F.lit("'"))
    )
    span = F.concat(
        F.lit("range_check("), c, F.lit(", "), F.col("min_value").cast("string"), F.lit(", "),
        F.col("max_value").cast("string"), F.lit(")"),
    )

    def suggestion(name, category, when, text):
        return F.when(
            when,
            F.struct(F.lit(name).alias("suggestion"), F.lit(category).alias("rule_category"),
                     text.alias("rule_logic")),
        )

    found = F.array_compact(F.array(
        suggestion("not_null", "completeness", full, F.concat(F.lit("is_not_null("), c, F.lit(")"))),
        suggestion("unique", "integrity", unique, F.concat(F.lit("unique("), c, F.lit(")"))),
        suggestion(
            "in_list", "accuracy", F.col("listed").isNotNull() & F.col("column_name").isin(texts),
            F.concat(F.lit("is_in_list("), c, F.lit(", ["), F.concat_ws(", ", quoted), F.lit("])")),
        ),
        suggestion(
            "range", "accuracy",
            F.col("column_name").isin(numbers) & F.col("min_value").isNotNull(), span,
        ),
    ))
    return stats.join(listed, "column_name", "left").select(
        "column_name", F.inline(found)
    )


def outlier_bounds(df: DataFrame, columns: Sequence[str], method: str = "iqr", k: float | None = None):
    """{column: (low, high)} of usual values: quartiles +- k*IQR, or mean +- k*stddev.

    A few numbers reach the driver, so that the bounds can be literals pushed down to the scan.
    """
    k = k if k is not None else (1.5 if method == "iqr" else 3.0)
    if method == "iqr":
        pairs = quantiles(df, columns, [0.25, 0.75])
    else:
        pairs = df.agg(*[
            F.array(F.avg(number(c)), F.stddev_samp(number(c))).alias(c) for c in columns
        ]).first().asDict()
    bounds = {}
    for c, (a, b) in pairs.items():
        if a is not None and b is not None:
            bounds[c] = (a - k * (b - a), b + k * (b - a)) if method == "iqr" else (a - k * b, a + k * b)
    return bounds


def outliers(df: DataFrame, columns: Sequence[str], method: str = "iqr", k: float | None = None) -> DataFrame:
    """Rows with an unusual value, with the names of the columns that hold one."""
    bounds = outlier_bounds(df, columns, method, k)
    unusual = F.array_compact(F.array(*[
        F.when(~named(c).between(F.lit(low), F.lit(high)), F.lit(c)) for c, (low, high) in bounds.items()
    ])).cast("array<string>")
    return df.withColumn("unusual", unusual).where(F.size("unusual") > 0)


def recommend_rules(columns: DataFrame, history: DataFrame, min_uses: int = 1) -> DataFrame:
    """Rules used before on columns of the same name and type, best first.

    `columns` has (column_name, data_type); `history` has (column_name, data_type, rule_logic,
    failure_rate), one row per past result. The history is summed up before it is joined.
    """
    used = (
        history.groupBy("column_name", "data_type", "rule_logic")
        .agg(F.count(F.lit(1)).alias("uses"), F.round(F.avg("failure_rate"), 4).alias("mean_failure_rate"))
        .where(F.col("uses") >= min_uses)
    )
    return columns.join(used, ["column_name", "data_type"]).orderBy(
        "column_name", F.desc("uses"), "mean_failure_rate", "rule_logic"
    )
