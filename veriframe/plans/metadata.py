"""The rule tables as folders of files: appended to, read, joined; never updated in place."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from veriframe.errors import MetadataError
from veriframe.plans.rules import TABLE_SCHEMAS

# How the larger tables are laid out on disk.
PARTITIONS = {"validation_results": ["run_date"]}


def _matches(**wanted) -> Column:
    condition = F.lit(True)
    for name, value in wanted.items():
        if value is not None:
            condition = condition & (F.col(name) == value)
    return condition


def list_rules(rules, rule_type=None, category=None, is_active=None) -> DataFrame:
    """Rules that meet every given condition, newest first."""
    found = rules.where(_matches(rule_type=rule_type, rule_category=category, is_active=is_active))
    return found.orderBy(F.desc("created_at"))


def list_sources(sources, is_active=None) -> DataFrame:
    return sources.where(_matches(is_active=is_active)).orderBy(F.desc("created_at"))


def list_assignments(assignments, source_id=None, rule_id=None, is_active=None) -> DataFrame:
    """Assignments in the order they are applied: by priority, then newest first."""
    found = assignments.where(_matches(source_id=source_id, rule_id=rule_id, is_active=is_active))
    return found.orderBy("priority_order", F.desc("created_at"))


def current_rows(df: DataFrame, key: Sequence[str], *latest: str) -> DataFrame:
    """The latest row of each key; an aggregate, so a key with many rows needs no big window."""
    rest = [c for c in df.columns if c not in key]
    order = F.struct(*latest)
    newest = df.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("newest"))
    return newest.select(*key, *[F.col("newest")[c].alias(c) for c in rest])


def current_versions(history: DataFrame) -> DataFrame:
    """The current version of each rule."""
    return current_rows(history, ["rule_id"], "version_number")


def mark_current_versions(history: DataFrame) -> DataFrame:
    """The whole history with `is_current_version`; versions are unique per rule."""
    newest = history.groupBy("rule_id").agg(F.max("version_number").alias("version_number"))
    flagged = newest.withColumn("is_current_version", F.lit(True))
    return history.join(flagged, ["rule_id", "version_number"], "left").fillna(
        False, ["is_current_version"]
    )


def execution_states(events: DataFrame) -> DataFrame:
    """One row per (run, assignment) out of start and end events: latest state and duration."""
    ended = F.col("status") != "running"
    return events.groupBy("run_id", "assignment_id").agg(
        F.max_by("status", F.struct("event_time", ended)).alias("status"),
        F.min("event_time").alias("start_time"),
        F.max(F.when(ended, F.col("event_time"))).alias("end_time"),
        F.max("records_processed").alias("records_processed"),
    ).withColumn(
        "execution_duration_ms",
        F.when(
            F.col("end_time").isNotNull(),
            F.timestamp_diff("MILLISECOND", F.col("start_time"), F.col("end_time")),
        ),
    )


def resolve_assignments(
    assignments: DataFrame, rules: DataFrame, sources: DataFrame, active_only: bool = True
) -> DataFrame:
    """Assignments with their rule and source; inactive ones are left out unless asked for.

    Of a rule or source that is stored several times the current row counts: the highest version,
    then the latest change.
    """
    def current(df: DataFrame, key: str) -> DataFrame:
        latest = [c for c in ("version", "updated_at", "created_at") if c in df.columns]
        return current_rows(df, [key], *(latest or [key]))

    rules, sources = current(rules, "rule_id"), current(sources, "source_id")
    if active_only:
        assignments, rules = assignments.where("is_active"), rules.where("is_active")
    rule = rules.select(
        "rule_id", "rule_name", "rule_type", "rule_category", "severity_level", "rule_logic",
        "threshold_value", F.col("is_active").alias("rule_is_active"),
    )
    source = sources.select("source_id", "source_name", "source_type", "connection_config")
    return assignments.join(rule, "rule_id").join(source, "source_id")


class MetadataTables:
    """The rule tables below one root folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def schema(self, name: str) -> str:
        try:
            return TABLE_SCHEMAS[name]
        except KeyError:
            raise MetadataError(f"no such table: {name}") from None

    def append(self, name: str, df: DataFrame) -> None:
        """Add rows; missing columns become null, types are brought to those of the table."""
        target = StructType.fromDDL(self.schema(name))
        columns = [
            (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in target
        ]
        writer = df.select(*columns).write.mode("append")
        if name in PARTITIONS:
            writer = writer.partitionBy(*PARTITIONS[name])
        writer.parquet(self.path(name))

    def save_results(self, results: DataFrame) -> None:
        """Append results; a missing rate is computed, a missing time is now."""
        checked, failed = F.col("records_checked"), F.col("records_failed")
        rate = F.when(F.col("status") == "error", None).when(
            checked > 0, F.round(100.0 * failed / checked, 4)
        ).otherwise(0.0)
        defaults = {"failure_rate": rate, "validation_timestamp": F.current_timestamp()}
        for name, default in defaults.items():
            given = F.col(name) if name in results.columns else F.lit(None)
            results = results.withColumn(name, F.coalesce(given, default))
        self.append(
            "validation_results",
            results.withColumn("run_date", F.to_date("validation_timestamp")),
        )

    def append_rows(self, name: str, rows: Sequence[dict]) -> None:
        """Add a handful of rows that are on the driver already."""
        schema = StructType.fromDDL(self.schema(name))
        values = [tuple(row.get(f.name) for f in schema) for row in rows]
        self.append(name, self.spark.createDataFrame(values, schema).coalesce(1))

    def read(self, name: str) -> DataFrame:
        """The table; empty when nothing has been added yet."""
        reader = self.spark.read.schema(self.schema(name))
        try:
            return reader.parquet(self.path(name))
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return self.spark.createDataFrame([], self.schema(name))
            raise
