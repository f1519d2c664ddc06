"""Rules and assignments out of a file with one rule per line."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veriframe.errors import MetadataError
from veriframe.operators.skew import spread_join
from veriframe.plans.rules import (
    EXECUTION_FREQUENCIES, RULE_CATEGORIES, RULE_TYPES, SEVERITY_LEVELS,
)

# Columns an import file must have, may have, and needs for assignments.
REQUIRED_COLUMNS = (
    "rule_name", "rule_type", "rule_category", "severity_level", "rule_logic", "created_by",
)
OPTIONAL_COLUMNS = ("threshold_value", "description", "schedule_expression")
TARGET_COLUMNS = (
    "target_source", "target_schema", "target_table", "target_columns", "execution_frequency",
)

MALFORMED = "_malformed"


def read_rules_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text; a line with too many or too few fields is kept in `_malformed`."""
    header = spark.read.option("header", True).csv(path).columns
    schema = ", ".join(f"`{c}` string" for c in [*header, MALFORMED])
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("columnNameOfCorruptRecord", MALFORMED)
        # Pruned columns are not parsed, and a line would only look malformed when all are read.
        .option("columnPruning", False)
        .option("escape", '"')
        .csv(path)
    )


def missing_columns(df: DataFrame) -> list[str]:
    return [c for c in REQUIRED_COLUMNS if c not in df.columns]


def validate_import(df: DataFrame) -> DataFrame:
    """One row: valid, total_rows, missing_columns, empty_rows, columns."""
    missing = missing_columns(df)
    columns = [c for c in df.columns if c != MALFORMED]
    name = F.col("rule_name") if "rule_name" in df.columns else F.lit(None)
    empty = F.count_if(name.isNull()) if "rule_name" not in missing else F.lit(0).cast("bigint")
    totals = df.agg(F.count(F.lit(1)).alias("total_rows"), empty.alias("empty_rows"))

    def text_array(values):
        return F.array(*[F.lit(v) for v in values]).cast("array<string>")

    return totals.select(
        ((F.col("empty_rows") == 0) & F.lit(not missing)).alias("valid"),
        "total_rows",
        text_array(missing).alias("missing_columns"),
        "empty_rows",
        text_array(columns).alias("columns"),
    )


def _problem(condition: Column, message: Column | str) -> Column:
    message = F.lit(message) if isinstance(message, str) else message
    return F.when(F.coalesce(condition, F.lit(True)), message)


def _not_one_of(column: str, allowed: tuple[str, ...]) -> Column:
    return _problem(
        ~F.col(column).isin(list(allowed)),
        F.concat(F.lit(f"invalid {column}: "), F.coalesce(column, F.lit("(empty)"))),
    )


def _not_a_name(column: str) -> Column:
    return _problem(
        ~F.length(column).between(1, 255), f"{column} must have 1 to 255 characters"
    )


def _id(*columns: str) -> Column:
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(c, F.lit("\x00")) for c in columns]), 256)


@dataclass(frozen=True)
class RuleImport:
    """What an import file turns into; all frames are lazy."""

    checked: DataFrame
    rules: DataFrame
    versions: DataFrame
    assignments: DataFrame
    errors: DataFrame
    summary: DataFrame
    details: DataFrame


def import_rules(
    df: DataFrame, sources: DataFrame | None = None, create_assignments: bool = True
) -> RuleImport:
    """Check every line, and split the lines into rules, assignments and errors.

    A line with a bad rule yields an error only. A good rule whose target cannot be resolved
    yields the rule and an error. `sources` needs source_id and source_name.
    """
    missing = missing_columns(df)
    if missing:
        raise MetadataError(f"missing required columns: {', '.join(missing)}")
    for column in (*OPTIONAL_COLUMNS, MALFORMED):
        if column not in df.columns:
            df = df.withColumn(column, F.lit(None).cast("string"))
    if "row" not in df.columns:
        df = df.withColumn("row", F.monotonically_increasing_id() + 1)
    threshold = F.col("threshold_value").try_cast("double")
    rule_problems = F.array_compact(F.array(
        _problem(F.col(MALFORMED).isNotNull(), "malformed line"),
        _not_a_name("rule_name"),
        _not_one_of("rule_type", RULE_TYPES),
        _not_one_of("rule_category", RULE_CATEGORIES),
        _not_one_of("severity_level", SEVERITY_LEVELS),
        _problem(F.length("rule_logic") < 1, "rule_logic is empty"),
        _problem(F.length("created_by") < 1, "created_by is empty"),
        _problem(F.col("threshold_value").isNotNull() & threshold.isNull(), "threshold_value is not a number"),
    ))
    checked = df.withColumn("rule_problems", rule_problems).withColumn(
        "rule_id", _id("rule_name", "rule_type", "rule_category", "rule_logic", "created_by", "threshold_value")
    )
    assign = create_assignments and all(c in df.columns for c in TARGET_COLUMNS)
    if assign:
        # one row for each name, so that a repeated name neither multiplies lines nor picks a source
        known = sources.groupBy(F.col("source_name").alias("target_source")).agg(
            F.min("source_id").alias("source_id"), (F.countDistinct("source_id") > 1).alias("source_is_ambiguous"))
        names = F.transform(F.split("target_columns", ","), lambda c: F.trim(c))
        checked = (
            spread_join(checked, known, ["target_source"], "left")
            .withColumn("column_names", names)
            .withColumn("target_problems", F.array_compact(F.array(
                _problem(F.col("source_id").isNull(), F.concat(
                    F.lit("data source not found: "), F.coalesce("target_source", F.lit("(empty)")))),
                _problem(F.coalesce("source_is_ambiguous", F.lit(False)), F.concat(
                    F.lit("data source name is not unique: "), F.col("target_source"))),
                _not_a_name("target_schema"),
                _not_a_name("target_table"),
                _problem(F.exists("column_names", lambda c: c == ""), "column names must not be empty"),
                _not_one_of("execution_frequency", EXECUTION_FREQUENCIES),
            )))
        )
    else:
        checked = checked.withColumns({
            "source_id": F.lit(None).cast("string"),
            "column_names": F.array().cast("array<string>"),
            "target_problems": F.array().cast("array<string>"),
        })
    good_rule = F.size("rule_problems") == 0
    checked = checked.withColumns({
        "rule_created": good_rule,
        "assignment_created": good_rule & (F.size("target_problems") == 0) & F.lit(assign),
        "error": F.nullif(
            F.concat_ws("; ", "rule_problems", F.when(good_rule, F.col("target_problems"))), F.lit("")
        ),
    })
    return RuleImport(
        checked=checked,
        rules=_rules(checked.where("rule_created"), threshold),
        versions=_versions(checked.where("rule_created")),
        assignments=_assignments(checked.where("assignment_created")) if assign else None,
        errors=checked.where("error IS NOT NULL").select("row", "error"),
        details=checked.select(
            "row", "rule_name", F.when(F.col("rule_created"), F.col("rule_id")).alias("rule_id"),
            F.when(F.col("assignment_created"), _assignment_id()).alias("assignment_id") if assign
            else F.lit(None).cast("string").alias("assignment_id"), "error"),
        summary=checked.agg(
            F.count(F.lit(1)).alias("total_rows"),
            F.count_if("rule_created").alias("rules_created"),
            F.count_if("assignment_created").alias("assignments_created"),
            F.count_if(F.col("error").isNotNull()).alias("errors"),
        ),
    )


def _once(good: DataFrame) -> DataFrame:
    """The first line of each rule: a rule with several targets is one rule."""
    rest = [c for c in good.columns if c != "rule_id"]
    first = good.groupBy("rule_id").agg(F.min_by(F.struct(*rest), "row").alias("_line"))
    return first.select("rule_id", *[F.col("_line")[c].alias(c) for c in rest])


def _assignment_id() -> Column:
    return _id("rule_id", "source_id", "target_schema", "target_table", "target_columns")


def _rules(good: DataFrame, threshold: Column) -> DataFrame:
    now = F.current_timestamp()
    return _once(good).select(
        "rule_id", "rule_name", "rule_type", "rule_category", "severity_level", "rule_logic",
        threshold.alias("threshold_value"), F.lit(True).alias("is_reusable"), "description",
        "created_by", now.alias("created_at"), F.lit(None).cast("string").alias("updated_by"),
        now.alias("updated_at"), F.lit(1).alias("version"), F.lit(True).alias("is_active"),
    )


def _versions(good: DataFrame) -> DataFrame:
    return _once(good).select(
        "rule_id", F.lit(1).alias("version_number"), "rule_name", "rule_logic",
        F.col("created_by").alias("changed_by"), F.lit("Initial version").alias("change_reason"),
        F.current_timestamp().alias("changed_at"),
    )


def _assignments(good: DataFrame) -> DataFrame:
    now = F.current_timestamp()
    return good.select(
        _assignment_id().alias("assignment_id"),
        "rule_id", "source_id", F.col("target_schema").alias("schema_name"),
        F.col("target_table").alias("table_name"), "column_names", "execution_frequency",
        "schedule_expression", F.lit(True).alias("is_active"), F.lit(0).alias("priority_order"),
        "created_by", now.alias("created_at"), F.lit(None).cast("string").alias("updated_by"),
        now.alias("updated_at"), F.lit(None).cast("map<string,string>").alias("additional_config"),
    )


class BatchRuleImporter:
    """Imports rule files into the rule tables."""

    def __init__(self, tables):
        self.tables = tables
        self.details: DataFrame | None = None

    def import_from_csv(self, path: str, create_assignments: bool = True) -> dict:
        """Append the file's rules and assignments that are not stored yet; returns the totals of the import.

        `details` has a row for each line: its number, the rule's name and id, the assignment's id, and
        what is wrong with it.
        """
        lines = read_rules_csv(self.tables.spark, path)
        outcome = import_rules(lines, self.tables.read("data_sources"), create_assignments)
        # looked up before anything is stored, so that all tables are asked about the same moment
        new = [("rule_version_history", self._new("rule_version_history", outcome.versions, "rule_id")),
               ("validation_rules", self._new("validation_rules", outcome.rules, "rule_id"))]
        if outcome.assignments is not None:
            new.append(("rule_assignments", self._new("rule_assignments", outcome.assignments, "assignment_id")))
        for name, rows in new:
            self.tables.append(name, rows)
        self.details = outcome.details
        return outcome.summary.first().asDict()

    def _new(self, name: str, rows: DataFrame, key: str) -> DataFrame:
        there = self.tables.read(name).select(key).distinct()
        return rows.dropDuplicates([key]).join(there, key, "left_anti")

    def validate_import_file(self, path: str) -> dict:
        """Whether the file could be imported, and what is missing."""
        return validate_import(read_rules_csv(self.tables.spark, path)).first().asDict()
