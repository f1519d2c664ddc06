"""What a rule is, and the schemas of the rule tables."""

from __future__ import annotations

from dataclasses import dataclass, field

# The words allowed in the rule tables.
SOURCE_TYPES = (
    "databricks", "sqlserver", "teradata", "s3", "redshift", "aurora_postgresql", "mysql", "oracle",
)
RULE_TYPES = ("single_field", "multi_field", "cross_table")
RULE_CATEGORIES = (
    "completeness", "accuracy", "consistency", "integrity", "timeliness", "custom",
)
SEVERITY_LEVELS = ("critical", "high", "medium", "low")
EXECUTION_FREQUENCIES = ("batch", "streaming", "scheduled", "on_demand")
RESULT_STATUSES = ("pass", "fail", "error", "warning")
EXECUTION_STATUSES = ("running", "completed", "failed", "cancelled", "timeout")

# Names and columns of the rule tables.
TABLE_SCHEMAS = {
    "data_sources": """source_id string, source_name string, source_type string,
        connection_config map<string,string>, is_active boolean, created_at timestamp,
        updated_at timestamp, created_by string, updated_by string, description string""",
    "validation_rules": """rule_id string, rule_name string, rule_type string, rule_category string,
        severity_level string, rule_logic string, threshold_value double, is_reusable boolean,
        description string, created_by string, created_at timestamp, updated_by string,
        updated_at timestamp, version int, is_active boolean""",
    "rule_assignments": """assignment_id string, rule_id string, source_id string,
        schema_name string, table_name string, column_names array<string>,
        execution_frequency string, schedule_expression string, is_active boolean,
        priority_order int, created_by string, created_at timestamp, updated_by string,
        updated_at timestamp, additional_config map<string,string>""",
    "validation_results": """run_id string, rule_id string, rule_name string, assignment_id string,
        table_name string, column_names array<string>, rule_category string, severity_level string,
        records_checked bigint, records_failed bigint, records_passed bigint, failure_rate double,
        threshold_value double, threshold_passed boolean, status string, error_message string,
        execution_duration_ms bigint, validation_timestamp timestamp, run_date date""",
    "execution_logs": """run_id string, assignment_id string, execution_type string,
        source_id string, status string, event_time timestamp, records_processed bigint,
        error_message string""",
    "rule_version_history": """rule_id string, version_number int, rule_name string,
        rule_logic string, changed_by string, change_reason string, changed_at timestamp""",
    "data_lineage": """run_id string, table_name string, rules_applied array<string>,
        snapshot_location string, data_version string, created_at timestamp""",
    "file_counts": """source_id string, schema_name string, table_name string, file_path string,
        modified timestamp, assignment_id string, rule_version string, records_checked bigint,
        records_failed bigint""",
    "quality_scores": """table_name string, score_date date, overall_score double,
        completeness_score double, accuracy_score double, consistency_score double,
        integrity_score double, timeliness_score double, total_rules_applied bigint,
        rules_passed bigint, rules_failed bigint""",
}


@dataclass(frozen=True)
class Rule:
    """One rule bound to the columns it checks.

    `options["check"]` names what is done with it: `row` (default, `rule_logic` is a condition on
    one row), `unique`, `primary_key`, `foreign_key`, `cross_table`, `reconcile` or `freshness`.
    """

    rule_id: str
    rule_logic: str = ""
    columns: tuple[str, ...] = ()
    rule_name: str = ""
    rule_type: str = "single_field"
    rule_category: str = "custom"
    severity_level: str = "medium"
    threshold_value: float | None = None
    assignment_id: str | None = None
    null_policy: str = "fail"
    options: dict = field(default_factory=dict, hash=False)

    @property
    def check(self) -> str:
        return self.options.get("check") or "row"

    @property
    def mapping(self) -> dict[str, str]:
        """Aliases used in the text: `column` for the assigned column, `column1`, ... for several."""
        aliases = {f"column{i}": c for i, c in enumerate(self.columns, 1)}
        if self.columns:
            aliases["column"] = self.columns[0]
        for pair in filter(None, (self.options.get("column_mapping") or "").split(",")):
            alias, _, real = pair.partition("=")
            aliases[alias.strip()] = real.strip()
        # A name that is itself an assigned column means that column.
        return {a: c for a, c in aliases.items() if a not in self.columns}
