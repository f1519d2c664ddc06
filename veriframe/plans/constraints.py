"""What must hold for the rule tables themselves, checked with the same operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame

from veriframe.operators.integrity import check_foreign_key, check_unique
from veriframe.operators.results import Run
from veriframe.operators.row_checks import check_rows
from veriframe.plans import rules as R
from veriframe.plans.rules import Rule


def _words(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


# Conditions on single rows of each rule table.
ROW_CONDITIONS = {
    "data_sources": {
        "source_name_length": "length(source_name) BETWEEN 1 AND 255",
        "source_type_known": f"source_type IN {_words(R.SOURCE_TYPES)}",
    },
    "validation_rules": {
        "rule_name_length": "length(rule_name) BETWEEN 1 AND 255",
        "rule_type_known": f"rule_type IN {_words(R.RULE_TYPES)}",
        "rule_category_known": f"rule_category IN {_words(R.RULE_CATEGORIES)}",
        "severity_level_known": f"severity_level IN {_words(R.SEVERITY_LEVELS)}",
        "rule_logic_present": "length(rule_logic) >= 1",
        "created_by_present": "length(created_by) >= 1",
    },
    "rule_assignments": {
        "schema_name_length": "length(schema_name) BETWEEN 1 AND 255",
        "table_name_length": "length(table_name) BETWEEN 1 AND 255",
        "column_names_filled": "size(column_names) >= 1 AND NOT exists(column_names, c -> trim(c) = '')",
        "execution_frequency_known": f"execution_frequency IN {_words(R.EXECUTION_FREQUENCIES)}",
    },
    "validation_results": {
        "result_status_known": f"status IN {_words(R.RESULT_STATUSES)}",
        "result_counts_add_up": "records_passed + records_failed = records_checked",
    },
    "execution_logs": {
        "log_status_known": f"status IN {_words(R.EXECUTION_STATUSES)}",
    },
    "quality_scores": {
        f"{name}_in_range": f"{name} BETWEEN 0 AND 100"
        for name in ("overall_score", "completeness_score", "accuracy_score",
                     "consistency_score", "integrity_score", "timeliness_score")
    },
}

# Scores that may be missing.
_OPTIONAL = {f"{c}_score_in_range" for c in
             ("completeness", "accuracy", "consistency", "integrity", "timeliness")}

# Keys that must be unique.
UNIQUE_KEYS = {
    "data_sources": ("source_name",),
    "rule_assignments": ("rule_id", "source_id", "schema_name", "table_name", "column_names"),
    "rule_version_history": ("rule_id", "version_number"),
    "quality_scores": ("table_name", "score_date"),
}

# Fixed values: (table, column) -> (parent table, parent column).
FOREIGN_KEYS = {
    ("rule_assignments", "rule_id"): ("validation_rules", "rule_id"),
    ("rule_assignments", "source_id"): ("data_sources", "source_id"),
    ("validation_results", "rule_id"): ("validation_rules", "rule_id"),
    ("validation_results", "assignment_id"): ("rule_assignments", "assignment_id"),
    ("execution_logs", "source_id"): ("data_sources", "source_id"),
    ("execution_logs", "assignment_id"): ("rule_assignments", "assignment_id"),
    ("rule_version_history", "rule_id"): ("validation_rules", "rule_id"),
}


def check_constraints(tables: dict[str, DataFrame], run: Run = Run()) -> DataFrame:
    """Result rows for every constraint whose tables are given, by table name."""
    frames = []
    for name, df in tables.items():
        at = Run(run.run_id, run.at, name)
        rules = [
            Rule(rule_id=i, rule_logic=text, rule_category="integrity", severity_level="high",
                 rule_type="multi_field", null_policy="skip" if i in _OPTIONAL else "fail")
            for i, text in ROW_CONDITIONS.get(name, {}).items()
        ]
        if rules:
            frames.append(check_rows(df, rules, at))
        if name in UNIQUE_KEYS:
            frames.append(check_unique(df, _key_rule(f"{name}_unique", UNIQUE_KEYS[name]), at))
    for (name, column), (parent, parent_column) in FOREIGN_KEYS.items():
        if name in tables and parent in tables:
            rule = _key_rule(f"{name}_{column}_known", (column,))
            at = Run(run.run_id, run.at, name)
            frames.append(
                check_foreign_key(tables[name], tables[parent], [parent_column], rule, at)
            )
    return reduce(DataFrame.unionByName, frames)


def _key_rule(rule_id: str, columns: tuple[str, ...]) -> Rule:
    return Rule(rule_id=rule_id, columns=columns, rule_category="integrity",
                severity_level="critical", rule_type="multi_field")
