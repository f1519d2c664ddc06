"""Single checks by name, for callers who have a DataFrame and one question."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame

from veriframe.errors import RuleError
from veriframe.functions.names import quoted
from veriframe.operators.results import Run, sql_literal
from veriframe.operators.row_checks import check_rows
from veriframe.operators.samples import SAMPLE_SIZE, attach_samples, sample_violations
from veriframe.plans.rules import Rule


def _literal(text: str) -> str:
    quote = '"' if "'" in text else "'"
    if quote in text:
        raise RuleError("a pattern may hold one kind of quote only")
    return f"r{quote}{text}{quote}"


def _bound(value) -> str:
    """A bound as SQL: dates and times are typed, text is compared as the column's type."""
    if isinstance(value, dt.datetime):
        return f"timestamp'{value.isoformat(sep=' ')}'" if value.tzinfo else f"timestamp_ntz'{value.isoformat(sep=' ')}'"
    if isinstance(value, dt.date):
        return f"date'{value.isoformat()}'"
    if isinstance(value, str):
        return sql_literal(value)
    return "NULL" if value is None else str(value)


class _Validator:
    def __init__(self, run: Run = Run()):
        self.run = run

    def _check(self, df: DataFrame, rule: Rule, sample_size: int) -> DataFrame:
        results = check_rows(df, [rule], self.run)
        if not sample_size:
            return results
        samples = sample_violations(df, [rule], list(rule.columns), sample_size, run=self.run)
        return attach_samples(results, samples)

    def _named(self, df, columns, name, category, logic, rule_id, kind) -> DataFrame:
        rule = Rule(
            rule_id=rule_id, rule_name=name, rule_logic=logic, columns=tuple(columns),
            rule_type=kind, rule_category=category, severity_level="high",
        )
        return check_rows(df, [rule], self.run)


class SingleFieldValidator(_Validator):
    """Checks of one column; every method returns one result row."""

    def validate(
        self, df: DataFrame, rule: Rule, column: str, sample_size: int = SAMPLE_SIZE
    ) -> DataFrame:
        """The rule on `column`, with up to `sample_size` failing values."""
        bound = Rule(**{**rule.__dict__, "columns": (column,), "rule_type": "single_field"})
        return self._check(df, bound, sample_size)

    def validate_completeness(
        self, df: DataFrame, column: str, allow_empty_strings: bool = False,
        rule_id: str = "completeness",
    ) -> DataFrame:
        function = "is_not_null" if allow_empty_strings else "is_not_empty"
        return self._named(
            df, [column], "Completeness Check", "completeness",
            f"{function}({quoted(column)})", rule_id, "single_field",
        )

    def validate_accuracy(
        self, df: DataFrame, column: str, validation_type: str, *,
        min_value=None, max_value=None, pattern: str | None = None, rule_id: str | None = None,
    ) -> DataFrame:
        c = quoted(column)
        logic = {
            "range": lambda: f"range_check({c}, {_bound(min_value)}, {_bound(max_value)})",
            "regex": lambda: f"regex_match({c}, {_literal(pattern or '')})",
            "email": lambda: f"is_email({c})",
            "phone": lambda: f"is_phone({c})",
        }.get(validation_type)
        if logic is None:
            raise RuleError(f"unsupported accuracy check: {validation_type}")
        return self._named(
            df, [column], f"Accuracy Check - {validation_type}", "accuracy", logic(),
            rule_id or f"accuracy_{validation_type}", "single_field",
        )


class MultiFieldValidator(_Validator):
    """Checks over several columns of a row; every method returns one result row."""

    OPERATORS = ("equals", "not_equals", "greater_than", "less_than")

    def validate(
        self, df: DataFrame, rule: Rule, columns: Sequence[str], sample_size: int = SAMPLE_SIZE
    ) -> DataFrame:
        bound = Rule(**{**rule.__dict__, "columns": tuple(columns), "rule_type": "multi_field"})
        return self._check(df, bound, sample_size)

    def validate_consistency(
        self, df: DataFrame, columns: Sequence[str], consistency_type: str = "equals",
        rule_id: str | None = None,
    ) -> DataFrame:
        if consistency_type not in self.OPERATORS:
            raise RuleError(f"unsupported consistency check: {consistency_type}")
        if len(columns) != 2:
            raise RuleError("a consistency check compares exactly two columns")
        a, b = map(quoted, columns)
        return self._named(
            df, columns, f"Consistency Check - {consistency_type}", "consistency",
            f"{consistency_type}({a}, {b})", rule_id or f"consistency_{consistency_type}",
            "multi_field",
        )

    def validate_business_logic(
        self, df: DataFrame, expression: str, columns: Sequence[str], rule_id: str = "business_logic"
    ) -> DataFrame:
        return self._named(
            df, columns, "Business Logic Check", "custom", expression, rule_id, "multi_field"
        )
