"""The rule functions for plain `spark.sql` queries.

SQL functions are inlined by Catalyst, so a query that uses them has no call per row. Their
arguments are typed; in rules, where text is rewritten first, the functions take any type.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from veriframe.functions.predicates import EMAIL_PATTERN, PHONE_MIN_DIGITS, PHONE_PATTERN

_BOUNDS = "({v} IS NOT NULL AND {v} {ge} coalesce({low}, {v}) AND {v} {le} coalesce({high}, {v}))"
_INCLUSIVE = _BOUNDS.format(v="c", ge=">=", le="<=", low="min_value", high="max_value")
_EXCLUSIVE = "(c IS NOT NULL AND coalesce(c > min_value, true) AND coalesce(c < max_value, true))"
_LENGTH = _BOUNDS.format(v="length(trim(c))", ge=">=", le="<=", low="min_length", high="max_length")

# name: (parameters, condition)
SQL_FUNCTIONS = {
    "is_null": ("c STRING", "c IS NULL"),
    "is_not_null": ("c STRING", "c IS NOT NULL"),
    "is_empty": ("c STRING", "c IS NULL OR trim(c) = ''"),
    "is_not_empty": ("c STRING", "NOT (c IS NULL OR trim(c) = '')"),
    "length_check": ("c STRING, min_length INT DEFAULT NULL, max_length INT DEFAULT NULL", _LENGTH),
    "regex_match": ("c STRING, pattern STRING", "regexp_extract(c, pattern, 0) <> ''"),
    "is_email": ("c STRING", f"c RLIKE r'{EMAIL_PATTERN}'"),
    "is_phone": (
        "c STRING",
        f"c RLIKE r'{PHONE_PATTERN}' AND length(regexp_replace(c, '[^0-9]', '')) >= {PHONE_MIN_DIGITS}",
    ),
    "is_numeric": ("c STRING", "try_cast(c AS DOUBLE) IS NOT NULL AND NOT isnan(try_cast(c AS DOUBLE))"),
    "range_check": (
        "c DOUBLE, min_value DOUBLE DEFAULT NULL, max_value DOUBLE DEFAULT NULL, inclusive BOOLEAN DEFAULT true",
        f"CASE WHEN inclusive THEN {_INCLUSIVE} ELSE {_EXCLUSIVE} END",
    ),
    "is_fresh": (
        "c TIMESTAMP, max_age_days INT, reference_date TIMESTAMP DEFAULT NULL",
        "datediff(coalesce(reference_date, current_timestamp()), c) <= max_age_days",
    ),
    "is_in_list": ("c STRING, value_list ARRAY<STRING>", "array_contains(value_list, c)"),
    "is_not_in_list": ("c STRING, value_list ARRAY<STRING>", "NOT array_contains(value_list, c)"),
}
# Comparisons of two values: numbers as numbers, everything else as text. In rules, where types are known,
# values are compared as what they are.
_AS_NUMBERS = "try_cast(a AS DOUBLE) IS NOT NULL AND try_cast(b AS DOUBLE) IS NOT NULL"
for _name, _operator in (("equals", "="), ("not_equals", "<>"), ("greater_than", ">"), ("less_than", "<")):
    SQL_FUNCTIONS[_name] = (
        "a STRING, b STRING",
        f"CASE WHEN {_AS_NUMBERS} THEN CAST(a AS DOUBLE) {_operator} CAST(b AS DOUBLE) ELSE a {_operator} b END",
    )


def register_rule_functions(spark: SparkSession) -> list[str]:
    """Create the functions in the session; returns their names."""
    for name, (parameters, condition) in SQL_FUNCTIONS.items():
        spark.sql(
            f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS BOOLEAN RETURN {condition}"
        )
    return list(SQL_FUNCTIONS)
