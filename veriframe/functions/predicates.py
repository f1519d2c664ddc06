"""The rule functions as Column builders.

Each returns a boolean "row satisfies the rule" (only `date_diff` is numeric). All of them are
built-in Spark expressions, so they stay inside whole-stage code generation.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Formats a value must have.
EMAIL_PATTERN = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
PHONE_PATTERN = r"^[\d\s\-\(\)\.]+$"
PHONE_MIN_DIGITS = 10


def is_null(c: Column) -> Column:
    return c.isNull()


def is_not_null(c: Column) -> Column:
    return c.isNotNull()


def is_empty(c: Column) -> Column:
    """Null, or nothing but spaces (a tab is content)."""
    return c.isNull() | (F.trim(c) == "")


def is_not_empty(c: Column) -> Column:
    return ~is_empty(c)


def _bounded(value: Column, low, high, inclusive: bool = True) -> Column:
    tests = []
    if low is not None:
        tests.append(value >= low if inclusive else value > low)
    if high is not None:
        tests.append(value <= high if inclusive else value < high)
    if not tests:
        return value.isNotNull()
    return F.coalesce(reduce(Column.__and__, tests), F.lit(False))


def length_check(c: Column, min_length: int | None = None, max_length: int | None = None) -> Column:
    """Length without outer spaces lies within the inclusive bounds; null never does."""
    return _bounded(F.length(F.trim(c)), min_length, max_length)


def range_check(c: Column, min_value=None, max_value=None, inclusive: bool = True) -> Column:
    """Value lies within the given bounds; null never does."""
    return _bounded(c, min_value, max_value, inclusive)


def regex_match(c: Column, pattern: str) -> Column:
    """The pattern is found somewhere with at least one character (so `x*` does not match 'abc')."""
    return F.regexp_extract(c, pattern, 0) != ""


def is_email(c: Column) -> Column:
    return c.rlike(EMAIL_PATTERN)


def is_phone(c: Column) -> Column:
    digits = F.regexp_replace(c, "[^0-9]", "")
    return c.rlike(PHONE_PATTERN) & (F.length(digits) >= PHONE_MIN_DIGITS)


def is_numeric(c: Column) -> Column:
    """Can be read as a number, and is not NaN."""
    number = c.try_cast("double")
    return number.isNotNull() & ~F.isnan(number)


def date_diff(c1: Column, c2: Column, unit: str = "days") -> Column:
    """c1 - c2 in calendar days, or in full elapsed hours or minutes."""
    if unit in ("hours", "minutes"):
        return F.timestamp_diff("HOUR" if unit == "hours" else "MINUTE", c2, c1)
    return F.datediff(c1.try_cast("date"), c2.try_cast("date"))


def is_fresh(c: Column, max_age_days: int, reference_date: Column | None = None) -> Column:
    """At most `max_age_days` older than the reference (default now); future dates are fresh."""
    reference = F.current_timestamp() if reference_date is None else reference_date
    return date_diff(reference, c) <= max_age_days


def is_in_list(c: Column, value_list: Sequence) -> Column:
    return c.isin(list(value_list))


def is_not_in_list(c: Column, value_list: Sequence) -> Column:
    return ~c.isin(list(value_list))


def equals(a: Column, b: Column) -> Column:
    return a == b


def not_equals(a: Column, b: Column) -> Column:
    return a != b


def greater_than(a: Column, b: Column) -> Column:
    return a > b


def less_than(a: Column, b: Column) -> Column:
    return a < b


RULE_FUNCTIONS = {
    f.__name__: f
    for f in (
        is_null, is_not_null, is_empty, is_not_empty, length_check, regex_match,
        is_email, is_phone, is_numeric, range_check, date_diff, is_fresh,
        is_in_list, is_not_in_list, equals, not_equals, greater_than, less_than,
    )
}
