"""Rule text as people write it, turned into one Spark SQL boolean expression.

Spark parses and type-checks the result (`F.expr`). Here only the spellings Spark does not know
are replaced: `col('x')`, calls of the rule functions with positional or `name=` arguments, list
literals, regular expressions in quotes, and aliases of columns.
"""

from __future__ import annotations

import logging
import re

from pyspark.logger import PySparkLogger
from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from veriframe.errors import RuleError
from veriframe.functions.names import quoted
from veriframe.functions.predicates import EMAIL_PATTERN, PHONE_MIN_DIGITS, PHONE_PATTERN

_STRING = re.compile(r"""(?:\b[rR])?(?:'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")""", re.S)
_COL = re.compile(r"\bcol\(\s*§(\d+)§\s*\)")
_LIST = re.compile(r"(?<![\w§`\])])(\s*)\[([^\[\]]*)\]")
_CALL = re.compile(r"(\b[A-Za-z_]\w*)?(\s*)\(([^()]*)\)")
_HELD = re.compile(r"§(\d+)§")
_KEYWORD = re.compile(r"^(\w+)\s*=(?!=)\s*(.+)$", re.S)
# Escapes Spark SQL understands in a quoted string; any other one would silently lose its backslash.
_KNOWN_ESCAPES = set("\\'\"0bnrtZ%_u")


def _bounded(value, low, high, inclusive="true"):
    equal = "" if str(inclusive).lower() == "false" else "="
    tests = []
    if low is not None:
        tests.append(f"{value} >{equal} {low}")
    if high is not None:
        tests.append(f"{value} <{equal} {high}")
    return f"coalesce({' AND '.join(tests)}, false)" if tests else f"{value} IS NOT NULL"


def _days(a, b):
    return f"datediff(try_cast({a} AS DATE), try_cast({b} AS DATE))"


def _date_diff(c1, c2, unit="'days'"):
    unit = unit.strip("'\"")
    if unit in ("hours", "minutes"):
        return f"timestampdiff({unit[:-1].upper()}, {c2}, {c1})"
    return _days(c1, c2)


def _length_check(c, min_length=None, max_length=None):
    return _bounded(f"length(trim({c}))", min_length, max_length)


def _range_check(c, min_value=None, max_value=None, inclusive="true"):
    return _bounded(c, min_value, max_value, inclusive)


def _is_fresh(c, max_age_days, reference_date=None):
    return f"{_days(reference_date or 'current_timestamp()', c)} <= {max_age_days}"


def _is_in_list(c, value_list):
    return f"{c} IN ({_members(value_list)})"


def _is_not_in_list(c, value_list):
    return f"{c} NOT IN ({_members(value_list)})"


def _members(value_list):
    inner = re.fullmatch(r"array\((.*)\)", value_list, re.S)
    return inner.group(1) if inner else value_list


def _regex_match(c, pattern):
    return f"regexp_extract({c}, {pattern}, 0) <> ''"


_TEMPLATES = {
    "is_null": lambda c: f"{c} IS NULL",
    "is_not_null": lambda c: f"{c} IS NOT NULL",
    "is_empty": lambda c: f"{c} IS NULL OR trim({c}) = ''",
    "is_not_empty": lambda c: f"NOT ({c} IS NULL OR trim({c}) = '')",
    "length_check": _length_check,
    "regex_match": _regex_match,
    "is_email": lambda c: f"{c} RLIKE r'{EMAIL_PATTERN}'",
    "is_phone": lambda c: f"{c} RLIKE r'{PHONE_PATTERN}'"
    f" AND length(regexp_replace({c}, '[^0-9]', '')) >= {PHONE_MIN_DIGITS}",
    "is_numeric": lambda c: f"try_cast({c} AS DOUBLE) IS NOT NULL"
    f" AND NOT isnan(try_cast({c} AS DOUBLE))",
    "range_check": _range_check,
    "date_diff": _date_diff,
    "is_fresh": _is_fresh,
    "is_in_list": _is_in_list,
    "is_not_in_list": _is_not_in_list,
    "equals": lambda a, b: f"{a} = {b}",
    "not_equals": lambda a, b: f"{a} <> {b}",
    "greater_than": lambda a, b: f"{a} > {b}",
    "less_than": lambda a, b: f"{a} < {b}",
}


def _sql_string(literal: str) -> str:
    """A quoted string that keeps the backslashes of a regular expression."""
    if literal[0] in "rR":
        return literal
    escapes = re.findall(r"\\(.)", literal, re.S)
    if escapes and set(escapes) - _KNOWN_ESCAPES and not set(escapes) & {"'", '"'}:
        return "r" + literal.replace("\\\\", "\\")
    return literal


def _expand_call(name: str, arguments: str, restore) -> str:
    positional, named = [], {}
    for argument in filter(None, (a.strip() for a in arguments.split(","))):
        keyword = _KEYWORD.match(argument)
        value = (keyword.group(2) if keyword else argument).strip()
        value = None if value.lower() in ("none", "null") else restore(value)
        if keyword:
            named[keyword.group(1)] = value
        else:
            positional.append(value)
    try:
        return f"({_TEMPLATES[name](*positional, **named)})"
    except TypeError as e:
        raise RuleError(f"wrong arguments for {name}: {arguments.strip()}") from e


def to_sql(text: str, mapping: dict[str, str] | None = None) -> str:
    """Rewrite rule text to Spark SQL in parentheses; `mapping` replaces column aliases by real column names."""
    if not text or not text.strip():
        raise RuleError("empty rule")
    if "§" in text:
        raise RuleError("the character § is not allowed in rule text")
    if re.match(r"\s*lambda\b", text):
        raise RuleError("write a SQL condition instead of a lambda")
    mapping = mapping or {}
    held: list[str] = []

    def hold(piece: str) -> str:
        held.append(piece)
        return f"§{len(held) - 1}§"

    def restore(piece: str) -> str:
        while _HELD.search(piece):
            piece = _HELD.sub(lambda m: held[int(m.group(1))], piece)
        return piece

    def column(name: str) -> str:
        return hold(quoted(mapping.get(name, name)))

    def bracket(match: re.Match) -> str:
        name, space, inner = match.group(1), match.group(2), match.group(3)
        if name and name.lower() in _TEMPLATES:
            return hold(_expand_call(name.lower(), inner, restore))
        return (name or "") + space + hold(f"({inner})")

    text = _STRING.sub(lambda m: hold(_sql_string(m.group(0))), text.strip())
    if re.search(r"--|/\*", text):
        raise RuleError("comments are not allowed in rule text")
    text = re.sub(r"`[^`]+`", lambda m: column(m.group(0)[1:-1]), text)
    text = _COL.sub(lambda m: column(held[int(m.group(1))].lstrip("rR")[1:-1]), text)
    for alias in mapping:
        text = re.sub(rf"(?<![\w.§])({re.escape(alias)})(?![\w§]|\s*[(])", lambda m: column(m.group(1)), text)
    while True:
        shorter = _LIST.sub(lambda m: m.group(1) + hold(f"array({m.group(2)})"), text)
        shorter = _CALL.sub(bracket, shorter)
        if shorter == text:
            break
        text = shorter
    if re.search(r"[()]", text):
        raise RuleError("unbalanced parentheses")
    # In parentheses, so that a rule is one whole expression without an alias behind it.
    return f"({restore(text)})"


def parse_rule_expression(text: str, column_mapping: dict[str, str] | None = None) -> Column:
    """The rule as a Column; text Spark cannot parse raises `RuleError`."""
    predicate = F.expr(to_sql(text, column_mapping))
    quiet = PySparkLogger.getLogger("SQLQueryContextLogger")
    level = quiet.level
    quiet.setLevel(logging.CRITICAL)
    try:
        # Spark parses the text when it is used; columns need not exist yet.
        SparkSession.active().range(0).select(predicate)
    except ParseException as e:
        raise RuleError(f"cannot parse rule: {text}: {first_line(e)}") from e
    except AnalysisException:
        pass
    finally:
        quiet.setLevel(level)
    return predicate


def first_line(e: Exception) -> str:
    """The first line with text of an error message."""
    return next((line.strip() for line in str(e).splitlines() if line.strip()), type(e).__name__)
