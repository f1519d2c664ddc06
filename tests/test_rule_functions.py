import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veriframe.functions import predicates as P
from veriframe.functions.ruletext import parse_rule_expression


def count_true(df, predicate):
    return df.where(predicate).count()


def column(spark, name, values, kind="string"):
    return spark.createDataFrame([(v,) for v in values], f"{name} {kind}")


def test_null_functions(users):
    assert count_true(users, P.is_null(F.col("email"))) == 1
    assert count_true(users, P.is_not_null(F.col("email"))) == 3


def test_blank_values(spark):
    df = column(spark, "col1", ["", "  ", "value", None])
    assert count_true(df, P.is_empty(F.col("col1"))) == 3
    assert count_true(df, P.is_not_empty(F.col("col1"))) == 1
    tab = column(spark, "col1", ["\t"])
    assert count_true(tab, P.is_empty(F.col("col1"))) == 0


def test_emails(spark):
    df = column(spark, "email", ["valid@example.com", "invalid-email", "another@test.co.uk", "not.an.email"])
    assert count_true(df, P.is_email(F.col("email"))) == 2


@pytest.mark.parametrize("value,ok", [
    ("(123) 456-7890", True), ("123-456-7890", True), ("123.456.7890", True), ("1234567890", True),
    ("123-4567", False), ("123456789x0", False), ("", False),
])
def test_phones(spark, value, ok):
    assert count_true(column(spark, "c", [value]), P.is_phone(F.col("c"))) == int(ok)


def test_ranges(spark):
    df = column(spark, "value", [10, 25, 50, 100, 150, None], "bigint")
    c = F.col("value")
    assert count_true(df, P.range_check(c, 20, 100)) == 3
    assert count_true(df, P.range_check(c, 25, 100, inclusive=False)) == 1
    assert count_true(df, P.range_check(c, min_value=100)) == 2
    assert count_true(df, P.range_check(c, max_value=25)) == 2
    assert count_true(df, P.range_check(c)) == 5
    assert df.where(P.range_check(c, 0, 10).isNull()).count() == 0


def test_lengths(spark):
    df = column(spark, "text", ["short", "medium length", "very long string here", None])
    assert count_true(df, P.length_check(F.col("text"), 5, 15)) == 2
    assert count_true(df, P.length_check(F.col("text"), max_length=5)) == 1
    assert count_true(df, P.length_check(F.col("text"))) == 3


def test_lists(spark):
    df = column(spark, "status", ["active", "inactive", "pending", "unknown", None])
    allowed = ["active", "inactive", "pending"]
    assert count_true(df, P.is_in_list(F.col("status"), allowed)) == 3
    assert count_true(df, P.is_not_in_list(F.col("status"), allowed)) == 1


def test_comparisons(spark):
    df = spark.createDataFrame([(10, 10), (10, 20), (30, 30), (None, 1)], "col1 bigint, col2 bigint")
    a, b = F.col("col1"), F.col("col2")
    assert count_true(df, P.equals(a, b)) == 2
    assert count_true(df, P.not_equals(a, b)) == 1
    assert count_true(df, P.less_than(a, b)) == 1
    assert count_true(df, P.greater_than(b, a)) == 1


def test_numbers(spark):
    df = column(spark, "c", ["1", "1.5", "-2e3", "NaN", "abc", "", None])
    assert count_true(df, P.is_numeric(F.col("c"))) == 3
    assert count_true(column(spark, "c", [1.0, float("nan"), None], "double"), P.is_numeric(F.col("c"))) == 1


def test_regex_needs_a_character(spark):
    df = column(spark, "c", ["abc", "xxx", None])
    assert count_true(df, P.regex_match(F.col("c"), "x*")) == 1
    assert df.where(P.regex_match(F.col("c"), "x").isNull()).count() == 1


def test_dates(spark):
    df = spark.sql("SELECT timestamp'2024-01-10 12:00:00' AS a, timestamp'2024-01-08 13:30:00' AS b")
    a, b = F.col("a"), F.col("b")
    row = df.select(P.date_diff(a, b), P.date_diff(a, b, "hours"), P.date_diff(a, b, "minutes")).first()
    assert tuple(row) == (2, 46, 2790)


def test_freshness(spark):
    df = spark.sql("SELECT explode(array(date'2024-01-01', date'2024-01-09', date'2024-02-01', null)) AS d")
    now = F.lit("2024-01-10").cast("date")
    assert count_true(df, P.is_fresh(F.col("d"), 5, now)) == 2
    assert df.where(P.is_fresh(F.col("d"), 5, now).isNull()).count() == 1
    assert count_true(spark.sql("SELECT current_date() AS d"), P.is_fresh(F.col("d"), 0)) == 1


TEXT = st.one_of(st.none(), st.text(alphabet="ab1 .@-()x\t", max_size=12))
CALLS = {
    "is_null(col('c'))": lambda c: P.is_null(c),
    "is_not_null(c)": lambda c: P.is_not_null(c),
    "is_empty(col('c'))": lambda c: P.is_empty(c),
    "is_not_empty(column)": lambda c: P.is_not_empty(c),
    "length_check(col('c'), 2, max_length=5)": lambda c: P.length_check(c, 2, 5),
    "regex_match(col('c'), '\\d+')": lambda c: P.regex_match(c, r"\d+"),
    "is_email(c)": lambda c: P.is_email(c),
    "is_phone(c)": lambda c: P.is_phone(c),
    "is_numeric(c)": lambda c: P.is_numeric(c),
    "is_in_list(c, ['a', 'b'])": lambda c: P.is_in_list(c, ["a", "b"]),
    "is_not_in_list(c, ['a', 'b'])": lambda c: P.is_not_in_list(c, ["a", "b"]),
    "equals(c, 'a')": lambda c: P.equals(c, F.lit("a")),
    "not_equals(c, 'a')": lambda c: P.not_equals(c, F.lit("a")),
    "greater_than(c, 'a')": lambda c: P.greater_than(c, F.lit("a")),
    "less_than(c, 'b')": lambda c: P.less_than(c, F.lit("b")),
    "range_check(length(c), 1, 3, inclusive=False)": lambda c: P.range_check(F.length(c), 1, 3, False),
}


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(values=st.lists(TEXT, min_size=1, max_size=20))
def test_text_and_columns_agree(spark, values):
    """The two ways to write a rule function give the same three-valued outcome."""
    df = column(spark, "c", values)
    pairs = [
        parse_rule_expression(text, {"column": "c"}).eqNullSafe(make(F.col("c"))).alias(f"p{i}")
        for i, (text, make) in enumerate(CALLS.items())
    ]
    for row in df.select(*pairs).collect():
        assert all(row), (row, values)
