import pytest

from veriframe.errors import RuleError
from veriframe.functions.ruletext import parse_rule_expression, to_sql
from veriframe.operators.results import Run
from veriframe.operators.row_checks import check_rows
from veriframe.plans.rules import Rule


def passing(df, text, mapping=None):
    return df.where(parse_rule_expression(text, mapping)).count()


@pytest.mark.parametrize("text,expected", [
    ("is_email(col('email'))", 2),
    ('is_email(col("email"))', 2),
    ("range_check(col('age'), min_value=18, max_value=100)", 4),
    ("range_check(col('age'), 18, 29)", 2),
    ("range_check(col('age'), None, 28)", 2),
    ("col('age') > 28 AND col('name') = 'Jane Smith'", 1),
    ("col('age') == 25 or col('age') == 30", 2),
    ("NOT is_null(email) and age BETWEEN 25 AND 30", 2),
    ("name LIKE 'J%' AND age IN (25, 30)", 2),
    ("is_in_list(col('name'), ['John Doe', 'Bob Johnson'])", 2),
    ("is_in_list(col('age'), [25, 28])", 2),
    ("regex_match(col('name'), r'^\\w+ D')", 1),
    ("regex_match(col('name'), '^\\w+ D')", 1),
    ("regex_match(col('name'), '^\\\\w+ D')", 1),
    ("name RLIKE '^J\\w+ S'", 1),
    ("is_email(email) AND (is_not_empty(name) OR is_null(age))", 2),
    ("range_check(abs(age - 30), 0, 2)", 2),
    ("greater_than(col('age') + 5, 33)", 2),
    ("name = 'not a col(''email'') call'", 0),
    ("length_check(col('name'), min_length=9)", 3),
])
def test_forms(users, text, expected):
    assert passing(users, text) == expected


def test_boolean_column(spark):
    df = spark.createDataFrame([(True,), (False,), (None,)], "flag boolean")
    assert passing(df, "flag") == 1


def test_mapping(users):
    assert passing(users, "is_email(col('email_col'))", {"email_col": "email"}) == 2
    assert passing(users, "contact IS NOT NULL AND years > 26", {"contact": "email", "years": "age"}) == 2
    assert passing(users, "column = 'column'", {"column": "name"}) == 0
    assert "`e``mail`" in to_sql("is_null(col('x'))", {"x": "e`mail"})


def test_arithmetic(spark):
    df = spark.createDataFrame([(100, 50, 50), (200, 150, 50), (100, 80, 30)],
                               "total bigint, subtotal bigint, tax bigint")
    assert passing(df, "col('total') == col('subtotal') + col('tax')") == 2


def test_date_text(spark):
    df = spark.createDataFrame(
        [("2024-01-01", "2024-01-02"), ("2024-01-01", "2024-01-01"), ("2024-01-02", "2024-01-01")],
        "start_date string, end_date string")
    assert passing(df, "col('start_date') <= col('end_date')") == 2
    assert passing(df, "date_diff(col('end_date'), col('start_date')) >= 0") == 2


def test_array_access_is_not_a_list(spark):
    df = spark.sql("SELECT array(1, 2) AS a")
    assert passing(df, "a[0] = 1 AND col('a')[1] = 2") == 1


@pytest.mark.parametrize("text", [
    "invalid syntax !@#$%", "invalid_syntax !@#$", "", "lambda x: x.age > 18", "is_email()",
    "range_check(col('age'), nothing=3)", "a § b",
    "age > 1) OR (true", "age > 1 -- always", "age > 1 AS x",
])
def test_bad_text(spark, text):
    with pytest.raises(RuleError):
        parse_rule_expression(text)


def test_bad_rules_do_not_stop_others(users):
    rules = [
        Rule("good", "is_email(col('email'))", ("email",), threshold_value=50.0),
        Rule("syntax", "invalid_syntax !@#$", ("email",)),
        Rule("unknown_column", "is_null(col('nothing'))", ("nothing",)),
        Rule("unknown_function", "no_such(col('email'))", ("email",)),
        Rule("not_boolean", "length(col('email'))", ("email",)),
        Rule("too_many", "age > 1", ("age", "name")),
    ]
    rows = {r.rule_id: r for r in check_rows(users, rules, Run(table_name="users")).collect()}
    assert (rows["good"].status, rows["good"].failure_rate) == ("pass", 50.0)
    for name in ("syntax", "unknown_column", "unknown_function", "not_boolean", "too_many"):
        assert rows[name].status == "error" and rows[name].error_message
        assert rows[name].failure_rate is None and rows[name].threshold_passed is None
