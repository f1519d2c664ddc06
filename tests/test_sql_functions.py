from veriframe.functions.ruletext import parse_rule_expression
from veriframe.functions.sqlfunctions import register_rule_functions


def test_sql_functions_agree_with_rule_text(spark):
    names = register_rule_functions(spark)
    df = spark.createDataFrame(
        [("a@b.com", "(123) 456-7890", "1.5", 5.0), (" ", "123", "x", None), (None, None, None, 10.0), ("abc", "", "NaN", 1.0)],
        "e string, p string, n string, x double")
    df.createOrReplaceTempView("people")
    for text in [
        "is_null(e)", "is_not_null(e)", "is_empty(e)", "is_not_empty(e)", "length_check(e, 2, 4)", "length_check(e)",
        "length_check(e, max_length => 1)", "regex_match(e, '[a-c]+')", "is_email(e)", "is_phone(p)", "is_numeric(n)",
        "range_check(x, 1, 5)", "range_check(x, 1, 5, false)", "range_check(x, max_value => 5)", "range_check(x)",
        "is_in_list(e, array('abc'))", "is_not_in_list(e, array('abc'))",
    ]:
        by_sql = spark.sql(f"SELECT {text} AS ok FROM people").collect()
        rule = text.replace("=>", "=").replace("array('abc')", "['abc']")
        by_rule = df.select(parse_rule_expression(rule).alias("ok")).collect()
        assert by_sql == by_rule, text
    assert spark.sql("SELECT is_fresh(timestamp'2024-01-01', 3, timestamp'2024-01-04') AS ok").first().ok
    plan = spark.sql("SELECT * FROM people WHERE is_email(e)")._jdf.queryExecution().executedPlan().toString()
    assert "RLIKE" in plan and "is_email" not in plan
    for name in names:
        spark.sql(f"DROP TEMPORARY FUNCTION {name}")


def test_comparisons(spark):
    register_rule_functions(spark)
    row = spark.sql("""SELECT equals('1.0', 1) AS a, equals('x', 'x') AS b, not_equals(2, 3) AS c, greater_than('10', 9) AS d, less_than('b', 'c') AS e,
        greater_than(date'2024-01-02', date'2024-01-01') AS f, equals(NULL, 1) AS g""").first()
    assert tuple(row) == (True, True, True, True, True, True, None)
