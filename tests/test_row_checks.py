import os
import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from veriframe.errors import RuleError
from veriframe.operators.integrity import check_unique, duplicate_rows
from veriframe.operators.results import Run
from veriframe.operators.row_checks import check_rows, with_predicates
from veriframe.operators.samples import (
    attach_samples, mark_violations, mask_columns, sample_violations, split_rows, store_split,
)
from veriframe.plans.rules import TABLE_SCHEMAS, Rule
from veriframe.plans.validators import MultiFieldValidator, SingleFieldValidator


def one(df, rule, **kw):
    return check_rows(df, [rule], **kw).first()


def test_completeness_and_accuracy(users):
    v = SingleFieldValidator()
    row = v.validate_completeness(users, "email").first()
    assert (row.records_checked, row.records_failed, row.records_passed) == (4, 1, 3)
    row = v.validate_accuracy(users, "email", "email").first()
    assert (row.records_checked, row.records_failed) == (4, 2)
    row = v.validate_accuracy(users, "age", "range", min_value=26).first()
    assert row.records_failed == 1
    with pytest.raises(RuleError):
        v.validate_accuracy(users, "email", "colour")


def test_threshold(users):
    rule = Rule("r", "is_email(col('email'))", ("email",), threshold_value=50.0)
    row = one(users, rule)
    assert (row.failure_rate, row.threshold_passed, row.status) == (50.0, True, "pass")
    strict = Rule("r", "is_email(col('email'))", ("email",), threshold_value=49.9)
    row = one(users, strict)
    assert (row.threshold_passed, row.status) == (False, "fail")
    none = Rule("r", "is_email(col('email'))", ("email",))
    row = one(users, none)
    assert (row.threshold_passed, row.status) == (True, "fail")
    zero = Rule("r", "is_not_null(col('name'))", ("name",), threshold_value=0.0)
    row = one(users, zero)
    assert (row.threshold_value, row.failure_rate, row.status) == (0.0, 0.0, "pass")


def test_warning_only_by_option(users):
    rule = Rule("r", "is_email(col('email'))", ("email",), severity_level="low")
    assert one(users, rule).status == "fail"
    assert one(users, rule, run=Run(warn_on_low=True)).status == "warning"


def test_null_policy(users):
    logic = "is_email(col('email'))"
    assert one(users, Rule("r", logic, ("email",))).records_failed == 2
    assert one(users, Rule("r", logic, ("email",), null_policy="skip")).records_failed == 1


def test_empty_table(users):
    row = one(users.where("false"), Rule("r", "is_email(col('email'))", ("email",)))
    assert (row.records_checked, row.failure_rate, row.status) == (0, 0.0, "pass")


def test_multi_field(spark):
    v = MultiFieldValidator()
    letters = spark.createDataFrame([("A", "A"), ("B", "B"), ("C", "D")], "col1 string, col2 string")
    row = v.validate_consistency(letters, ["col1", "col2"], "equals").first()
    assert (row.records_checked, row.records_failed) == (3, 1)
    bounds = spark.createDataFrame([(10, 5), (20, 15), (5, 10)], "start bigint, end bigint")
    assert v.validate_consistency(bounds, ["start", "end"], "greater_than").first().records_failed == 1
    totals = spark.createDataFrame([(100, 50, 50), (200, 150, 50), (100, 80, 30)],
                                   "total bigint, subtotal bigint, tax bigint")
    row = v.validate_business_logic(
        totals, "col('total') == col('subtotal') + col('tax')", ["total", "subtotal", "tax"]).first()
    assert row.records_failed == 1
    with pytest.raises(RuleError):
        v.validate_consistency(bounds, ["start", "end"], "similar")
    with pytest.raises(RuleError):
        v.validate_consistency(bounds, ["start"], "equals")


def test_validate_attaches_sample(users):
    rule = Rule("r", "is_email(col('email'))", rule_category="accuracy")
    row = SingleFieldValidator().validate(users, rule, "email", sample_size=1).first()
    assert row.records_failed == 2 and len(row.sample_failed_records) == 1
    row = SingleFieldValidator().validate(users, rule, "email").first()
    assert sorted(row.sample_failed_records) == ['{"email":"invalid-email"}', '{"email":null}']


def test_fused_equals_one_by_one(spark, small):
    from queries.base import rules_from
    from queries.row_rules import LINEITEM_RULES

    df = spark.read.parquet(f"{small}/lineitem.parquet")
    rules = rules_from(LINEITEM_RULES)
    fused = {r.rule_id: r.asDict() for r in check_rows(df, rules, Run(at=None)).drop("validation_timestamp", "run_date").collect()}
    chunked = {r.rule_id: r.asDict() for r in check_rows(df, rules, rules_per_scan=7).drop("validation_timestamp", "run_date").collect()}
    assert fused == chunked and len(fused) == len(rules)
    for rule in rules[:5]:
        alone = one(df, rule)
        assert alone.records_failed == fused[rule.rule_id]["records_failed"]
    assert all(r["records_passed"] + r["records_failed"] == r["records_checked"] for r in fused.values())


def test_many_rules_in_one_scan(spark):
    df = spark.range(1000)
    rules = [Rule(f"r{i}", f"id % {i + 2} <> 0", ("id",)) for i in range(300)]
    results = check_rows(df, rules)
    rows = {r.rule_id: r.records_failed for r in results.collect()}
    assert rows == {f"r{i}": len(range(0, 1000, i + 2)) for i in range(300)}
    assert results._jdf.queryExecution().executedPlan().toString().count("Range (0, 1000") <= 2


def test_result_schema(users):
    df = check_rows(users, [Rule("r", "age > 1", ("age",))])
    stored = TABLE_SCHEMAS["validation_results"].replace("\n", " ")
    assert [c.split()[0] for c in stored.split(", ")] == df.columns


def test_predicate_columns(users):
    df = with_predicates(users, [Rule("e", "is_email(column)", ("email",))])
    assert df.where("ok_e").count() == 2 and df.where("ok_e IS NULL").count() == 0
    with pytest.raises(RuleError):
        with_predicates(users, [Rule("x", "nothing > 1")])


def test_split_and_mask(users):
    rules = [Rule("e", "is_email(column)", ("email",)), Rule("a", "age < 35", ("age",))]
    good, bad = split_rows(users, rules)
    assert good.count() == 2 and good.columns == users.columns
    found = {r.name: r.violated for r in bad.collect()}
    assert found == {"Bob Johnson": ["e", "a"], "Alice Brown": ["e"]}
    marked = mark_violations(users, rules)
    assert marked.where(F.size("violated") == 0).count() == 2
    row = mask_columns(users, {"email": "hash", "name": "mask", "age": "redact"}).first()
    assert len(row.email) == 64 and row.name == "Xxxx Xxx" and row.age == "***"


def test_split_in_one_write(spark, users, tmp_path):
    rules = [Rule("e", "is_email(column)", ("email",)), Rule("a", "age < 35", ("age",))]
    for n, (want, got) in enumerate(zip(split_rows(users, rules), store_split(users, rules, str(tmp_path / "s")))):
        assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect())), n
    good, bad = store_split(users, [Rule("all", "true", ("age",))], str(tmp_path / "s"))
    assert (good.count(), bad.count()) == (4, 0)


def test_sample_is_bounded_ordered_and_masked(spark):
    df = spark.range(5000).select("id", (F.col("id") % 3).alias("k"), F.lit("secret").alias("s"))
    rules = [Rule("third", "k <> 0", ("k", "s"), rule_type="multi_field"), Rule("all", "id < 0", ("id",)), Rule("none", "id >= 0", ("id",))]
    rows = sample_violations(df, rules, ["id"], 7, sensitive={"s": "redact"}).collect()
    by_rule = {}
    for r in sorted(rows, key=lambda r: r["rank"]):
        by_rule.setdefault(r.rule_id, []).append(r)
    assert set(by_rule) == {"third", "all"}
    assert [r.record_key for r in by_rule["third"]] == ['{"id":%d}' % i for i in range(0, 21, 3)]
    assert by_rule["third"][0].record == '{"k":0,"s":"***"}'
    assert [r["rank"] for r in by_rule["all"]] == list(range(1, 8))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_bounds_do_not_change_a_sample(spark, seed):
    """Keys with nulls, ties, NaN, quotes and times; the share that sets bounds is large and small."""
    rng = random.Random(seed)
    texts = [None, "a", "it's", "b\\n", "", "é"]
    rows = [(rng.choice(texts), rng.choice([None, 0.1, -0.0, float("nan"), float("inf"), 1 / 3]),
             dt.datetime(2024, 1, 1) + dt.timedelta(microseconds=rng.randrange(1000)), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "t string, x double, at timestamp, i int").repartition(8)
    rules = [Rule("all", "i < 0"), Rule("third", "i % 3 <> 0"), Rule("few", "i <> 77"), Rule("none", "i >= 0")]
    plain = sample_violations(df, rules, ["t", "x", "at", "i"], 40, bound_from=0.0)
    want = sorted(map(repr, plain.collect()))
    assert len(want) == 81
    for share in (0.01, 0.1, 1.0):
        got = sample_violations(df, rules, ["t", "x", "at", "i"], 40, bound_from=share)
        assert sorted(map(repr, got.collect())) == want


def test_odd_column_names(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("b", None)], "`first.name` string, `a ``b` int")
    rules = [Rule("r", "is_not_null(column)", ("a `b",)), Rule("s", "col('first.name') = 'a'", ("first.name",))]
    assert {r.rule_id: r.records_failed for r in check_rows(df, rules).collect()} == {"r": 1, "s": 2}
    rows = sample_violations(df, rules, ["first.name", "a `b"], sensitive={"first.name": "redact"}).collect()
    assert {r.record for r in rows} == {'{"a `b":null}', '{"first.name":"***"}'} and len(rows) == 3
    key = Rule("k", columns=("first.name",), rule_type="multi_field")
    assert check_unique(df, key).first().records_failed == 2
    assert duplicate_rows(df, ["first.name"]).count() == 2


def test_samples_of_rules_without_failures(users):
    rules = [Rule("r", "age > 1", ("age",))]
    results = attach_samples(check_rows(users, rules), sample_violations(users, rules, ["name"]))
    assert results.first().sample_failed_records == []


def test_counts_of_many_tasks_are_merged_in_two_rounds(spark, users):
    rules = [Rule("e", "is_email(column)", ("email",)), Rule("a", "age < 35", ("age",))]
    want = {r.rule_id: r.records_failed for r in check_rows(users, rules).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", "2000")
    try:
        results = check_rows(users.repartition(4), rules)
        got = {r.rule_id: r.records_failed for r in results.collect()}
        empty = check_rows(users.where("false"), rules).first()
        plan = results._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == want and "hashpartitioning(_group" in plan
    assert (empty.records_checked, empty.records_failed) == (0, 0)


def test_rules_that_are_not_about_a_row_are_error_rows(spark):
    df = spark.range(5)
    rules = [Rule("agg", "max(id) > 3", ("id",)), Rule("win", "row_number() OVER (ORDER BY id) > 1", ("id",)),
             Rule("gone", "nowhere > 1", ("id",)), Rule("ok", "id >= 0", ("id",))]
    rows = {r.rule_id: r for r in check_rows(df, rules, Run("r")).collect()}
    assert rows["ok"].status == "pass"
    assert all(rows[k].status == "error" for k in ("agg", "win", "gone"))
    assert "UNRESOLVED_COLUMN" in rows["gone"].error_message and "errorClass" not in rows["gone"].error_message


def test_time_keys_bound_samples_in_any_driver_zone(spark):
    import time

    from veriframe.operators.samples import sample_violations

    df = spark.range(20_000).selectExpr("id", "timestamp_seconds(1700000000 + id) AS ts")
    rules = [Rule("late", "id < 0", ("id",))]
    before = os.environ.get("TZ")
    try:
        os.environ["TZ"] = "America/New_York"
        time.tzset()
        got = sample_violations(df, rules, ["ts"], 20, bound_from=0.1).collect()
    finally:
        os.environ.pop("TZ") if before is None else os.environ.update(TZ=before)
        time.tzset()
    want = sample_violations(df, rules, ["ts"], 20, bound_from=0.0).collect()
    assert len(got) == 20 and sorted(r.record for r in got) == sorted(r.record for r in want)


def test_a_rule_on_two_columns_has_two_samples(spark):
    df = spark.createDataFrame([(i, i % 4, i % 5) for i in range(100)], "id int, a int, b int")
    rules = [Rule("nn", "column > 0", ("a",)), Rule("nn", "column > 0", ("b",)), Rule("nn", "column > 0", ("b",), assignment_id="x")]
    rows = sample_violations(df, rules, ["id"], 6, bound_from=0.5).collect()
    found = {}
    for r in sorted(rows, key=lambda r: r["rank"]):
        found.setdefault((tuple(r.column_names), r.assignment_id), []).append((r.record_key, r.record))
    a = [(f'{{"id":{i}}}', '{"a":0}') for i in range(0, 24, 4)]
    b = [(f'{{"id":{i}}}', '{"b":0}') for i in range(0, 30, 5)]
    assert found == {(("a",), None): a, (("b",), None): b, (("b",), "x"): b}
    results = attach_samples(check_rows(df, rules), sample_violations(df, rules, ["id"], 2)).collect()
    assert sorted((r.column_names[0], r.sample_failed_records) for r in results) == [
        ("a", ['{"a":0}'] * 2), ("b", ['{"b":0}'] * 2), ("b", ['{"b":0}'] * 2)]


def test_ranges_of_dates_and_text(spark):
    from veriframe.plans.validators import SingleFieldValidator

    df = spark.createDataFrame([(dt.date(2024, 1, i), dt.datetime(2024, 1, i, 12), f"k{i}") for i in range(1, 10)], "d date, t timestamp_ntz, s string")
    v = SingleFieldValidator()
    for column, low, high, failed in (("d", dt.date(2024, 1, 3), dt.date(2024, 1, 5), 6), ("d", "2024-01-03", None, 2), ("s", "k2", "k8", 2),
                                      ("t", dt.datetime(2024, 1, 2, 12), dt.datetime(2024, 1, 2, 13), 8), ("d", None, dt.date(2023, 1, 1), 9)):
        row = v.validate_accuracy(df, column, "range", min_value=low, max_value=high).first()
        assert (row.status, row.records_failed) == ("fail", failed), (column, row.error_message)
