import collections
import random

import pytest
from pyspark.sql import functions as F

from veriframe.operators.cross_table import check_cross_table, check_row_counts, check_totals
from veriframe.operators.freshness import check_freshness, last_value, rows_since
from veriframe.operators.integrity import (
    check_foreign_key, check_primary_key, check_unique, duplicate_rows, orphan_rows,
)
from veriframe.operators.skew import frequent_keys, spread_join
from veriframe.operators.topk import top_per_group
from veriframe.plans.rules import Rule

KEY = Rule("k", columns=("a",), rule_category="integrity", rule_type="multi_field")


def skewed(seed, rows=4000):
    """A third of all rows share one key; some keys are null, some unique."""
    rng = random.Random(seed)
    out = []
    for i in range(rows):
        draw = rng.random()
        key = 7 if draw < 1 / 3 else None if draw < 0.4 else rng.randrange(100, 100 + rows)
        out.append((key, i, rng.randrange(50)))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_unique_and_primary_key_against_brute_force(spark, seed):
    data = skewed(seed)
    df = spark.createDataFrame(data, "a bigint, row bigint, v bigint").repartition(8)
    copies = collections.Counter(a for a, _, _ in data if a is not None)
    repeated = {r for a, r, _ in data if a is not None and copies[a] > 1}
    nulls = sum(a is None for a, _, _ in data)
    row = check_unique(df, KEY).first()
    assert (row.records_checked, row.records_failed) == (len(data), len(repeated))
    assert check_primary_key(df, KEY).first().records_failed == len(repeated) + nulls
    for frequent in (None, [], frequent_keys(df, ["a"], fraction=1.0)):
        assert {r.row for r in duplicate_rows(df, ["a"], frequent).collect()} == repeated


@pytest.mark.parametrize("seed", [3, 4])
def test_foreign_key_against_brute_force(spark, seed):
    data = skewed(seed)
    parents = [(p,) for p in range(100, 2500)] + [(100,), (None,)]
    df = spark.createDataFrame(data, "a bigint, row bigint, v bigint").repartition(8)
    parent = spark.createDataFrame(parents, "p bigint")
    known = {p for (p,) in parents}
    orphans = {r for a, r, _ in data if a is not None and a not in known}
    row = check_foreign_key(df, parent, ["p"], KEY).first()
    assert (row.records_checked, row.records_failed) == (len(data), len(orphans))
    for frequent in (None, [], frequent_keys(df, ["a"], fraction=1.0)):
        assert {r.row for r in orphan_rows(df, parent, ["a"], ["p"], frequent).collect()} == orphans


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "a bigint")
    parent = spark.createDataFrame([(1,)], "p bigint")
    for row in (check_unique(empty, KEY).first(), check_foreign_key(empty, parent, ["p"], KEY).first()):
        assert (row.records_checked, row.records_failed, row.status) == (0, 0, "pass")
    full = spark.createDataFrame([(1,), (2,)], "a bigint")
    assert check_foreign_key(full, parent.where("false"), ["p"], KEY).first().records_failed == 2


def test_frequent_keys_are_found_and_bounded(spark):
    df = spark.createDataFrame(skewed(5), "a bigint, row bigint, v bigint")
    assert [r.a for r in frequent_keys(df, ["a"], fraction=1.0)] == [7]
    many = spark.range(200000).select((F.col("id") % 500).alias("a"))
    assert len(frequent_keys(many, ["a"], fraction=1.0)) == 256


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_spread_join_equals_plain_join(spark, how):
    left = spark.createDataFrame(skewed(6), "a bigint, row bigint, v bigint").repartition(8)
    right = spark.createDataFrame([(7, "x"), (7, "y"), (101, "z"), (None, "n"), (9, "q")], "a bigint, w string")
    frequent = frequent_keys(left, ["a"], fraction=1.0)
    assert frequent
    spread = spread_join(left, right, ["a"], how, frequent)
    plain = left.join(right, ["a"], how)
    assert spread.columns == plain.columns
    assert sorted(map(repr, spread.collect())) == sorted(map(repr, plain.collect()))


def test_spread_join_splits_the_hot_key(spark):
    left = spark.range(80000, numPartitions=32).select(F.lit(7).alias("a"), F.col("id").alias("row"))
    right = spark.createDataFrame([(7, "x")], "a int, w string")
    frequent = frequent_keys(left, ["a"], fraction=1.0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = spread_join(left, right, ["a"], "inner", frequent)
        sizes = joined.groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(sizes) > 1 and sum(r["count"] for r in sizes) == 80000
    assert max(r["count"] for r in sizes) < 80000 * 0.6


def test_composite_frequent_keys(spark):
    left = spark.createDataFrame([(1, "x", i) for i in range(300)] + [(2, None, 1), (3, "z", 2)],
                                 "a int, b string, row int")
    right = spark.createDataFrame([(1, "x", 10), (3, "z", 20), (2, None, 30)], "a int, b string, w int")
    frequent = frequent_keys(left, ["a", "b"], fraction=1.0)
    assert len(frequent) == 1
    assert spread_join(left, right, ["a", "b"], "inner", frequent).count() == 301


def partition_sizes(spark, make):
    """Rows in each task of a join that may not broadcast."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        return sorted(r["count"] for r in make().groupBy(F.spark_partition_id().alias("p")).count().collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_sorted_rows_use_all_groups(spark):
    """All rows of the hot key lie in one partition; the group does not come from the partition."""
    hot = spark.range(60_000).select(F.lit(7).alias("a"), F.col("id").alias("row")).coalesce(1)
    right = spark.createDataFrame([(7, "x")], "a int, w string")
    sizes = partition_sizes(spark, lambda: spread_join(hot, right, ["a"], "inner", frequent_keys(hot, ["a"], fraction=1.0)))
    assert sum(sizes) == 60_000 and len(sizes) >= 10 and sizes[-1] < 20_000


def test_hot_keys_of_the_right_side_are_spread(spark):
    left = spark.createDataFrame([(7, 0), (7, 1), (8, 2), (9, 3)], "a int, l int")
    right = spark.range(60_000).select(F.when(F.col("id") % 3 == 0, 8).otherwise(7).alias("a"), F.col("id").alias("r"))
    found = spread_join(left, right, ["a"], "inner", [], right_frequent=frequent_keys(right, ["a"], fraction=1.0))
    assert found.count() == 40_000 * 2 + 20_000 and found.dropDuplicates().count() == 100_000
    sizes = partition_sizes(spark, lambda: spread_join(left, right, ["a"], "inner", [], right_frequent=frequent_keys(right, ["a"], fraction=1.0)))
    assert sum(sizes) == 100_000 and sizes[-1] < 40_000


def test_keys_hot_on_both_sides_meet_once(spark, monkeypatch):
    from veriframe.operators import skew

    monkeypatch.setattr(skew, "MIN_SAMPLED_COPIES", 1)
    left = spark.createDataFrame([(i % 3, i) for i in range(900)] + [(None, -1)], "a int, l int")
    right = spark.createDataFrame([(i % 4, i) for i in range(400)] + [(None, -1)], "a int, r int")
    both = spread_join(left, right, ["a"])  # sampled on both sides
    given = spread_join(left, right, ["a"], "inner", frequent_keys(left, ["a"], fraction=1.0), 5, frequent_keys(right, ["a"], fraction=1.0))
    want = sorted(map(tuple, left.join(right, "a").select("a", "l", "r").collect()))
    assert len(want) == 90_000
    for df in (both, given):
        assert sorted(map(tuple, df.select("a", "l", "r").collect())) == want
    with pytest.raises(ValueError):
        spread_join(left, right, ["a"], "left", [], right_frequent=frequent_keys(right, ["a"], fraction=1.0))


def test_groups_follow_the_share_of_a_key(spark):
    from veriframe.operators.skew import SALT_CLASSES, _classes, key_shares

    df = spark.createDataFrame([(1,)] * 8000 + [(2,)] * 1500 + [(3,)] * 500, "a int")
    shares = key_shares(df, ["a"], fraction=1.0)
    assert [(r.a, round(s, 2)) for r, s in shares] == [(1, 0.8), (2, 0.15), (3, 0.05)]
    groups = {r.a: n for n, rows in _classes(df, shares) for r in rows}  # four tasks
    assert groups == {1: 8, 2: 2, 3: 2} and set(groups.values()) <= set(SALT_CLASSES)


def test_columns_of_equal_names_are_told_apart(spark):
    left = spark.createDataFrame([(1, 5, "a"), (2, 1, "b"), (3, 9, "c")], "id int, x int, s string")
    right = spark.createDataFrame([(1, 6, "a"), (2, 0, "z"), (4, 1, "q")], "id int, x int, t string")
    rules = [Rule("le", "left.x <= right.x", ("x",), rule_type="cross_table"), Rule("same", "s = t", ("s",), rule_type="cross_table"),
             Rule("which", "x > 1", ("x",), rule_type="cross_table")]
    for right_side, key in ((right, "id"), (right.withColumnRenamed("id", "k").withColumn("id", F.lit(0)), "k")):
        rows = {r.rule_id: r for r in check_cross_table(left, right_side, ["id"], [key], rules).collect()}
        assert [rows[n].records_failed for n in ("le", "same")] == [1, 1] and rows["le"].records_checked == 2
        assert rows["which"].status == "error" and "AMBIGUOUS_REFERENCE" in rows["which"].error_message


def test_top_per_group_with_a_hot_group(spark):
    df = spark.range(20000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("g"), F.col("id").alias("v"))
    rows = top_per_group(df, ["g"], [F.desc("v")], 3).collect()
    want = collections.defaultdict(list)
    for i in range(20000):
        want[0 if i % 3 == 0 else i % 50].append(i)
    got = collections.defaultdict(list)
    for r in sorted(rows, key=lambda r: r["rank"]):
        got[r.g].append(r.v)
    assert got == {g: sorted(v, reverse=True)[:3] for g, v in want.items()}


def test_cross_table(spark):
    lines = spark.createDataFrame([(1, 5), (1, 9), (2, 1), (3, 1), (None, 1)], "k bigint, x bigint")
    heads = spark.createDataFrame([(1, 6), (2, None), (4, 1)], "id bigint, y bigint")
    rules = [Rule("le", "x <= y", ("x", "y"), rule_type="cross_table"),
             Rule("bad", "nothing = 1", ("x",), rule_type="cross_table")]
    rows = {r.rule_id: r for r in check_cross_table(lines, heads, ["k"], ["id"], rules).collect()}
    assert (rows["le"].records_checked, rows["le"].records_failed) == (3, 2)
    assert rows["bad"].status == "error"


def test_totals_and_counts(spark):
    heads = spark.createDataFrame([(1, 10.0), (2, 5.0), (3, 1.0)], "id bigint, total double")
    lines = spark.createDataFrame([(1, 4.0), (1, 6.0), (2, 4.0), (9, 1.0)], "k bigint, x double")
    row = check_totals(heads, lines, ["id"], ["k"], F.col("total"), F.col("x"), KEY).first()
    assert (row.records_checked, row.records_failed) == (4, 3)
    row = check_row_counts(heads, lines, KEY).first()
    assert (row.records_checked, row.records_failed) == (4, 1)


def test_freshness_and_increments(spark):
    df = spark.sql("SELECT explode(array(timestamp'2024-01-01', timestamp'2024-01-05')) AS a")
    now = F.lit("2024-01-06").cast("timestamp")
    assert check_freshness(df, KEY, 1, now).first().status == "pass"
    assert check_freshness(df, KEY, 0, now).first().records_failed == 2
    assert check_freshness(df.where("false"), KEY, 0, now).first().records_failed == 0
    newest = last_value(df.where("a < '2024-01-03'"), "a")
    assert rows_since(df, "a", newest).count() == 1
    assert rows_since(df, "a", None).count() == 2
