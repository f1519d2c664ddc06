import math
import random
import statistics

from pyspark.sql import functions as F

from veriframe.functions.ruletext import parse_rule_expression
from veriframe.operators import profile as P
from veriframe.operators import selection


def test_profile_against_brute_force(spark):
    rng = random.Random(1)
    data = [(i, rng.choice([None, "a", "b", "cc"]), rng.gauss(0, 1)) for i in range(500)]
    df = spark.createDataFrame(data, "k bigint, t string, x double")
    rows = {r.column_name: r for r in P.profile(df, distinct="exact").collect()}
    texts = [t for _, t, _ in data]
    xs = [x for _, _, x in data]
    assert (rows["t"].null_count, rows["t"].distinct_count) == (texts.count(None), 3)
    assert (rows["t"].min_text, rows["t"].max_text, rows["t"].max_length) == ("a", "cc", 2)
    assert (rows["k"].row_count, rows["k"].distinct_count, rows["k"].min_value, rows["k"].max_value) == (500, 500, 0, 499)
    assert abs(rows["x"].mean_value - statistics.fmean(xs)) < 1e-9
    assert abs(rows["x"].stddev_value - statistics.stdev(xs)) < 1e-9
    assert rows["x"].quantiles == [sorted(xs)[i] for i in (124, 249, 374)]
    assert rows["t"].min_value is None and rows["t"].quantiles is None


def test_quartiles_of_large_data_are_close(spark):
    df = spark.range(300000).select(F.pmod(F.xxhash64("id"), F.lit(1000000)).alias("x"))
    got = P.profile(df).first().quantiles
    values = sorted(r.x for r in df.collect())
    for q, value in zip(P.QUANTILES, got, strict=True):
        rank = sum(v <= value for v in values)
        assert abs(rank - q * len(values)) <= len(values) * 1e-3


def test_approx_profile_reads_each_column_twice(spark, small):
    df = spark.read.parquet(f"{small}/lineitem.parquet")
    plan = P.profile(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 4
    rows = {r.column_name: r for r in P.profile(df).collect()}
    assert rows["l_returnflag"].distinct_count == 3


def test_shapes_and_top_values(spark):
    df = spark.createDataFrame([("Ab-1",), ("Xy-2",), ("zz",), (None,)], "c string")
    rows = [tuple(r) for r in P.patterns(df, ["c"], 5).orderBy("rank").collect()]
    assert rows == [("c", "Aa-9", 2, 1), ("c", "aa", 1, 2)]
    assert P.top_values(df, ["c"], 1).count() == 1


def test_suggestions_hold(spark):
    df = spark.createDataFrame(
        [(i, "it's" if i % 2 else "b", float(i), None if i == 3 else "x") for i in range(50)],
        "k bigint, t string, x double, n string")
    found = {(r.column_name, r.suggestion): r.rule_logic for r in P.suggest_rules(df).collect()}
    assert ("k", "unique") in found and ("t", "unique") not in found
    assert ("n", "not_null") not in found and found[("x", "range")] == "range_check(col('x'), 0.0, 49.0)"
    for (name, kind), text in found.items():
        if kind != "unique" and name != "n":
            assert df.where(parse_rule_expression(text)).count() == 50, text


def test_outliers(spark):
    df = spark.createDataFrame([(float(i % 10), i) for i in range(200)] + [(1000.0, -1), (None, -2)], "x double, k int")
    for method in ("iqr", "stddev"):
        rows = P.outliers(df, ["x"], method).collect()
        assert [(r.k, r.unusual) for r in rows] == [(-1, ["x"])]
    assert P.outliers(df.where("x IS NULL"), ["x"]).count() == 0


def test_exact_quantiles(spark, monkeypatch):
    """Few buckets force several passes; a third of all rows share one value."""
    monkeypatch.setattr(selection, "BUCKETS", 8)
    monkeypatch.setattr(selection, "OCTAVE_PARTS", 1)
    rng = random.Random(3)
    data = [(7.0 if rng.random() < 1 / 3 else round(rng.uniform(-100, 100), 3), rng.choice([1, 2, None]), None)
            for _ in range(30000)]
    df = spark.createDataFrame(data, "x double, k int, none double").repartition(8)
    probabilities = [0.0, 0.001, 0.25, 0.5, 0.75, 0.9999, 1.0]
    found = P.quantiles(df, ["x", "k", "none"], probabilities)
    for i, name in enumerate(["x", "k"]):
        values = sorted(row[i] for row in data if row[i] is not None)
        ranks = [max(1, math.ceil(len(values) * p)) for p in probabilities]
        assert found[name] == [values[r - 1] for r in ranks], name
    assert found["none"] == [None] * 7


def test_quantiles_of_odd_numbers(spark):
    """Both zeros, subnormal, huge and infinite numbers, neighbours, NaN and nulls."""
    odd = [0.0, -0.0, 5e-324, -5e-324, 2.2250738585072014e-308, 1.7976931348623157e308, -1.7976931348623157e308, float("inf"), float("-inf"),
           1.0, 1.0000000000000002, 0.9999999999999999, -1.0, -1.0000000000000002, 1e-300, 3.0, 2.0**53, 2.0**53 + 2]
    data = [(x,) for x in odd * 3] + [(float("nan"),), (None,)] * 4
    df = spark.createDataFrame(data, "x double").repartition(3)
    values = sorted(odd * 3)
    probabilities = [i / len(values) for i in range(len(values) + 1)]
    want = [values[max(1, math.ceil(len(values) * p)) - 1] for p in probabilities]
    assert P.quantiles(df, ["x"], probabilities)["x"] == want
    assert P.quantiles(df.where("x IS NULL"), ["x"], [0.5]) == {"x": [None]}
    assert P.quantiles(df, ["x"], []) == {"x": []}


def test_quantiles_take_few_scans_and_sort_nothing(spark, monkeypatch):
    passes = []
    real = selection._histogram
    monkeypatch.setattr(selection, "_histogram", lambda df, brackets: passes.append(real(df, brackets)) or passes[-1])
    df = spark.range(400_000).select(F.pmod(F.xxhash64("id"), F.lit(10**9)).cast("double").alias("a"), F.randn(5).alias("b"),
                                     F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("c"))
    found = P.quantiles(df, ["a", "b", "c"], [0.25, 0.5, 0.75])
    assert len(passes) <= 4
    plan = passes[-1]._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan and plan.count("Exchange") == 1 and "partial_count" in plan
    ids = sorted(7 if i % 3 == 0 else i for i in range(400_000))
    assert found["c"] == [ids[400_000 * i // 4 - 1] for i in (1, 2, 3)]


def test_outliers_iqr_query(spark, small):
    from queries import load_all

    values = sorted((r.value, r.event_id) for r in spark.read.parquet(f"{small}/events.parquet").collect())
    n = len(values)
    low, high = values[-(-n // 4) - 1][0], values[-(-3 * n // 4) - 1][0]
    reach = 1.5 * (high - low)
    want = {k for v, k in values if v < low - reach or v > high + reach}
    got = {r.event_id for r in load_all()[0]["outliers_iqr"](spark, small).collect()}
    assert got == want and want


def test_recommendation(spark):
    columns = spark.createDataFrame([("email", "string"), ("age", "int")], "column_name string, data_type string")
    history = spark.createDataFrame(
        [("email", "string", "is_email", 2.0), ("email", "string", "is_email", 4.0), ("email", "string", "not_null", 0.0),
         ("age", "string", "range", 0.0)], "column_name string, data_type string, rule_logic string, failure_rate double")
    rows = [tuple(r) for r in P.recommend_rules(columns, history).collect()]
    assert rows == [("email", "string", "is_email", 2, 3.0), ("email", "string", "not_null", 1, 0.0)]


def test_merged_profile_counts_distinct_values_once(spark, small, monkeypatch):
    """Quartiles are looked up without the exact counts, which only the result needs."""
    from queries import load_all
    from veriframe.operators import sketches

    counted = F.raise_error(F.lit("counted")).cast("string").alias("column_name")
    monkeypatch.setattr(sketches, "distinct_values", lambda df: df.select(counted, F.lit(1).alias("distinct_count")))
    assert "exact" not in load_all()[0]["profile_merged"](spark, small).columns
