import datetime as dt
import random

from pyspark.sql import functions as F

from veriframe.operators import profile as P
from veriframe.operators import sketches as S


def test_parts_add_up(spark, tmp_path):
    path = str(tmp_path / "sketches")
    rows = [(i % 7, float(i % 4999), f"t{i % 1200}", [i % 300, 1], None) for i in range(40_000)]
    df = spark.createDataFrame(rows, "day int, x double, t string, a array<int>, none double").repartition(5)
    whole = {r.column_name: r for r in S.merge(S.sketch(df, columns=["x", "t", "a", "none"])).collect()}
    S.store(df.where("day < 5"), path, "day")
    S.store(df.where("day >= 3"), path, "day")  # days three and four come again and replace themselves
    merged = {r.column_name: r for r in S.profile_stored(spark, path).collect()}
    for found in (whole, merged):
        assert {c: (r.row_count, r.null_count) for c, r in found.items()} == {
            "x": (40_000, 0), "t": (40_000, 0), "a": (40_000, 0), "none": (40_000, 40_000)}
        for c, n in (("x", 4999), ("t", 1200), ("a", 300)):
            assert abs(found[c].distinct_count - n) <= 0.05 * n, c
        assert found["none"].distinct_count == 0 and found["none"].quantiles is None
        assert (found["x"].min_value, found["x"].max_value, found["t"].max_length) == (0.0, 4998.0, 5)
        for q, value in zip(S.QUANTILES, found["x"].quantiles):
            assert abs(value / 4999 - q) < 0.02


def test_old_rows_are_not_read(spark, tmp_path):
    path = str(tmp_path / "sketches")
    S.store(spark.range(1000).selectExpr("id % 3 AS day", "id"), path, "day")
    plan = S.profile_stored(spark, path)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "sketches" in plan and "Range" not in plan


def test_distinct_values_of_any_type(spark):
    rows = [(0.0, [1, 2], {"a": 1, "b": 2}, ("x", None), b"1", True, dt.date(2024, 1, 1), "é" * 1000),
            (-0.0, [1, 2], {"b": 2, "a": 1}, ("x", None), b"1", False, dt.date(2024, 1, 1), "é" * 1000),
            (float("nan"), [2, 1], {"a": 1}, (None, "x"), b"", None, None, "é" * 999), (float("nan"), None, None, None, None, None, None, ""),
            (None, [None], {}, ("x", "x"), b"\x00", True, dt.date(2024, 1, 2), None)]
    df = spark.createDataFrame(rows, "x double, a array<int>, m map<string,int>, s struct<p:string,q:string>, b binary, f boolean, d date, t string")
    found = {r.column_name: r.distinct_count for r in S.distinct_values(df).collect()}
    assert found == {"x": 2, "a": 3, "m": 3, "s": 3, "b": 3, "f": 2, "d": 2, "t": 3}
    empty = {r.column_name: r.distinct_count for r in S.distinct_values(df.where("false")).collect()}
    assert set(empty.values()) == {0} and len(empty) == 8
    profile = {r.column_name: r.distinct_count for r in P.profile(df.select("x", "a", "s", "t"), distinct="exact").collect()}
    assert profile == {"x": 2, "a": 3, "s": 3, "t": 3}


def test_digests_travel_instead_of_long_values(spark):
    rng = random.Random(1)
    df = spark.createDataFrame([("x" * rng.randrange(5000),) for _ in range(50)], "t string")
    plan = S.distinct_values(df)._jdf.queryExecution().executedPlan().toString()
    assert "md5" in plan
    assert S.distinct_values(df).first().distinct_count == df.distinct().count()
    assert df.select(F.length(S.value_digest("t", df.schema["t"].dataType)).alias("n")).distinct().collect()[0].n == 16


def test_numbers_and_times_need_no_digest(spark):
    rows = [(2**63 - 1, 1, 0.1, dt.datetime(2024, 3, 31, 2, 30), True), (2**63 - 2, 1, 0.1 + 2**-55, dt.datetime(2024, 3, 31, 3, 30), True),
            (-2**63, None, 0.30000000000000004, dt.datetime(2024, 3, 31, 3, 30, 0, 1), None)]
    df = spark.createDataFrame(rows, "l long, i int, x double, w timestamp_ntz, f boolean")
    counts = S.distinct_values(df)
    assert "md5" not in counts._jdf.queryExecution().executedPlan().toString()
    assert {r.column_name: r.distinct_count for r in counts.collect()} == {
        c: df.select(c).dropna().distinct().count() for c in df.columns}
