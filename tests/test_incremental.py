import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tests.test_rule_tables import assigned, tables  # noqa: F401
from veriframe.errors import RuleError
from veriframe.operators.key_store import KeyStore
from veriframe.operators.results import Run
from veriframe.plans.executor import RuleExecutor, about_rules
from veriframe.plans.incremental import FileRuns, rule_version
from veriframe.plans.rules import Rule


def put(spark, tmp_path, part, values):
    spark.createDataFrame([(v,) for v in values], "n int").coalesce(1).write.mode("overwrite").parquet(str(tmp_path / "data" / "t" / f"part={part}"))


def state(df):
    return {r.rule_id: (r.records_checked, r.records_failed) for r in df.collect()}


def test_files_are_counted_once_for_each_version_of_a_rule(spark, tables, tmp_path, monkeypatch):  # noqa: F811
    read = []
    from veriframe.sources.connectors import FileSource

    real = FileSource.read_files
    monkeypatch.setattr(FileSource, "read_files", lambda self, t, paths: read.append(sorted(p.split("part=")[1][0] for p in paths)) or real(self, t, paths))
    assigned(tables, ("low", ["n"], "n < 5", None, "t", True, True), ("odd", ["n"], "n % 2 = 1", None, "t", True, True))
    runs = FileRuns(RuleExecutor(tables))
    put(spark, tmp_path, 1, [1, 2, 7])
    put(spark, tmp_path, 2, [8, 9])
    assert state(runs.execute(["as-low"])) == {"low": (5, 3)} and read.pop() == ["1", "2"] and not read
    # a second rule reads all files, the first one none of them
    put(spark, tmp_path, 3, [3])
    assert state(runs.execute(["as-low", "as-odd"])) == {"low": (6, 3), "odd": (6, 2)}
    assert sorted(map(tuple, read)) == [("1", "2"), ("3",)]
    read.clear()
    assert state(runs.execute(["as-low", "as-odd"])) == {"low": (6, 3), "odd": (6, 2)} and not read
    # a changed rule sees old files; the other one does not read them again
    tables.append_rows("validation_rules", [{
        "rule_id": "low", "rule_name": "low", "rule_type": "single_field", "rule_category": "accuracy", "severity_level": "high",
        "rule_logic": "n < 8", "created_by": "test", "is_active": True, "version": 2}])
    assert state(runs.execute(["as-low", "as-odd"])) == {"low": (6, 2), "odd": (6, 2)} and read.pop() == ["1", "2", "3"] and not read
    # files that are replaced, emptied or deleted count as they are now
    put(spark, tmp_path, 1, [100])
    put(spark, tmp_path, 2, [])
    assert state(runs.execute(["as-low", "as-odd"])) == {"low": (2, 1), "odd": (2, 1)} and read.pop() == ["1", "2"] and not read
    assert state(runs.execute(["as-odd"])) == {"odd": (2, 1)} and not read
    stored = tables.read("validation_results")
    assert stored.select("run_id").distinct().count() == 6


def test_a_rule_that_fails_on_a_value_keeps_its_files(spark, tables, tmp_path):  # noqa: F811
    path = str(tmp_path / "data" / "t")
    spark.createDataFrame([("1",), ("x",)], "n string").coalesce(1).write.parquet(path)
    assigned(tables, ("cast", ["n"], "cast(n as int) > 0", None, "t", True, True), ("len", ["n"], "length(n) = 1", None, "t", True, True),
             ("gone", ["y"], "y > 1", None, "t", True, True))
    runs = FileRuns(RuleExecutor(tables))
    ids = ["as-cast", "as-len", "as-gone"]
    rows = {r.rule_id: r for r in runs.execute(ids).collect()}
    assert (rows["len"].status, rows["len"].records_checked) == ("pass", 2)
    assert rows["cast"].status == rows["gone"].status == "error" and "CAST_INVALID_INPUT" in rows["cast"].error_message
    spark.createDataFrame([("1",), ("2",)], "n string").coalesce(1).write.mode("overwrite").parquet(path)
    rows = {r.rule_id: r for r in runs.execute(ids).collect()}
    assert (rows["cast"].status, rows["cast"].records_checked) == ("pass", 2)
    with pytest.raises(RuleError):
        runs.execute(["as-nothing"])


def test_versions_change_with_what_a_rule_says():
    rule = Rule("r", "a > 1", ("a",), threshold_value=1.0)
    same = Rule("r", "a > 1", ("a",), threshold_value=2.0, severity_level="low", rule_name="other")
    assert rule_version(rule) == rule_version(same)
    others = [Rule("r", "a > 2", ("a",)), Rule("r", "a > 1", ("b",)), Rule("r", "a > 1", ("a",), null_policy="skip")]
    assert len({rule_version(r) for r in [rule, *others]}) == 4


def test_only_errors_of_rules_are_theirs(spark):
    with pytest.raises(Exception) as lost:
        spark.read.parquet("/no/such/folder").count()
    with pytest.raises(Exception) as wrong:
        spark.range(1).selectExpr("cast('x' as int)").collect()
    assert about_rules(wrong.value) and about_rules(lost.value)  # both have a condition of their own
    assert not about_rules(RuntimeError("Job aborted due to stage failure: ExecutorLostFailure"))


KEYS = Rule("u", columns=("a", "b"), rule_type="multi_field", rule_category="integrity")


def test_keys_over_time(spark, tmp_path):
    rng = random.Random(2)
    store = KeyStore(spark, f"keys_{rng.randrange(10**9)}", ["a", "b"], 8, str(tmp_path / "keys"))
    schema, batches = "a int, b string, x int", {}
    for name in ("m", "n", "m", "o"):  # m comes again, with other rows
        batches[name] = [(rng.randrange(30), rng.choice(["x", "y", None]), i) for i in range(40)]
        store.add(spark.createDataFrame(batches[name], schema), name)
        counts = {}
        for rows in batches.values():
            for a, b, _ in rows:
                counts[a, b] = counts.get((a, b), 0) + 1
        failed = sum(n for (_, b), n in counts.items() if b is not None and n > 1)
        result = store.check(KEYS, Run()).first()
        assert (result.records_checked, result.records_failed) == (sum(counts.values()), failed)
    own = {}
    for a, b, _ in batches["o"]:
        own[a, b] = own.get((a, b), 0) + 1
    want = {(k, n, counts[k] - n) for k, n in own.items() if k[1] is not None and counts[k] > 1}
    assert {((r.a, r.b), r.copies, r.earlier) for r in store.repeated_in("o").collect()} == want
    new = spark.createDataFrame([(1, "x", 0), (99, "x", 1)], schema)
    assert {r.a for r in store.known(new).collect()} <= {1}
    with pytest.raises(RuleError):
        store.check(Rule("u", columns=("a",)))


def test_old_keys_are_not_shuffled(spark, tmp_path):
    store = KeyStore(spark, f"keys_{random.randrange(10**9)}", ["a", "b"], 8, str(tmp_path / "keys"))
    for name in ("m", "n"):
        store.add(spark.range(100).selectExpr("cast(id as int) AS a", "cast(id % 2 as string) AS b"), name)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        check = store.check(KEYS)._jdf.queryExecution().executedPlan().toString()
        known = store.known(spark.range(10).selectExpr("cast(id as int) AS a", "cast(id % 2 as string) AS b"))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "hashpartitioning(a" not in check and "Bucketed: true" in check
    new, old = known.split("Range (")  # the new rows come first in the plan
    assert "Exchange" in new and "Exchange" not in old and "Bucketed: true" in old


def test_times_in_the_log_do_not_depend_on_the_zone(spark, tables, tmp_path, monkeypatch):  # noqa: F811
    import os
    import time

    spark.createDataFrame([(1,)], "n int").write.parquet(str(tmp_path / "data" / "t"))
    assigned(tables, ("low", ["n"], "n < 5", None, "t", True, True))
    before, began = os.environ.get("TZ"), dt.datetime.now(dt.UTC).timestamp()
    try:
        os.environ["TZ"] = "Asia/Tokyo"
        time.tzset()
        RuleExecutor(tables).execute_batch(["as-low"], "run-1")
    finally:
        os.environ.pop("TZ") if before is None else os.environ.update(TZ=before)
        time.tzset()
    for name, column in (("execution_logs", "event_time"), ("validation_results", "validation_timestamp")):
        at = tables.read(name).agg(F.max(F.unix_micros(column))).first()[0] / 1e6
        assert began - 5 <= at <= began + 300, name
