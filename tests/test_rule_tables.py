import datetime as dt

import pytest

from veriframe.errors import MetadataError, RuleError
from veriframe.operators.results import Run
from veriframe.plans.constraints import check_constraints
from veriframe.plans.executor import RuleExecutor
from veriframe.plans.imports import BatchRuleImporter, import_rules, read_rules_csv
from veriframe.plans.metadata import MetadataTables, current_versions, execution_states, resolve_assignments
from veriframe.session import shared_folder

HEADER = "rule_name,rule_type,rule_category,severity_level,rule_logic,created_by"
TARGET = "target_source,target_schema,target_table,target_columns,execution_frequency"


@pytest.fixture
def tables(spark, tmp_path):
    made = MetadataTables(spark, str(tmp_path / "rules"))
    made.append_rows("data_sources", [{
        "source_id": "lake", "source_name": "Test Source", "source_type": "s3",
        "connection_config": {"root": str(tmp_path / "data")}, "is_active": True}])
    return made


def write(path, *lines):
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def test_valid_file(tables, tmp_path):
    path = write(tmp_path / "r.csv", HEADER, "Test Rule,single_field,accuracy,high,is_email(col('email')),admin")
    found = BatchRuleImporter(tables).validate_import_file(path)
    assert (found["valid"], found["total_rows"], found["empty_rows"]) == (True, 1, 0)
    assert found["columns"] == HEADER.split(",")


def test_missing_columns(tables, tmp_path):
    path = write(tmp_path / "r.csv", "rule_name,rule_type", "Test Rule,single_field")
    found = BatchRuleImporter(tables).validate_import_file(path)
    assert not found["valid"] and len(found["missing_columns"]) == 4
    with pytest.raises(MetadataError):
        BatchRuleImporter(tables).import_from_csv(path)


def test_empty_names(tables, tmp_path):
    path = write(tmp_path / "r.csv", HEADER, ",single_field,accuracy,high,x > 1,admin")
    found = BatchRuleImporter(tables).validate_import_file(path)
    assert (found["valid"], found["empty_rows"]) == (False, 1)


def test_import_rules_only(tables, tmp_path):
    path = write(tmp_path / "r.csv", HEADER, "Email Check,single_field,accuracy,high,is_email(col('email')),admin")
    totals = BatchRuleImporter(tables).import_from_csv(path, create_assignments=False)
    assert totals == {"total_rows": 1, "rules_created": 1, "assignments_created": 0, "errors": 0}
    rule = tables.read("validation_rules").first()
    assert (rule.rule_name, rule.is_active, rule.version) == ("Email Check", True, 1)
    version = tables.read("rule_version_history").first()
    assert (version.rule_id, version.version_number, version.changed_by) == (rule.rule_id, 1, "admin")


def test_import_with_assignment(tables, tmp_path):
    path = write(tmp_path / "r.csv", f"{HEADER},{TARGET}",
                 "Email Check,single_field,accuracy,high,is_email(col('email')),admin,Test Source,public,users,email,batch")
    totals = BatchRuleImporter(tables).import_from_csv(path)
    assert totals == {"total_rows": 1, "rules_created": 1, "assignments_created": 1, "errors": 0}
    row = tables.read("rule_assignments").first()
    assert (row.source_id, row.column_names, row.priority_order) == ("lake", ["email"], 0)


def test_import_with_unknown_source(tables, tmp_path):
    path = write(tmp_path / "r.csv", f"{HEADER},{TARGET}",
                 "Email Check,single_field,accuracy,high,is_email(col('email')),admin,Nowhere,public,users,email,batch")
    totals = BatchRuleImporter(tables).import_from_csv(path)
    assert totals == {"total_rows": 1, "rules_created": 1, "assignments_created": 0, "errors": 1}


def test_quoted_and_unquoted_commas(spark, tables, tmp_path):
    """A rule with commas must be quoted; without quotes its line is rejected, the others are kept."""
    head = "rule_name,rule_type,rule_category,severity_level,rule_logic,threshold_value,description,created_by," + TARGET
    tail = "admin,Test Source,public,users"
    path = write(
        tmp_path / "r.csv", head,
        f"Email,single_field,accuracy,high,is_email(col('email')),5.0,Validates,{tail},email,batch",
        f"Age raw,single_field,accuracy,medium,range_check(col('age'), 18, 100),10.0,Validates,{tail},age,batch",
        f"Age,single_field,accuracy,medium,\"range_check(col('age'), 18, 100)\",10.0,Validates,{tail},age,batch",
        f"Name,single_field,completeness,high,is_not_empty(col('name')),0.0,Ensures,{tail},name,batch")
    outcome = import_rules(read_rules_csv(spark, path), tables.read("data_sources"))
    assert outcome.summary.first().asDict() == {
        "total_rows": 4, "rules_created": 3, "assignments_created": 3, "errors": 1}
    assert "malformed line" in outcome.errors.first().error
    rules = {r.rule_name: r for r in outcome.rules.collect()}
    assert rules["Age"].rule_logic == "range_check(col('age'), 18, 100)"
    assert rules["Name"].threshold_value == 0.0


def test_bad_values_are_reported(spark, tables):
    df = spark.createDataFrame(
        [("a", "single", "accuracy", "high", "x", "me", "1"), ("b", "single_field", "accuracy", "urgent", "", "me", "many"),
         ("c" * 256, "single_field", "wrong", "low", "x", None, None)],
        "rule_name string, rule_type string, rule_category string, severity_level string, rule_logic string, "
        "created_by string, threshold_value string")
    outcome = import_rules(df)
    errors = [r.error for r in outcome.errors.orderBy("row").collect()]
    assert errors[0] == "invalid rule_type: single"
    assert errors[1] == "invalid severity_level: urgent; rule_logic is empty; threshold_value is not a number"
    assert errors[2] == "rule_name must have 1 to 255 characters; invalid rule_category: wrong; created_by is empty"
    assert outcome.rules.count() == 0


def test_constraints_of_scores(spark):
    df = spark.createDataFrame(
        [("t", dt.date(2024, 1, 1), 85.5, None), ("t", dt.date(2024, 1, 2), 150.0, 10.0), ("t", dt.date(2024, 1, 2), 1.0, -1.0)],
        "table_name string, score_date date, overall_score double, completeness_score double")
    for c in ("accuracy", "consistency", "integrity", "timeliness"):
        df = df.selectExpr("*", f"cast(null as double) as {c}_score")
    failed = {r.rule_id: r.records_failed for r in check_constraints({"quality_scores": df}).collect()}
    assert failed["overall_score_in_range"] == 1 and failed["completeness_score_in_range"] == 1
    assert failed["accuracy_score_in_range"] == 0 and failed["quality_scores_unique"] == 2


def test_versions_and_log(spark):
    versions = spark.createDataFrame([("r", 1, "a"), ("r", 3, "c"), ("r", 2, "b"), ("s", 1, "x")],
                                     "rule_id string, version_number int, rule_logic string")
    assert {tuple(r) for r in current_versions(versions).collect()} == {("r", 3, "c"), ("s", 1, "x")}
    at = dt.datetime(2024, 1, 1, 10, 0, 0)
    log = spark.createDataFrame(
        [("1", "a", "running", at, None), ("1", "a", "completed", at + dt.timedelta(minutes=5), 10),
         ("1", "b", "running", at, None)],
        "run_id string, assignment_id string, status string, event_time timestamp, records_processed bigint")
    rows = {r.assignment_id: r for r in execution_states(log).collect()}
    assert (rows["a"].status, rows["a"].execution_duration_ms, rows["a"].records_processed) == ("completed", 300000, 10)
    assert (rows["b"].status, rows["b"].execution_duration_ms, rows["b"].end_time) == ("running", None, None)


def assigned(tables, *specs):
    """(rule id, columns, logic, options, table, rule is active, assignment is active)."""
    tables.append_rows("validation_rules", [{
        "rule_id": s[0], "rule_name": s[0], "rule_type": "single_field" if len(s[1]) == 1 else "multi_field",
        "rule_category": "accuracy", "severity_level": "high", "rule_logic": s[2], "created_by": "test",
        "is_active": s[5]} for s in specs])
    tables.append_rows("rule_assignments", [{
        "assignment_id": f"as-{s[0]}", "rule_id": s[0], "source_id": "lake", "schema_name": "public",
        "table_name": s[4], "column_names": list(s[1]), "execution_frequency": "on_demand", "is_active": s[6],
        "priority_order": len(specs) - i, "additional_config": s[3]} for i, s in enumerate(specs)])


def test_executor(spark, tables, users, tmp_path):
    users.write.parquet(str(tmp_path / "data" / "users"))
    spark.createDataFrame([(25, "a"), (30, "b")], "years bigint, w string").write.parquet(str(tmp_path / "data" / "ages"))
    parent = {"parent_table": "ages", "parent_columns": "years", "keys": "age"}
    assigned(
        tables,
        ("email", ["email"], "is_email(col('email'))", None, "users", True, True),
        ("age", ["age"], "range_check(col('age'), 18, 100)", None, "users", True, True),
        ("casts", ["name"], "cast(name as int) > 0", None, "users", True, True),
        ("two", ["age", "name"], "is_null(age)", {"check": "primary_key"}, "users", True, True),
        ("orphan", ["age"], "", {"check": "foreign_key", **parent}, "users", True, True),
        ("cross", ["age", "w"], "age < 30 OR w = 'b'", {"check": "cross_table", **parent}, "users", True, True),
        ("stale", ["age"], "", {"check": "freshness"}, "users", True, True),
        ("strange", ["age"], "", {"check": "colour"}, "users", True, True),
        ("gone", ["x"], "is_null(x)", None, "no_such_table", True, True),
        ("off_rule", ["age"], "age > 1", None, "users", False, True),
        ("off", ["age"], "age > 1", None, "users", True, False),
    )
    executor = RuleExecutor(tables)
    row = executor.execute_assignment("as-email", "run-0")
    assert (row.records_checked, row.records_failed, row.status) == (4, 2, "fail")
    for refused in ("as-off", "as-off_rule", "as-nothing"):
        with pytest.raises(RuleError):
            executor.execute_assignment(refused)
    ids = [f"as-{n}" for n in ("email", "age", "casts", "two", "orphan", "cross", "stale", "strange", "gone", "off")]
    results = executor.execute_batch(ids, "run-1", sample_size=1).collect()
    by_rule = {r.rule_id: r for r in results}
    assert [r.rule_id for r in results] == ["gone", "strange", "stale", "cross", "orphan", "two", "casts", "age", "email"]
    assert (by_rule["age"].records_failed, by_rule["age"].status) == (0, "pass")
    assert (by_rule["two"].status, by_rule["orphan"].records_failed) == ("pass", 2)
    assert (by_rule["cross"].records_checked, by_rule["cross"].records_failed) == (2, 0)
    # A cast that fails on a value, a missing option and a missing table fail alone.
    for name in ("casts", "stale", "strange", "gone"):
        assert by_rule[name].status == "error" and by_rule[name].error_message, name
    stored = tables.read("validation_results").where("run_id = 'run-1'")
    assert stored.count() == 9 and stored.where("execution_duration_ms IS NULL").count() == 0
    states = {r.assignment_id: r.status for r in execution_states(
        tables.read("execution_logs").where("run_id = 'run-1'")).collect()}
    assert states["as-email"] == "completed" and states["as-casts"] == "failed" and "as-off" not in states
    assert executor.load_rules_metadata("as-off").rule_logic == "age > 1"
    lineage = {r.table_name: r.rules_applied for r in tables.read("data_lineage").where("run_id = 'run-1'").collect()}
    assert set(lineage) == {"users", "no_such_table"} and "cross" in lineage["users"]
    violations = spark.read.parquet(tables.path("violations"))
    assert violations.where("run_id = 'run-0' AND rule_id = 'email'").count() == 2
    checked = check_constraints({n: tables.read(n) for n in (
        "data_sources", "validation_rules", "rule_assignments", "validation_results")}, Run())
    failing = {r.rule_id for r in checked.where("records_failed > 0").collect()}
    assert failing == {"source_name_length", "rule_logic_present"} - {"source_name_length"}


def test_stream_of_assigned_rules(spark, tables, users, tmp_path):
    folder = str(tmp_path / "data" / "users")
    users.coalesce(1).write.parquet(folder)
    assigned(tables, ("email", ["email"], "is_email(column)", None, "users", True, True),
             ("age", ["age"], "range_check(column, 18, 30)", None, "users", True, True),
             ("off", ["age"], "age > 1", None, "users", True, False))
    executor = RuleExecutor(tables)
    ids = ["as-email", "as-age", "as-off"]
    assert executor.execute_stream(ids).count() == 2
    users.coalesce(1).write.mode("append").parquet(folder)
    for _ in range(2):
        rows = executor.execute_stream(ids, files_per_batch=1).collect()
        assert sorted((r.batch_id, r.rule_id, r.records_checked, r.records_failed) for r in rows) == [
            (0, "age", 4, 1), (0, "email", 4, 2), (1, "age", 4, 1), (1, "email", 4, 2)]
    with pytest.raises(RuleError):
        executor.execute_stream(["as-off"])


def test_second_set_of_assignments_sees_earlier_files(spark, tables, users, tmp_path):
    users.coalesce(1).write.parquet(str(tmp_path / "data" / "users"))
    assigned(tables, ("email", ["email"], "is_email(column)", None, "users", True, True),
             ("age", ["age"], "range_check(column, 18, 30)", None, "users", True, True))
    executor = RuleExecutor(tables)
    for ids in (["as-email"], ["as-age"], ["as-age", "as-email"], ["as-email", "as-age"]):
        rows = executor.execute_stream(ids).collect()
        assert sorted((r.rule_id, r.records_checked) for r in rows) == sorted((i.removeprefix("as-"), 4) for i in ids)


def test_incremental_batch(spark, tables, tmp_path):
    rows = [(i, dt.datetime(2024, 1, 1 + i)) for i in range(10)]
    spark.createDataFrame(rows, "n int, at timestamp").write.parquet(str(tmp_path / "data" / "log"))
    assigned(tables, ("n", ["n"], "n < 8", None, "log", True, True))
    newer = RuleExecutor(tables).execute_batch(["as-n"], since={"log": ("at", dt.datetime(2024, 1, 6))}).first()
    assert (newer.records_checked, newer.records_failed) == (4, 2)


def test_shared_folder(spark):
    root = spark.conf.get("spark.checkpoint.dir")
    assert shared_folder(spark, "x").startswith(f"{root}/x-")


def test_unknown_table(tables):
    with pytest.raises(MetadataError):
        tables.read("nothing")
    assert tables.read("quality_scores").count() == 0


def test_saved_results_are_completed(spark, tables):
    df = spark.createDataFrame([("r", 4, 1, "fail"), ("s", 0, 0, "pass"), ("t", 0, 0, "error")],
                               "rule_id string, records_checked bigint, records_failed bigint, status string")
    tables.save_results(df)
    rows = {r.rule_id: r for r in tables.read("validation_results").collect()}
    assert (rows["r"].failure_rate, rows["s"].failure_rate, rows["t"].failure_rate) == (25.0, 0.0, None)
    assert all(r.validation_timestamp and r.run_date for r in rows.values())


def test_a_rule_with_two_targets_is_stored_once(spark, tables, tmp_path):
    line = "Email Check,single_field,accuracy,high,is_email(col('email')),admin,Test Source,public,{},email,batch"
    path = write(tmp_path / "r.csv", f"{HEADER},{TARGET}", line.format("users"), line.format("people"), line.format("users"),
                 "Bad,single,accuracy,high,x > 1,admin,Test Source,public,users,x,batch")
    importer = BatchRuleImporter(tables)
    for _ in range(2):  # a file that is imported again adds nothing
        totals = importer.import_from_csv(path)
        assert totals == {"total_rows": 4, "rules_created": 3, "assignments_created": 3, "errors": 1}
        assert tables.read("validation_rules").count() == tables.read("rule_version_history").count() == 1
        assert sorted(r.table_name for r in tables.read("rule_assignments").collect()) == ["people", "users"]
    resolved = resolve_assignments(*(tables.read(n) for n in ("rule_assignments", "validation_rules", "data_sources")))
    assert resolved.count() == 2
    details = importer.details.orderBy("row").collect()
    assert [r.rule_name for r in details] == ["Email Check"] * 3 + ["Bad"]
    assert [r.assignment_id is not None for r in details] == [True, True, True, False]
    assert details[0].assignment_id == details[2].assignment_id != details[1].assignment_id
    assert details[3].rule_id is None and details[3].error == "invalid rule_type: single"


def test_names_of_sources_must_be_unique(tables, tmp_path):
    tables.append_rows("data_sources", [{"source_id": "other", "source_name": "Test Source", "source_type": "s3", "is_active": True}])
    path = write(tmp_path / "r.csv", f"{HEADER},{TARGET}",
                 "Email Check,single_field,accuracy,high,is_email(col('email')),admin,Test Source,public,users,email,batch")
    importer = BatchRuleImporter(tables)
    assert importer.import_from_csv(path) == {"total_rows": 1, "rules_created": 1, "assignments_created": 0, "errors": 1}
    assert importer.details.first().error == "data source name is not unique: Test Source"


def test_the_current_version_of_a_rule_counts(spark, tables, users, tmp_path):
    users.write.parquet(str(tmp_path / "data" / "users"))
    assigned(tables, ("age", ["age"], "age < 0", None, "users", True, True))
    tables.append_rows("validation_rules", [{
        "rule_id": "age", "rule_name": "age", "rule_type": "single_field", "rule_category": "accuracy", "severity_level": "high",
        "rule_logic": "age > 0", "created_by": "test", "is_active": True, "version": 2}])
    rows = RuleExecutor(tables).execute_batch(["as-age"]).collect()
    assert [(r.rule_id, r.records_failed) for r in rows] == [("age", 0)]


def test_stream_results_reach_the_tables_once(spark, tables, users, tmp_path):
    folder = str(tmp_path / "data" / "users")
    users.coalesce(1).write.parquet(folder)
    assigned(tables, ("email", ["email"], "is_email(column)", None, "users", True, True), ("age", ["age"], "range_check(column, 18, 30)", None, "users", True, True))
    executor = RuleExecutor(tables)
    for n in (1, 1, 2):
        if n == 2:
            users.coalesce(1).write.mode("append").parquet(folder)
        executor.execute_stream(["as-email", "as-age"])
        stored = tables.read("validation_results")
        assert stored.count() == 2 * n and stored.select("run_id").distinct().count() == n
        logged = tables.read("execution_logs").where("execution_type = 'streaming' AND status = 'completed'")
        assert logged.count() == 2 * n and {r.records_processed for r in logged.collect()} == {4}
        assert tables.read("data_lineage").count() == n
