"""Rule tables as data: import, constraints, listings, impact. Lines are spelled out of `part`."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from queries.base import query, report, result_sql, run_of, table
from veriframe.plans.analytics import rule_impact
from veriframe.plans.constraints import check_constraints
from veriframe.plans.imports import (
    BatchRuleImporter, import_rules, read_rules_csv, validate_import,
)
from veriframe.plans.metadata import MetadataTables, list_assignments, list_rules, list_sources
from veriframe.session import shared_folder

LINES_SQL = """lines AS (SELECT p_partkey AS row,
 CASE WHEN p_size = 1 THEN NULL ELSE p_name || ' ' || CAST(p_partkey AS VARCHAR) END AS rule_name,
 CASE p_size % 4 WHEN 0 THEN 'single_field' WHEN 1 THEN 'multi_field' WHEN 2 THEN 'cross_table' ELSE
   CASE WHEN p_size % 3 = 0 THEN 'row' ELSE 'single_field' END END AS rule_type,
 CASE WHEN p_type = 'PROMO' THEN 'promo' WHEN p_type = 'SMALL' THEN 'accuracy' ELSE 'custom' END AS rule_category,
 CASE WHEN p_size % 5 = 0 THEN 'high' ELSE 'low' END AS severity_level,
 CASE WHEN p_size = 2 THEN NULL ELSE 'is_not_null(col(''c' || CAST(p_size AS VARCHAR) || '''))' END AS rule_logic,
 'admin' AS created_by,
 CASE WHEN p_size = 3 THEN 'many' WHEN p_size % 2 = 0 THEN '2.5' END AS threshold_value,
 CASE WHEN p_brand = 'Brand#7' THEN NULL ELSE 'source_' || p_brand END AS target_source,
 'public' AS target_schema, lower(p_type) AS target_table,
 CASE WHEN p_size = 4 THEN 'a, ,b' ELSE 'a , b_' || CAST(p_size AS VARCHAR) END AS target_columns,
 CASE WHEN p_size = 6 THEN 'daily' ELSE 'batch' END AS execution_frequency FROM part),
sources AS (SELECT 'src-' || CAST(n_nationkey AS VARCHAR) AS source_id,
 'source_Brand#' || CAST(n_nationkey AS VARCHAR) AS source_name, n_regionkey <> 2 AS is_active FROM nation),
checked AS (SELECT l.*, s.source_id,
 concat_ws('; ',
  CASE WHEN NOT coalesce(length(rule_name) BETWEEN 1 AND 255, false) THEN 'rule_name must have 1 to 255 characters' END,
  CASE WHEN rule_type NOT IN ('single_field', 'multi_field', 'cross_table') THEN 'invalid rule_type: ' || rule_type END,
  CASE WHEN rule_category NOT IN ('accuracy', 'custom') THEN 'invalid rule_category: ' || rule_category END,
  CASE WHEN rule_logic IS NULL THEN 'rule_logic is empty' END,
  CASE WHEN threshold_value = 'many' THEN 'threshold_value is not a number' END) AS rule_error,
 concat_ws('; ',
  CASE WHEN s.source_id IS NULL THEN 'data source not found: ' || coalesce(target_source, '(empty)') END,
  CASE WHEN target_columns = 'a, ,b' THEN 'column names must not be empty' END,
  CASE WHEN execution_frequency = 'daily' THEN 'invalid execution_frequency: daily' END) AS target_error
 FROM lines l LEFT JOIN sources s ON l.target_source = s.source_name)"""


def import_lines(spark, sf_dir):
    size, text = F.col("p_size"), F.col("p_size").cast("string")
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("row"),
        F.when(size != 1, F.concat("p_name", F.lit(" "), F.col("p_partkey").cast("string"))).alias("rule_name"),
        F.when(size % 4 == 0, "single_field").when(size % 4 == 1, "multi_field")
        .when(size % 4 == 2, "cross_table").when(size % 3 == 0, "row").otherwise("single_field").alias("rule_type"),
        F.when(F.col("p_type") == "PROMO", "promo").when(F.col("p_type") == "SMALL", "accuracy")
        .otherwise("custom").alias("rule_category"),
        F.when(size % 5 == 0, "high").otherwise("low").alias("severity_level"),
        F.when(size != 2, F.concat(F.lit("is_not_null(col('c"), text, F.lit("'))"))).alias("rule_logic"),
        F.lit("admin").alias("created_by"),
        F.when(size == 3, "many").when(size % 2 == 0, "2.5").alias("threshold_value"),
        F.when(F.col("p_brand") != "Brand#7", F.concat(F.lit("source_"), "p_brand")).alias("target_source"),
        F.lit("public").alias("target_schema"),
        F.lower("p_type").alias("target_table"),
        F.when(size == 4, "a, ,b").otherwise(F.concat(F.lit("a , b_"), text)).alias("target_columns"),
        F.when(size == 6, "daily").otherwise("batch").alias("execution_frequency"),
    )


def sources(spark, sf_dir):
    key = F.col("n_nationkey").cast("string")
    return table(spark, sf_dir, "nation").select(
        F.concat(F.lit("src-"), key).alias("source_id"),
        F.concat(F.lit("source_Brand#"), key).alias("source_name"),
        (F.col("n_regionkey") != 2).alias("is_active"),
        F.make_date(F.lit(2024), F.lit(1), F.col("n_nationkey") + 1).alias("created_at"),
    )


def outcome(spark, sf_dir):
    return import_rules(import_lines(spark, sf_dir), sources(spark, sf_dir))


@query("rules_import", f"WITH {LINES_SQL} SELECT count(*) AS total_rows, "
       "count(*) FILTER (WHERE rule_error = '') AS rules_created, "
       "count(*) FILTER (WHERE rule_error = '' AND target_error = '') AS assignments_created, "
       "count(*) FILTER (WHERE rule_error <> '' OR target_error <> '') AS errors FROM checked")
def rules_import(spark, sf_dir):
    """Totals of an import."""
    return outcome(spark, sf_dir).summary


@query("rules_file_import", f"WITH {LINES_SQL} SELECT count(*) AS total_rows, "
       "count(*) FILTER (WHERE rule_error = '') AS rules_created, "
       "count(*) FILTER (WHERE rule_error = '' AND target_error = '') AS assignments_created, "
       "count(*) FILTER (WHERE rule_error <> '' OR target_error <> '') AS errors FROM checked")
def rules_file_import(spark, sf_dir):
    """Totals of an import from CSV files into the rule tables."""
    root = shared_folder(spark, "import")
    import_lines(spark, sf_dir).drop("row").write.option("header", True).csv(f"{root}/lines")
    tables = MetadataTables(spark, f"{root}/tables")
    tables.append("data_sources", sources(spark, sf_dir))
    importer = BatchRuleImporter(tables)
    importer.import_from_csv(f"{root}/lines")
    made = import_rules(read_rules_csv(spark, f"{root}/lines"), tables.read("data_sources"))
    stored = [tables.read("validation_rules"), tables.read("rule_assignments"), made.errors]
    names = ["rules_created", "assignments_created", "errors"]
    counts = [
        df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
        for name, df in zip([*names, "total_rows"], [*stored, made.checked], strict=True)
    ]
    together = reduce(lambda a, b: a.unionByName(b), counts)
    return together.agg(*[F.max(F.when(F.col("name") == n, F.col("n"))).alias(n)
                          for n in ["total_rows", *names]])


@query("rules_import_errors", f"WITH {LINES_SQL} SELECT row, CASE WHEN rule_error <> '' THEN rule_error "
       "ELSE target_error END AS error FROM checked WHERE rule_error <> '' OR target_error <> ''")
def rules_import_errors(spark, sf_dir):
    """Every rejected line with its reasons."""
    return outcome(spark, sf_dir).errors


@query("rules_import_rules", f"WITH {LINES_SQL} SELECT rule_name, rule_type, rule_category, "
       "severity_level, rule_logic, TRY_CAST(threshold_value AS DOUBLE) AS threshold_value, created_by, "
       "1 AS version_number, 'Initial version' AS change_reason FROM checked WHERE rule_error = ''")
def rules_import_rules(spark, sf_dir):
    """Imported rules next to their first version."""
    made = outcome(spark, sf_dir)
    first = made.versions.select("rule_id", "version_number", "change_reason")
    return made.rules.join(first, "rule_id").select(
        "rule_name", "rule_type", "rule_category", "severity_level", "rule_logic", "threshold_value",
        "created_by", "version_number", "change_reason")


@query("rules_import_assignments", f"WITH {LINES_SQL} SELECT rule_name, source_id, target_schema AS "
       "schema_name, target_table AS table_name, 'a|' || trim(split_part(target_columns, ',', 2)) AS column_names, "
       "execution_frequency FROM checked WHERE rule_error = '' AND target_error = ''")
def rules_import_assignments(spark, sf_dir):
    """Imported assignments with the names of their rules."""
    made = outcome(spark, sf_dir)
    return made.assignments.join(made.rules.select("rule_id", "rule_name"), "rule_id").select(
        "rule_name", "source_id", "schema_name", "table_name",
        F.concat_ws("|", "column_names").alias("column_names"), "execution_frequency")


@query("import_file_check", f"WITH {LINES_SQL} SELECT false AS valid, count(*) AS total_rows, "
       "'severity_level' AS missing_columns, count(*) FILTER (WHERE rule_name IS NULL) AS empty_rows FROM lines")
def import_file_check(spark, sf_dir):
    """What an import file lacks."""
    checked = validate_import(import_lines(spark, sf_dir).drop("severity_level"))
    return checked.select(
        "valid", "total_rows", F.concat_ws(",", "missing_columns").alias("missing_columns"), "empty_rows")


def constraint_sql(rule_id, table_name, source, predicate):
    return (f"SELECT '{rule_id}' AS rule_id, '{table_name}' AS t, 'integrity' AS rule_category, 'high' AS "
            f"severity_level, CAST(NULL AS DOUBLE) AS threshold_value, count(*) AS checked, "
            f"count(*) FILTER (WHERE NOT coalesce(({predicate}), false)) AS failed FROM {source}")


def key_sql(rule_id, table_name, checked, failed):
    return (f"SELECT '{rule_id}', '{table_name}', 'integrity', 'critical', CAST(NULL AS DOUBLE), "
            f"({checked}), ({failed})")


CONSTRAINTS = "\nUNION ALL ".join([
    constraint_sql("rule_name_length", "validation_rules", "lines", "length(rule_name) BETWEEN 1 AND 255"),
    constraint_sql("rule_type_known", "validation_rules", "lines", "rule_type IN ('single_field', 'multi_field', 'cross_table')"),
    constraint_sql("rule_category_known", "validation_rules", "lines",
                   "rule_category IN ('completeness', 'accuracy', 'consistency', 'integrity', 'timeliness', 'custom')"),
    constraint_sql("severity_level_known", "validation_rules", "lines", "severity_level IN ('critical', 'high', 'medium', 'low')"),
    constraint_sql("rule_logic_present", "validation_rules", "lines", "length(rule_logic) >= 1"),
    constraint_sql("created_by_present", "validation_rules", "lines", "length(created_by) >= 1"),
    constraint_sql("schema_name_length", "rule_assignments", "lines", "length(target_schema) BETWEEN 1 AND 255"),
    constraint_sql("table_name_length", "rule_assignments", "lines", "length(target_table) BETWEEN 1 AND 255"),
    constraint_sql("column_names_filled", "rule_assignments", "lines", "target_columns <> 'a, ,b'"),
    constraint_sql("execution_frequency_known", "rule_assignments", "lines", "execution_frequency <> 'daily'"),
    key_sql("rule_assignments_unique", "rule_assignments", "SELECT count(*) FROM lines",
            "SELECT coalesce(sum(n), 0) FROM (SELECT count(*) AS n FROM lines WHERE rule_name IS NOT NULL AND "
            "target_source IS NOT NULL GROUP BY rule_name, target_source, target_schema, target_table, "
            "target_columns HAVING count(*) > 1)"),
    key_sql("rule_assignments_rule_id_known", "rule_assignments", "SELECT count(*) FROM lines", "0"),
    key_sql("rule_assignments_source_id_known", "rule_assignments", "SELECT count(*) FROM lines",
            "SELECT count(*) FROM lines WHERE target_source IS NOT NULL AND target_source NOT IN (SELECT source_name FROM sources)"),
])


@query("metadata_constraints", f"WITH {LINES_SQL}, results AS ("
       + result_sql(CONSTRAINTS, "x", "t, ") + ") SELECT * EXCLUDE (t) REPLACE (t AS table_name) FROM results")
def metadata_constraints(spark, sf_dir):
    """Constraints of the rule tables, on rule tables with faults in them."""
    lines = import_lines(spark, sf_dir)
    rules = lines.withColumn("rule_id", F.col("rule_name"))
    assignments = lines.select(
        F.col("rule_name").alias("rule_id"), F.col("target_source").alias("source_id"),
        F.col("target_schema").alias("schema_name"), F.col("target_table").alias("table_name"),
        F.transform(F.split("target_columns", ","), lambda c: F.trim(c)).alias("column_names"), "execution_frequency")
    known = sources(spark, sf_dir).select(F.col("source_name").alias("source_id"))
    results = check_constraints(
        {"validation_rules": rules, "rule_assignments": assignments}, run_of("rules"))
    keyed = check_constraints({"rule_assignments": assignments, "data_sources": known.withColumns(
        {"source_name": F.col("source_id"), "source_type": F.lit("s3")})}, run_of("rules"))
    wanted = keyed.where("rule_id = 'rule_assignments_source_id_known'")
    return report(results.unionByName(wanted))


SCORES = ("completeness", "accuracy", "consistency", "integrity", "timeliness")
SCORE_SQL = {"overall_score": "o_totalprice / 4000", "completeness_score": "o_custkey % 120", "accuracy_score": "CASE WHEN o_orderkey % 3 = 0 THEN 101 END",
             "consistency_score": "-(o_orderkey % 2)", "integrity_score": "o_orderkey % 101", "timeliness_score": "CAST(NULL AS DOUBLE)"}


def _unique_sql(table_name, source, columns):
    complete = " AND ".join(f"{c} IS NOT NULL" for c in columns)
    return key_sql(f"{table_name}_unique", table_name, f"SELECT count(*) FROM {source}",
                   f"SELECT coalesce(sum(n), 0) FROM (SELECT count(*) AS n FROM {source} WHERE {complete} GROUP BY {', '.join(columns)} HAVING count(*) > 1)")


@query("metadata_unique_keys", "WITH results AS (" + result_sql("\nUNION ALL ".join([
    constraint_sql("source_name_length", "data_sources", "part", "length(p_brand) BETWEEN 1 AND 255"),
    constraint_sql("source_type_known", "data_sources", "part", "p_size % 2 = 0"),
    _unique_sql("data_sources", "part", ["p_brand"]),
    _unique_sql("rule_version_history", "lineitem", ["l_orderkey", "l_linenumber"]),
    constraint_sql("overall_score_in_range", "quality_scores", "orders", f"{SCORE_SQL['overall_score']} BETWEEN 0 AND 100"),
    *[constraint_sql(f"{c}_score_in_range", "quality_scores", "orders", f"coalesce({SCORE_SQL[c + '_score']} BETWEEN 0 AND 100, true)") for c in SCORES],
    _unique_sql("quality_scores", "orders", ["o_orderstatus", "CAST(o_orderdate AS DATE)"]),
]), "x", "t, ") + ") SELECT * EXCLUDE (t) REPLACE (t AS table_name) FROM results")
def metadata_unique_keys(spark, sf_dir):
    """The unique keys of sources, versions and scores, with the other constraints of these tables."""
    sources_ = table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("source_name"), F.when(F.col("p_size") % 2 == 0, "s3").otherwise("floppy").alias("source_type"))
    versions = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("rule_id"), F.col("l_linenumber").alias("version_number"))
    scores = table(spark, sf_dir, "orders").select(
        F.col("o_orderstatus").alias("table_name"), F.to_date("o_orderdate").alias("score_date"),
        *[F.expr(text).cast("double").alias(name) for name, text in SCORE_SQL.items()])
    return report(check_constraints(
        {"data_sources": sources_, "rule_version_history": versions, "quality_scores": scores}, run_of("rules")))


@query("list_rules", f"WITH {LINES_SQL} SELECT rule_name, rule_type, rule_category FROM lines "
       "WHERE rule_type = 'single_field' AND rule_category = 'accuracy' AND row % 2 = 0")
def list_rules_query(spark, sf_dir):
    """Active rules of a type and category."""
    rules = import_lines(spark, sf_dir).withColumns(
        {"is_active": F.col("row") % 2 == 0, "created_at": F.col("row")})
    found = list_rules(rules, "single_field", "accuracy", True)
    return found.select("rule_name", "rule_type", "rule_category")


@query("list_assignments", f"WITH {LINES_SQL} SELECT row, target_table AS table_name, CAST(row % 7 AS BIGINT) "
       "AS priority_order FROM lines WHERE target_source = 'source_Brand#3' AND row % 2 = 0")
def list_assignments_query(spark, sf_dir):
    """Active assignments of a source, in the order they are applied."""
    assignments = import_lines(spark, sf_dir).select(
        "row", F.col("target_source").alias("source_id"), F.col("target_table").alias("table_name"),
        (F.col("row") % 2 == 0).alias("is_active"), (F.col("row") % 7).alias("priority_order"),
        F.col("row").alias("created_at"))
    found = list_assignments(assignments, source_id="source_Brand#3", is_active=True)
    return found.select("row", "table_name", "priority_order")


@query("list_sources", "SELECT 'source_Brand#' || CAST(n_nationkey AS VARCHAR) AS source_name, count(p_partkey) "
       "AS assignment_count FROM nation LEFT JOIN part ON p_brand = 'Brand#' || CAST(n_nationkey AS VARCHAR) "
       "WHERE n_regionkey <> 2 GROUP BY ALL")
def list_sources_query(spark, sf_dir):
    """Active sources with the number of lines that name them."""
    named = import_lines(spark, sf_dir).groupBy(F.col("target_source").alias("source_name")).agg(
        F.count(F.lit(1)).alias("assignment_count"))
    active = list_sources(sources(spark, sf_dir), True)
    brand7 = table(spark, sf_dir, "part").where("p_brand = 'Brand#7'").select(
        F.lit("source_Brand#7").alias("source_name")).groupBy("source_name").agg(
        F.count(F.lit(1)).alias("assignment_count"))
    counts = named.where("source_name IS NOT NULL").unionByName(brand7)
    return active.join(counts, "source_name", "left").select(
        "source_name", F.coalesce("assignment_count", F.lit(0)).alias("assignment_count"))


@query("rule_impact", f"WITH {LINES_SQL}, touched AS (SELECT DISTINCT severity_level || p AS rule_id, target_source, "
       "target_table, trim(c) AS c FROM (SELECT *, CAST(row % 10 AS VARCHAR) AS p, "
       "unnest(string_split(target_columns, ',')) AS c FROM lines)) "
       "SELECT rule_id, count(DISTINCT (coalesce(target_source, ''), target_table)) AS tables, "
       "count(*) AS columns FROM touched GROUP BY rule_id")
def rule_impact_query(spark, sf_dir):
    """Tables and columns each rule touches."""
    assignments = import_lines(spark, sf_dir).select(
        F.concat("severity_level", (F.col("row") % 10).cast("string")).alias("rule_id"),
        F.col("target_source").alias("source_id"), F.col("target_schema").alias("schema_name"),
        F.col("target_table").alias("table_name"),
        F.transform(F.split("target_columns", ","), lambda c: F.trim(c)).alias("column_names"))
    return rule_impact(assignments)
