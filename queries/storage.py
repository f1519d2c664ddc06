"""Reading and writing: views of sources, formats there and back, stored results and violations."""

from __future__ import annotations

import datetime as dt
import uuid
from functools import reduce

from pyspark.sql import functions as F

from queries.base import (
    RUN_AT, counts_sql, literal, query, report, result_sql, rules_from, run_of, scorecard_sql, table,
)
from queries.result_queries import HISTORY_RULES, WITH_HISTORY, history
from queries.row_rules import LINEITEM_RULES
from queries.table_rules import CROSS, SAMPLED, foreign_key_sql, unique_sql
from veriframe.operators.key_store import KeyStore
from veriframe.operators.freshness import last_value, rows_of_partitions, rows_since
from veriframe.operators.results import error_class
from veriframe.operators.row_checks import check_rows
from veriframe.operators.samples import sample_violations, split_rows
from veriframe.plans.analytics import find_results
from veriframe.plans.executor import RuleExecutor
from veriframe.plans.incremental import FileRuns
from veriframe.plans.metadata import MetadataTables
from veriframe.plans.rules import Rule
from veriframe.session import shared_folder
from veriframe.sources.connectors import create_source

ORDER_TYPES = ("o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
               "o_orderdate timestamp_ntz, o_orderpriority string")


def files(spark, root, **config):
    return create_source("s3", {"root": root, **config}, spark)


@query("source_view", """SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders
WHERE o_orderstatus = 'O' AND o_orderpriority IN ('1-URGENT', '2-HIGH')
 AND o_totalprice >= 1000 AND o_totalprice < 400000 AND o_orderkey > 10 AND o_orderkey <= 1000000""")
def source_view(spark, sf_dir):
    """Filters by value, list and range on columns that are partly not selected."""
    return files(spark, sf_dir).read_data(
        table="orders.parquet",
        filters={
            "o_orderstatus": "O", "o_orderpriority": ["1-URGENT", "2-HIGH"],
            "o_totalprice": {"gte": 1000, "lt": 400000}, "o_orderkey": {"gt": 10, "lte": 1000000},
        },
        columns=["o_orderkey", "o_totalprice", "o_orderpriority"],
    )


def _there_and_back(spark, sf_dir, fmt):
    source = files(spark, shared_folder(spark, fmt), format=fmt, table_schema=ORDER_TYPES)
    source.write_results(table(spark, sf_dir, "orders"), "/orders")
    df = source.read_data(table="orders")
    return report(check_rows(df, rules_from(HISTORY_RULES), run_of("orders")))


@query("csv_there_and_back", scorecard_sql("orders", HISTORY_RULES))
def csv_there_and_back(spark, sf_dir):
    """Orders written as CSV with a header, read with a declared schema, and checked."""
    return _there_and_back(spark, sf_dir, "csv")


@query("json_there_and_back", scorecard_sql("orders", HISTORY_RULES))
def json_there_and_back(spark, sf_dir):
    """Orders written as JSON lines, read with a declared schema, and checked."""
    return _there_and_back(spark, sf_dir, "json")


@query("csv_inferred", scorecard_sql("orders", HISTORY_RULES))
def csv_inferred(spark, sf_dir):
    """Orders written as CSV and read with inferred types."""
    source = files(spark, shared_folder(spark, "csv-inferred"), format="csv")
    source.write_results(table(spark, sf_dir, "orders"), "orders")
    return report(check_rows(source.read_data(table="orders"), rules_from(HISTORY_RULES), run_of("orders")))


@query("partition_scoped", result_sql(
    "\nUNION ALL ".join(counts_sql("orders", s, "o_orderpriority, ",
                                   "WHERE o_orderstatus IN ('F', 'P') GROUP BY o_orderpriority")
                        for s in HISTORY_RULES), "orders", "o_orderpriority, "))
def partition_scoped(spark, sf_dir):
    """Two partitions of a partitioned table, with results per group."""
    source = files(spark, shared_folder(spark, "partitioned"))
    source.write_results(table(spark, sf_dir, "orders"), "orders", partition_by=["o_orderstatus"])
    df = rows_of_partitions(source.read_data(table="orders"), "o_orderstatus", ["F", "P"])
    results = check_rows(df, rules_from(HISTORY_RULES), run_of("orders"), by=["o_orderpriority"])
    return report(results, "o_orderpriority")


@query("catalog_there_and_back", scorecard_sql("(SELECT * FROM orders WHERE o_orderstatus <> 'P') AS orders",
                                               HISTORY_RULES, "orders"))
def catalog_there_and_back(spark, sf_dir):
    """Orders saved as a catalog table, read by name and by query."""
    name = f"orders_{uuid.uuid4().hex[:12]}"
    source = create_source("databricks", {
        "server_hostname": "local", "http_path": "/", "access_token": "none",
        "catalog": "spark_catalog", "schema": "default", "path": shared_folder(spark, "catalog"),
    }, spark)
    source.write_results(table(spark, sf_dir, "orders"), name, partition_by=["o_orderstatus"])
    part = source.read_data(table=name, filters={"o_orderstatus": "F"})
    rest = source.read_data(query=f"SELECT * FROM {source.name(name)} WHERE o_orderstatus = 'O'")
    both = part.unionByName(rest)
    return report(check_rows(both, rules_from(HISTORY_RULES), run_of("orders")))


@query("incremental_rows", scorecard_sql(
    "(SELECT * FROM orders WHERE o_orderdate > (SELECT max(o_orderdate) FROM orders WHERE "
    "o_orderdate < TIMESTAMP '2000-01-01 00:00:00')) AS orders", HISTORY_RULES, "orders"))
def incremental_rows(spark, sf_dir):
    """Only rows newer than the newest one an earlier run has seen."""
    orders = table(spark, sf_dir, "orders")
    seen = orders.where("o_orderdate < timestamp_ntz'2000-01-01 00:00:00'")
    since = last_value(seen, "o_orderdate")
    new = rows_since(orders, "o_orderdate", since)
    return report(check_rows(new, rules_from(HISTORY_RULES), run_of("orders")))


@query("stored_results", WITH_HISTORY + "SELECT rule_id, run_id, records_failed, status, run_date FROM history "
       "WHERE status = 'fail' AND run_date >= DATE '2001-01-01'")
def stored_results(spark, sf_dir):
    """A history appended to the results table and read for a range of dates."""
    tables = MetadataTables(spark, shared_folder(spark, "results"))
    by_day = history(spark, sf_dir).withColumn("run_date", F.date_trunc("year", "run_date").cast("date"))
    tables.append("validation_results", by_day)
    found = find_results(tables.read("validation_results"), status="fail",
                         since=dt.date(2001, 1, 1), limit=None)
    return found.select("rule_id", "run_id", "records_failed", "status",
                        F.col("validation_timestamp").cast("date").alias("run_date"))


@query("stored_violations", "SELECT rule_id, count(*) AS row_count, CAST(sum(l_orderkey) AS BIGINT) AS key_sum FROM ("
       + "\nUNION ALL ".join(
           f"SELECT '{s[0]}' AS rule_id, l_orderkey FROM lineitem WHERE NOT coalesce(({s[6]}), false)"
           for s in SAMPLED) + ") GROUP BY rule_id")
def stored_violations(spark, sf_dir):
    """All violating rows written per date and rule, twice; the second run replaces the first."""
    path = f"{shared_folder(spark, 'violations')}/violations"
    _, bad = split_rows(table(spark, sf_dir, "lineitem"), rules_from(SAMPLED))
    rows = bad.withColumn("rule_id", F.explode("violated")).drop("violated").withColumn(
        "run_date", F.lit(RUN_AT.date()))
    for _ in range(2):
        rows.write.mode("overwrite").partitionBy("run_date", "rule_id").parquet(path)
    return spark.read.parquet(path).groupBy("rule_id").agg(
        F.count(F.lit(1)).alias("row_count"), F.sum("l_orderkey").alias("key_sum"))


EXECUTED = [s for s in LINEITEM_RULES if s[0] in ("li_discount_range", "li_sql_between", "li_price_above_qty")]
EXECUTED_SQL = "\nUNION ALL ".join(f"({s})" for s in [
    scorecard_sql("lineitem", EXECUTED),
    unique_sql("li_key", "lineitem", ["l_orderkey", "l_linenumber"], "lineitem", 10.0),
    foreign_key_sql("li_order", "lineitem", "l_orderkey", "orders", "o_orderkey"),
    scorecard_sql("lineitem JOIN orders ON l_orderkey = o_orderkey", CROSS[:2], "lineitem"),
    scorecard_sql("orders", HISTORY_RULES[:2]),
])


def error_sql(rule_id: str, category: str, severity: str, error: str, table_name: str, threshold=None) -> str:
    """The row of a rule that cannot be evaluated."""
    return f"""SELECT '{rule_id}' AS rule_id, '{table_name}' AS table_name, '{category}' AS rule_category, '{severity}' AS severity_level,
  0::BIGINT AS records_checked, 0::BIGINT AS records_failed, 0::BIGINT AS records_passed, NULL::DOUBLE AS failure_rate,
  {literal(threshold)} AS threshold_value, NULL::BOOLEAN AS threshold_passed, 'error' AS status, '{error}' AS error_class"""


# A function that is not there, and a cast that fails on a value while the scan runs.
BROKEN = [
    ("li_broken", ["l_tax"], "accuracy", "high", None, "no_such_function(col('l_tax'))", "UNRESOLVED_ROUTINE"),
    ("li_cast", ["l_returnflag"], "accuracy", "low", 5.0, "cast(column as int) > 0", "CAST_INVALID_INPUT"),
]
BROKEN_SQL = "\nUNION ALL ".join(error_sql(s[0], s[2], s[3], s[6], "lineitem", s[4]) for s in BROKEN)


def stored_rules(spark, name, sf_dir, specs):
    """Rule tables with one source and (rule, table, config[, assignment, columns]) assigned in this order."""
    tables = MetadataTables(spark, shared_folder(spark, name))
    tables.append_rows("data_sources", [{
        "source_id": "lake", "source_name": "Lake", "source_type": "s3",
        "connection_config": {"root": sf_dir}, "is_active": True, "created_at": RUN_AT}])
    rules = {s[0]: s for s, *_ in specs}
    tables.append_rows("validation_rules", [{
        "rule_id": s[0], "rule_name": s[0], "rule_type": "single_field" if len(s[1]) == 1 else "multi_field",
        "rule_category": s[2], "severity_level": s[3], "threshold_value": s[4], "rule_logic": s[5],
        "created_by": "admin", "version": 1, "is_active": True, "created_at": RUN_AT} for s in rules.values()])
    tables.append_rows("rule_assignments", [{
        "assignment_id": more[0] if more else f"as-{s[0]}", "rule_id": s[0], "source_id": "lake", "table_name": f"{t}.parquet",
        "schema_name": "files", "column_names": list(more[1] if more else s[1]), "execution_frequency": "batch", "is_active": True,
        "priority_order": i, "created_at": RUN_AT, "additional_config": config}
        for i, (s, t, config, *more) in enumerate(specs)])
    return tables


@query("executor_batch", f"SELECT * REPLACE (table_name || '.parquet' AS table_name) FROM ("
       f"SELECT *, NULL::VARCHAR AS error_class FROM ({EXECUTED_SQL}) UNION ALL {BROKEN_SQL})")
def executor_batch(spark, sf_dir):
    """Assigned rules of two tables, run from the rule tables; two of them cannot be evaluated."""
    link = {"parent_table": "orders.parquet", "parent_columns": "o_orderkey", "keys": "l_orderkey"}
    specs = [(s, "lineitem", {}) for s in EXECUTED]
    specs += [
        (("li_key", ["l_orderkey", "l_linenumber"], "integrity", "high", 10.0, "unique"), "lineitem", {"check": "unique"}),
        (("li_order", ["l_orderkey"], "integrity", "high", None, "foreign key"), "lineitem", {"check": "foreign_key", **link}),
    ]
    specs += [(s, "lineitem", {}) for s in BROKEN]
    specs += [(s, "lineitem", {"check": "cross_table", **link}) for s in CROSS[:2]]
    specs += [(s, "orders", {}) for s in HISTORY_RULES[:2]]
    tables = stored_rules(spark, "rules", sf_dir, specs)
    results = RuleExecutor(tables).execute_batch([f"as-{s[0]}" for s, *_ in specs], sample_size=5)
    return report(results.withColumn("error_class", error_class()), "error_class")


BAD_RULES = [
    ("bad_syntax", ["o_totalprice"], "accuracy", "high", None, "column >> > 1", "PARSE_SYNTAX_ERROR"),
    ("bad_column", ["nowhere"], "accuracy", "medium", 1.0, "nowhere > 1", "UNRESOLVED_COLUMN.WITH_SUGGESTION"),
    ("bad_function", ["o_totalprice"], "custom", "low", None, "no_such_function(column)", "UNRESOLVED_ROUTINE"),
    ("bad_type", ["o_totalprice"], "custom", "low", None, "column + 1", "RULE"),
    ("bad_value", ["o_orderpriority"], "accuracy", "low", None, "cast(column as int) > 0", "CAST_INVALID_INPUT"),
    ("bad_zero", ["o_custkey"], "accuracy", "critical", 2.0, "column / (column - column) > 0", "DIVIDE_BY_ZERO"),
    ("bad_lambda", ["o_custkey"], "custom", "medium", None, "lambda x: x > 0", "RULE"),
]


@query("bad_rules", "SELECT *, NULL::VARCHAR AS error_class FROM (" + scorecard_sql("orders", HISTORY_RULES) + ")\nUNION ALL "
       + "\nUNION ALL ".join(error_sql(s[0], s[2], s[3], s[6], "orders", s[4]) for s in BAD_RULES))
def bad_rules(spark, sf_dir):
    """Rules that cannot be parsed, resolved, typed or evaluated are rows with the class of their error; the others count."""
    specs = [(s, "orders", {}) for s in [*BAD_RULES, *HISTORY_RULES]]
    tables = stored_rules(spark, "bad-rules", sf_dir, specs)
    results = RuleExecutor(tables).execute_batch([f"as-{s[0]}" for s, *_ in specs], sample_size=0)
    named = results.withColumn("error_class", error_class()).withColumn("table_name", F.lit("orders"))
    return report(named, "error_class")


# One rule on two columns, with a sample of its own for each.
SHARED = [("shared_range", ["l_discount"], "accuracy", "high", 5.0, "column BETWEEN 0.01 AND 0.07", c)
          for c in ("l_discount", "l_tax")]
SHARED_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"]
SHARED_N = 50


@query("sample_shared_rule", f"""SELECT column_name, rank, l_orderkey AS k_orderkey, l_linenumber AS k_linenumber, value FROM ("""
       + "\nUNION ALL ".join(
           f"""SELECT '{c}' AS column_name, CAST(row_number() OVER (ORDER BY {', '.join(SHARED_KEY)}) AS INT) AS rank, l_orderkey, l_linenumber,
  CAST({c} AS DOUBLE) AS value FROM lineitem WHERE NOT coalesce({c} BETWEEN 0.01 AND 0.07, false)""" for *_, c in SHARED)
       + f") WHERE rank <= {SHARED_N}")
def sample_shared_rule(spark, sf_dir):
    """One rule assigned to two columns: the first failing rows of each, with the value that failed."""
    rules = [Rule(s[0], s[5], (s[6],), rule_category=s[2], severity_level=s[3]) for s in SHARED]
    found = sample_violations(table(spark, sf_dir, "lineitem"), rules, SHARED_KEY, SHARED_N, run=run_of("lineitem"))
    keys = found.withColumn("k", F.from_json("record_key", "l_orderkey bigint, l_linenumber int"))
    column = F.element_at("column_names", 1)
    value = F.element_at(F.from_json("record", "map<string,double>"), column)
    return keys.select(column.alias("column_name"), "rank", F.col("k.l_orderkey").alias("k_orderkey"),
                       F.col("k.l_linenumber").alias("k_linenumber"), value.alias("value"))


SAMPLED_PARTS = ["F", "O"]


@query("executor_samples", "\nUNION ALL ".join(
    f"""SELECT 'lake-{s}' AS source_id, 'as-{s}-{c}' AS assignment_id, '{c}' AS column_name, count(*) AS sampled, sum(key)::BIGINT AS key_sum
FROM (SELECT o_orderkey AS key FROM orders WHERE o_orderstatus = '{s}' AND NOT coalesce({c} % 3 <> 0, false) ORDER BY o_custkey, o_orderkey LIMIT 20)
HAVING count(*) > 0""" for s in SAMPLED_PARTS for c in ("o_orderkey", "o_custkey")))
def executor_samples(spark, sf_dir):
    """Stored samples of one rule on two columns of equally named tables in two sources."""
    root = shared_folder(spark, "two-sources")
    tables = MetadataTables(spark, f"{root}/rules")
    for part in SAMPLED_PARTS:
        table(spark, sf_dir, "orders").where(F.col("o_orderstatus") == part).select("o_orderkey", "o_custkey").write.parquet(f"{root}/{part}/orders")
    tables.append_rows("data_sources", [{
        "source_id": f"lake-{p}", "source_name": f"Lake {p}", "source_type": "s3", "connection_config": {"root": f"{root}/{p}"},
        "is_active": True, "created_at": RUN_AT} for p in SAMPLED_PARTS])
    tables.append_rows("validation_rules", [{
        "rule_id": "not_by_three", "rule_name": "not by three", "rule_type": "multi_field", "rule_category": "custom", "severity_level": "low",
        "rule_logic": "column % 3 <> 0", "created_by": "admin", "version": 1, "is_active": True, "created_at": RUN_AT}])
    tables.append_rows("rule_assignments", [{
        "assignment_id": f"as-{p}-{c}", "rule_id": "not_by_three", "source_id": f"lake-{p}", "table_name": "orders", "schema_name": "files",
        "column_names": [c, *(x for x in ("o_orderkey", "o_custkey") if x != c)], "execution_frequency": "batch", "is_active": True,
        "priority_order": 1, "created_at": RUN_AT} for p in SAMPLED_PARTS for c in ("o_orderkey", "o_custkey")])
    ids = [f"as-{p}-{c}" for p in SAMPLED_PARTS for c in ("o_orderkey", "o_custkey")]
    RuleExecutor(tables).execute_batch(ids, "run-1", sample_size=20)
    rows = spark.read.parquet(tables.path("violations"))
    key = F.get_json_object("record_key", "$.o_orderkey").cast("bigint")
    return rows.groupBy("source_id", "assignment_id", F.element_at("column_names", 1).alias("column_name")).agg(
        F.count(F.lit(1)).alias("sampled"), F.sum(key).alias("key_sum"))


# A rule of the first run, one that comes with the second, and the first one changed in the third.
FILE_RULES = [
    ("as-price", ["o_totalprice"], "accuracy", "high", 40.0, "column > 150000", "o_totalprice > 150000"),
    ("as-price-cut", ["o_totalprice"], "accuracy", "high", 40.0, "column > 200000", "o_totalprice > 200000"),
    ("as-status", ["o_orderstatus"], "accuracy", "low", None, "column <> 'P'", "o_orderstatus <> 'P'"),
]
FILE_RUNS = [("run-1", "orders WHERE o_orderkey % 4 < 2", [0], 2), ("run-2", "orders WHERE o_orderkey % 4 < 3", [0, 2], 6),
             ("run-3", "orders", [1, 2], 11), ("run-4", "orders WHERE o_orderkey % 4 > 0", [1, 2], 11)]


@query("incremental_files", "\nUNION ALL ".join(
    f"SELECT '{run}' AS run_id, {counted}::BIGINT AS counted_files, * FROM ("
    + scorecard_sql(f"(SELECT * FROM {source}) AS t", [("price" if i < 2 else "status", *FILE_RULES[i][1:]) for i in rules], "orders") + ")"
    for run, source, rules, counted in FILE_RUNS))
def incremental_files(spark, sf_dir):
    """Files that arrive between runs, a rule that is new, one that has changed, and a file that goes; nothing is counted twice."""
    root = shared_folder(spark, "incremental")
    tables = MetadataTables(spark, f"{root}/rules")
    orders = table(spark, sf_dir, "orders")
    tables.append_rows("data_sources", [{
        "source_id": "lake", "source_name": "Lake", "source_type": "s3", "connection_config": {"root": f"{root}/data"},
        "is_active": True, "created_at": RUN_AT}])

    def arrive(*parts):
        for part in parts:
            orders.where(F.col("o_orderkey") % 4 == part).coalesce(1).write.mode("overwrite").parquet(f"{root}/data/orders/part={part}")

    def rule_tables(rules):
        """The rules as they are at the time of a run: rule tables are appended to, so a changed rule has tables of its own."""
        now = MetadataTables(spark, shared_folder(spark, "rules-now"))
        now.append("data_sources", tables.read("data_sources"))
        now.append("file_counts", tables.read("file_counts"))
        now.append_rows("validation_rules", [{
            "rule_id": name, "rule_name": name, "rule_type": "single_field", "rule_category": s[2], "severity_level": s[3],
            "threshold_value": s[4], "rule_logic": s[5], "created_by": "admin", "version": 1, "is_active": True, "created_at": RUN_AT}
            for name, s in rules])
        now.append_rows("rule_assignments", [{
            "assignment_id": f"as-{name}", "rule_id": name, "source_id": "lake", "table_name": "orders", "column_names": list(s[1]),
            "execution_frequency": "batch", "is_active": True, "priority_order": 1, "created_at": RUN_AT} for name, s in rules])
        return now

    frames = []
    arriving = [(0, 1), (2,), (3,), ()]
    for (run, _, chosen, _), parts in zip(FILE_RUNS, arriving):
        arrive(*parts)
        if run == "run-4":  # a file is replaced by one without rows
            orders.where("false").coalesce(1).write.mode("overwrite").parquet(f"{root}/data/orders/part=0")
        tables = rule_tables([("price" if i < 2 else "status", FILE_RULES[i]) for i in chosen])
        results = FileRuns(RuleExecutor(tables)).execute([f"as-{'price' if i < 2 else 'status'}" for i in chosen], run)
        counted = tables.read("file_counts").where("records_checked > 0").count()
        frames.append(report(results.withColumn("counted_files", F.lit(counted).cast("bigint")), "run_id", "counted_files"))
    return reduce(lambda a, b: a.unionByName(b), frames)


UNIQUE_PARTS = 3


@query("unique_incremental", "SELECT *, NULL::BIGINT AS repeated_keys FROM (" + unique_sql("cust_once", "orders", ["o_custkey"], "orders", 60.0) + f""")
UNION ALL SELECT 'cust_once_batch', 'orders', 'integrity', 'high', count(*)::BIGINT, coalesce(sum(c), 0)::BIGINT, coalesce(sum(before), 0)::BIGINT, NULL::DOUBLE, NULL::DOUBLE,
  NULL::BOOLEAN, 'pass', count(*) FILTER (WHERE before > 0) FROM (
  SELECT o_custkey, count(*) FILTER (WHERE o_orderkey % {UNIQUE_PARTS} = 2) AS c, count(*) FILTER (WHERE o_orderkey % {UNIQUE_PARTS} <> 2) AS before
  FROM orders GROUP BY o_custkey HAVING c > 0 AND c + before > 1)""")
def unique_incremental(spark, sf_dir):
    """Customers with one order only, after three batches; and which keys the last batch has made repeat."""
    store = KeyStore(spark, f"keys_{uuid.uuid4().hex[:12]}", ["o_custkey"], 16, shared_folder(spark, "keys"))
    orders = table(spark, sf_dir, "orders")
    for part in (0, 1, 2, 1):  # a batch that comes again replaces itself
        store.add(orders.where(F.col("o_orderkey") % UNIQUE_PARTS == part), f"part-{part}")
    rule = Rule("cust_once", columns=("o_custkey",), rule_category="integrity", severity_level="high", threshold_value=60.0)
    whole = report(store.check(rule, run_of("orders"))).withColumn("repeated_keys", F.lit(None).cast("bigint"))
    last = store.repeated_in("part-2").agg(
        F.lit("cust_once_batch").alias("rule_id"), F.lit("orders").alias("table_name"), F.lit("integrity").alias("rule_category"),
        F.lit("high").alias("severity_level"), F.count(F.lit(1)).alias("records_checked"),
        F.coalesce(F.sum("copies"), F.lit(0)).alias("records_failed"), F.coalesce(F.sum("earlier"), F.lit(0)).alias("records_passed"),
        F.lit(None).cast("double").alias("failure_rate"), F.lit(None).cast("double").alias("threshold_value"),
        F.lit(None).cast("boolean").alias("threshold_passed"), F.lit("pass").alias("status"),
        F.count_if(F.col("earlier") > 0).alias("repeated_keys"))
    return whole.unionByName(last)
