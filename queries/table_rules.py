"""Integrity and cross-table rules, and the rows that violate them."""

from __future__ import annotations

from pyspark.sql import functions as F

from queries.base import (
    integrity_sql, query, report, result_sql, rules_from, run_of, counts_sql, table,
)
from queries.row_rules import LINEITEM_RULES
from veriframe.operators.cross_table import check_cross_table, check_row_counts, check_totals
from veriframe.operators.freshness import check_freshness
from veriframe.operators.integrity import (
    check_foreign_key, check_primary_key, check_unique, duplicate_rows, orphan_rows,
)
from veriframe.operators.samples import (
    attach_samples, mask_columns, sample_violations, split_rows,
)
from veriframe.operators.row_checks import check_rows
from veriframe.plans.rules import Rule


def rule(rule_id, columns, severity="high", threshold=None, category="integrity", logic=""):
    return Rule(
        rule_id=rule_id, columns=tuple(columns), severity_level=severity,
        threshold_value=threshold, rule_category=category, rule_type="multi_field", rule_logic=logic,
    )


def unique_sql(rule_id, source, keys, table_name, threshold=None, severity="high"):
    complete = " AND ".join(f"{k} IS NOT NULL" for k in keys)
    counts = (
        f"SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS checked, "
        f"CAST(coalesce(sum(n) FILTER (WHERE n > 1 AND {complete}), 0) AS BIGINT) AS failed "
        f"FROM (SELECT {', '.join(keys)}, count(*) AS n FROM {source} GROUP BY ALL)"
    )
    return integrity_sql((rule_id, "integrity", severity, threshold), counts, table_name)


def foreign_key_sql(rule_id, child, key, parent, parent_key, threshold=None):
    counts = (
        f"SELECT count(*) AS checked, count(*) FILTER (WHERE {key} IS NOT NULL AND NOT EXISTS "
        f"(SELECT 1 FROM {parent} p WHERE p.{parent_key} = c.{key})) AS failed FROM {child} c"
    )
    return integrity_sql((rule_id, "integrity", "high", threshold), counts, child.split(" ")[0])


@query("unique_lineitem_key", unique_sql(
    "li_key_unique", "lineitem", ["l_orderkey", "l_linenumber"], "lineitem", 10.0, "critical"))
def unique_lineitem_key(spark, sf_dir):
    """Order line numbers are meant to be unique per order, and are not."""
    r = rule("li_key_unique", ["l_orderkey", "l_linenumber"], "critical", 10.0)
    return report(check_unique(table(spark, sf_dir, "lineitem"), r, run_of("lineitem")))


@query("unique_orders_key", unique_sql("or_key_unique", "orders", ["o_orderkey"], "orders"))
def unique_orders_key(spark, sf_dir):
    """A key that is unique."""
    r = rule("or_key_unique", ["o_orderkey"])
    return report(check_unique(table(spark, sf_dir, "orders"), r, run_of("orders")))


@query("unique_nullable_source", unique_sql(
    "doc_source_unique",
    "(SELECT CASE WHEN lang = 'fr' THEN NULL ELSE source END AS source, lang FROM documents)",
    ["source", "lang"], "documents"))
def unique_nullable_source(spark, sf_dir):
    """A key with few values and null parts: nulls are exempt, every other group is repeated."""
    df = table(spark, sf_dir, "documents").select(
        F.when(F.col("lang") != "fr", F.col("source")).alias("source"), "lang"
    )
    return report(check_unique(df, rule("doc_source_unique", ["source", "lang"]), run_of("documents")))


@query("primary_key_conversations", integrity_sql(
    ("cv_primary_key", "integrity", "critical", None),
    """SELECT CAST(sum(n) AS BIGINT) AS checked,
 CAST(coalesce(sum(n) FILTER (WHERE n > 1 OR conv_id IS NULL OR turn IS NULL OR role IS NULL), 0) AS BIGINT) AS failed
 FROM (SELECT conv_id, turn, CASE WHEN role = 'system' THEN NULL ELSE role END AS role, count(*) AS n
       FROM conversations GROUP BY ALL)""", "conversations"))
def primary_key_conversations(spark, sf_dir):
    """A composite key in which one part is missing for some rows."""
    df = table(spark, sf_dir, "conversations").withColumn(
        "role", F.when(F.col("role") != "system", F.col("role"))
    )
    r = rule("cv_primary_key", ["conv_id", "turn", "role"], "critical")
    return report(check_primary_key(df, r, run_of("conversations")))


@query("fk_lineitem_orders", foreign_key_sql(
    "fk_li_orders", "lineitem", "l_orderkey", "orders", "o_orderkey"))
def fk_lineitem_orders(spark, sf_dir):
    """Every order line belongs to an order."""
    return report(check_foreign_key(
        table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders"), ["o_orderkey"],
        rule("fk_li_orders", ["l_orderkey"]), run_of("lineitem")))


@query("fk_lineitem_open_orders", foreign_key_sql(
    "fk_li_open", "lineitem", "l_orderkey",
    "(SELECT * FROM orders WHERE o_orderstatus <> 'F' AND o_totalprice < 400000)", "o_orderkey", 50.0))
def fk_lineitem_open_orders(spark, sf_dir):
    """The parent side filtered, so that many lines have no parent."""
    parent = table(spark, sf_dir, "orders").where("o_orderstatus <> 'F' AND o_totalprice < 400000")
    return report(check_foreign_key(
        table(spark, sf_dir, "lineitem"), parent, ["o_orderkey"],
        rule("fk_li_open", ["l_orderkey"], threshold=50.0), run_of("lineitem")))


@query("fk_orders_customer", foreign_key_sql(
    "fk_or_customer", "orders", "o_custkey", "customer", "c_custkey"))
def fk_orders_customer(spark, sf_dir):
    """Every order has a customer."""
    return report(check_foreign_key(
        table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer"), ["c_custkey"],
        rule("fk_or_customer", ["o_custkey"]), run_of("orders")))


@query("fk_documents_labels", foreign_key_sql(
    "fk_doc_labels", "documents", "doc_id", "labels", "doc_id", 75.0))
def fk_documents_labels(spark, sf_dir):
    """Labels cover only some of the documents."""
    return report(check_foreign_key(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ["doc_id"],
        rule("fk_doc_labels", ["doc_id"], threshold=75.0), run_of("documents")))


@query("fk_nation_region", "\nUNION ALL ".join(f"({s})" for s in [
    foreign_key_sql("fk_na_region", "nation", "n_regionkey", "region", "r_regionkey"),
    foreign_key_sql("fk_cu_nation", "customer", "c_nationkey", "nation", "n_nationkey"),
    foreign_key_sql("fk_su_nation", "supplier", "s_nationkey", "nation", "n_nationkey"),
    foreign_key_sql("fk_li_part", "lineitem", "l_partkey", "part", "p_partkey"),
    foreign_key_sql("fk_li_supplier", "lineitem", "l_suppkey", "supplier", "s_suppkey"),
]))
def fk_nation_region(spark, sf_dir):
    """The other foreign keys of the star schema."""
    out = None
    for rule_id, child, key, parent, parent_key in [
        ("fk_na_region", "nation", "n_regionkey", "region", "r_regionkey"),
        ("fk_cu_nation", "customer", "c_nationkey", "nation", "n_nationkey"),
        ("fk_su_nation", "supplier", "s_nationkey", "nation", "n_nationkey"),
        ("fk_li_part", "lineitem", "l_partkey", "part", "p_partkey"),
        ("fk_li_supplier", "lineitem", "l_suppkey", "supplier", "s_suppkey"),
    ]:
        one = check_foreign_key(
            table(spark, sf_dir, child), table(spark, sf_dir, parent), [parent_key],
            rule(rule_id, [key]), run_of(child))
        out = one if out is None else out.unionByName(one)
    return report(out)


CROSS = [
    ("x_ship_after_order", ["l_shipdate", "o_orderdate"], "consistency", "high", 60.0,
     "col('l_shipdate') >= col('o_orderdate')", "l_shipdate >= o_orderdate"),
    ("x_line_below_total", ["l_extendedprice", "o_totalprice"], "consistency", "medium", None,
     "less_than(col('l_extendedprice'), col('o_totalprice'))", "l_extendedprice < o_totalprice"),
    ("x_finished_returned", ["l_linestatus", "o_orderstatus"], "consistency", "low", 20.0,
     "NOT (o_orderstatus = 'F' AND l_linestatus = 'O')",
     "NOT (o_orderstatus = 'F' AND l_linestatus = 'O')"),
]


@query("xtable_ship_after_order", result_sql(
    "\nUNION ALL ".join(
        counts_sql("lineitem JOIN orders ON l_orderkey = o_orderkey", s) for s in CROSS),
    "lineitem"))
def xtable_ship_after_order(spark, sf_dir):
    """Three conditions over order lines and their orders, in one join."""
    return report(check_cross_table(
        table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders"),
        ["l_orderkey"], ["o_orderkey"], rules_from(CROSS), run_of("lineitem")))


SAME_NAMES = [
    ("x_date_after", ["l_shipdate"], "consistency", "high", 50.0, "left.l_shipdate >= right.l_shipdate", "l.l_shipdate >= r.l_shipdate"),
    ("x_line_below_order", ["l_extendedprice"], "consistency", "medium", 10.0, "left.l_extendedprice <= right.l_extendedprice",
     "l.l_extendedprice <= r.l_extendedprice"),
    ("x_tax_kept", ["l_tax"], "custom", "low", None, "l_tax < 0.05 OR right.l_extendedprice > 100000", "l_tax < 0.05 OR r.l_extendedprice > 100000"),
]


@query("xtable_same_names", result_sql("\nUNION ALL ".join(counts_sql(
    "lineitem l JOIN (SELECT o_orderkey AS l_orderkey, o_orderdate AS l_shipdate, o_totalprice AS l_extendedprice FROM orders) r USING (l_orderkey)", s)
    for s in SAME_NAMES), "lineitem"))
def xtable_same_names(spark, sf_dir):
    """Order lines against orders whose columns have the same names, told apart by their side."""
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderdate").alias("l_shipdate"), F.col("o_totalprice").alias("l_extendedprice"))
    return report(check_cross_table(
        table(spark, sf_dir, "lineitem"), orders, ["l_orderkey"], ["l_orderkey"], rules_from(SAME_NAMES), run_of("lineitem")))


@query("reconcile_order_total", integrity_sql(
    ("x_order_total", "integrity", "high", 99.0),
    """SELECT count(*) AS checked,
 count(*) FILTER (WHERE NOT coalesce(abs(a - b) <= 50000, false)) AS failed
 FROM (SELECT o_orderkey, sum(o_totalprice) AS a FROM orders GROUP BY 1)
 FULL JOIN (SELECT l_orderkey, sum(l_extendedprice * (1 - l_discount)) AS b FROM lineitem GROUP BY 1)
 ON o_orderkey = l_orderkey""", "orders"))
def reconcile_order_total(spark, sf_dir):
    """Order totals against the sum of their lines, within a tolerance."""
    return report(check_totals(
        table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem"),
        ["o_orderkey"], ["l_orderkey"], F.col("o_totalprice"),
        F.expr("l_extendedprice * (1 - l_discount)"),
        rule("x_order_total", ["o_totalprice"], threshold=99.0), run_of("orders"), tolerance=50000))


@query("reconcile_row_counts", integrity_sql(
    ("x_label_rows", "integrity", "medium", 70.0),
    """SELECT greatest((SELECT count(*) FROM documents), (SELECT count(*) FROM labels)) AS checked,
 abs((SELECT count(*) FROM documents) - (SELECT count(*) FROM labels)) AS failed""", "documents"))
def reconcile_row_counts(spark, sf_dir):
    """Two tables that should have the same number of rows."""
    return report(check_row_counts(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"),
        rule("x_label_rows", ["doc_id"], "medium", 70.0), run_of("documents")))


@query("freshness_events", integrity_sql(
    ("ev_newest", "timeliness", "critical", None),
    """SELECT count(*) AS checked, CASE WHEN coalesce(date_diff('day', max(ts), TIMESTAMP '2024-02-01 00:00:00') <= 1, false)
 THEN 0 ELSE count(*) END AS failed FROM events""", "events"))
def freshness_events(spark, sf_dir):
    """The newest row of a table must be recent, measured from a fixed time."""
    r = rule("ev_newest", ["ts"], "critical", None, "timeliness")
    now = F.expr("timestamp_ntz'2024-02-01 00:00:00'")
    return report(check_freshness(table(spark, sf_dir, "events"), r, 1, now, run_of("events")))


@query("duplicate_lineitems", """
SELECT * FROM lineitem WHERE (l_orderkey, l_linenumber) IN
 (SELECT (l_orderkey, l_linenumber) FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)""")
def duplicate_lineitems(spark, sf_dir):
    """All rows whose key occurs more than once."""
    return duplicate_rows(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("orphan_documents", """
SELECT * FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)""")
def orphan_documents(spark, sf_dir):
    """All rows whose key has no parent."""
    df = table(spark, sf_dir, "documents")
    return orphan_rows(df, table(spark, sf_dir, "labels"), ["doc_id"], ["doc_id"])


SAMPLED = [s for s in LINEITEM_RULES if s[0] in (
    "li_discount_range", "li_returnflag_list", "li_ship_fresh", "li_tax_below_discount")]
LINE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"]


def sample_sql(columns: str, n: int) -> str:
    parts = "\nUNION ALL ".join(
        f"SELECT '{s[0]}' AS rule_id, * FROM lineitem WHERE NOT coalesce(({s[6]}), false)" for s in SAMPLED)
    return f"""SELECT rule_id, CAST(rank AS INT) AS rank, {columns} FROM (
 SELECT *, row_number() OVER (PARTITION BY rule_id ORDER BY {', '.join(LINE_KEY)}) AS rank
 FROM ({parts})) WHERE rank <= {n}"""


@query("sample_topk", sample_sql(
    "l_orderkey AS k_orderkey, l_linenumber AS k_linenumber, l_partkey AS k_partkey, "
    "l_suppkey AS k_suppkey", 100))
def sample_topk(spark, sf_dir):
    """The first hundred failing rows of each rule by key."""
    samples = sample_violations(
        table(spark, sf_dir, "lineitem"), rules_from(SAMPLED), LINE_KEY, 100, run=run_of("lineitem"))
    key = F.from_json(
        "record_key", "l_orderkey bigint, l_linenumber int, l_partkey bigint, l_suppkey bigint")
    return samples.withColumn("k", key).select(
        "rule_id", "rank", F.col("k.l_orderkey").alias("k_orderkey"),
        F.col("k.l_linenumber").alias("k_linenumber"), F.col("k.l_partkey").alias("k_partkey"),
        F.col("k.l_suppkey").alias("k_suppkey"))


@query("sample_in_results", result_sql(
    "\nUNION ALL ".join(counts_sql("lineitem", s) for s in SAMPLED), "lineitem").replace(
    "AS status\nFROM rates", "AS status, CAST(least(failed, 10) AS INT) AS sampled\nFROM rates"))
def sample_in_results(spark, sf_dir):
    """Result rows that carry their sample of failing records."""
    df, rules, run = table(spark, sf_dir, "lineitem"), rules_from(SAMPLED), run_of("lineitem")
    results = attach_samples(
        check_rows(df, rules, run), sample_violations(df, rules, LINE_KEY, 10, run=run))
    return report(results.withColumn("sampled", F.size("sample_failed_records")), "sampled")


SPLIT = [s for s in LINEITEM_RULES if s[0] in (
    "li_discount_range", "li_returnflag_list", "li_sql_between")]


@query("split_good_bad", "SELECT part, l_returnflag, violated, count(*) AS row_count, "
       "round(sum(l_extendedprice), 2) AS price FROM (SELECT *, "
       "CASE WHEN violated = '' THEN 'good' ELSE 'bad' END AS part FROM (SELECT *, concat_ws(',', "
       + ", ".join(f"CASE WHEN NOT coalesce(({s[6]}), false) THEN '{s[0]}' END" for s in SPLIT)
       + ") AS violated FROM lineitem)) GROUP BY ALL")
def split_good_bad(spark, sf_dir):
    """Good rows and quarantined rows with the ids of the rules they violate, summed up."""
    good, bad = split_rows(table(spark, sf_dir, "lineitem"), rules_from(SPLIT))
    both = good.withColumn("violated", F.lit("")).withColumn("part", F.lit("good")).unionByName(
        bad.withColumn("violated", F.concat_ws(",", "violated")).withColumn("part", F.lit("bad")))
    return both.groupBy("part", "l_returnflag", "violated").agg(
        F.count(F.lit(1)).alias("row_count"), F.round(F.sum("l_extendedprice"), 2).alias("price"))


@query("masked_violations", """
SELECT c_custkey, sha256(c_name) AS c_name,
 regexp_replace(regexp_replace(regexp_replace(c_mktsegment, '[A-Z]', 'X', 'g'), '[a-z]', 'x', 'g'), '[0-9]', 'n', 'g') AS c_mktsegment,
 '***' AS c_acctbal FROM customer WHERE NOT coalesce(c_acctbal >= 0, false)""")
def masked_violations(spark, sf_dir):
    """Quarantined rows with sensitive columns hashed, masked or redacted."""
    rules = [rule("cu_balance", ["c_acctbal"], logic="col('c_acctbal') >= 0")]
    _, bad = split_rows(table(spark, sf_dir, "customer"), rules)
    shown = mask_columns(bad, {"c_name": "hash", "c_mktsegment": "mask", "c_acctbal": "redact"})
    return shown.select("c_custkey", "c_name", "c_mktsegment", "c_acctbal")
