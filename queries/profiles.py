"""Profiles, patterns, suggestions and anomalous values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from queries.base import query, table
from queries.row_rules import LINEITEM_RULES
from queries.base import rules_from, run_of
from veriframe.operators import profile as P
from veriframe.operators import sketches as S
from veriframe.operators.patterns import expressions
from veriframe.operators.row_checks import check_rows
from veriframe.session import shared_folder
from veriframe.sources.connectors import describe


def column_sql(name, kind, data_type, source):
    """Profile of one column; `kind` is number, text, time or other."""
    number, text, time = (kind == k for k in ("number", "text", "time"))
    d = f"{name}::DOUBLE"
    null = "CAST(NULL AS DOUBLE)"
    return f"""SELECT '{name}' AS column_name, '{data_type}' AS data_type, count(*) AS row_count,
 count(*) FILTER (WHERE {name} IS NULL) AS null_count,
 count(DISTINCT {name}) AS distinct_count,
 {f'min({d})' if number else null} AS min_value, {f'max({d})' if number else null} AS max_value,
 {f'round(avg({d}), 4)' if number else null} AS mean_value,
 {f'round(stddev_samp({d}), 4)' if number else null} AS stddev_value,
 {f'min({name})' if text else 'CAST(NULL AS VARCHAR)'} AS min_text,
 {f'max({name})' if text else 'CAST(NULL AS VARCHAR)'} AS max_text,
 {f'CAST(max(length({name})) AS INT)' if text else 'CAST(NULL AS INT)'} AS max_length,
 {f'min({name})' if time else 'CAST(NULL AS TIMESTAMP)'} AS min_time,
 {f'max({name})' if time else 'CAST(NULL AS TIMESTAMP)'} AS max_time FROM {source}"""


COLUMNS = {
    "customer": [("c_custkey", "number", "bigint"), ("c_name", "text", "string"),
                 ("c_nationkey", "number", "int"), ("c_acctbal", "number", "double"),
                 ("c_mktsegment", "text", "string")],
    "orders": [("o_orderkey", "number", "bigint"), ("o_custkey", "number", "bigint"),
               ("o_orderstatus", "text", "string"), ("o_totalprice", "number", "double"),
               ("o_orderdate", "time", "timestamp_ntz"), ("o_orderpriority", "text", "string")],
    "documents": [("doc_id", "number", "bigint"), ("text", "text", "string"), ("lang", "text", "string"),
                  ("source", "text", "string"), ("n_chars", "number", "bigint")],
    "embeddings": [("vec_id", "number", "bigint"), ("embedding", "other", "array<float>"),
                   ("label", "number", "int")],
}


def _profile(name):
    @query(f"profile_{name}", "\nUNION ALL ".join(column_sql(*c, name) for c in COLUMNS[name]))
    def run(spark, sf_dir):
        """Profile of every column, exact distinct counts."""
        rows = P.profile(table(spark, sf_dir, name), distinct="exact").drop("quantiles")
        rounded = {c: F.round(c, 4) for c in ("mean_value", "stddev_value")}
        times = {c: F.col(c).cast("timestamp_ntz") for c in ("min_time", "max_time")}
        return rows.withColumns({**rounded, **times})


for _name in COLUMNS:
    _profile(_name)


LINE_COLUMNS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
                "l_returnflag", "l_linestatus", "l_shipdate"]


@query("profile_approx", "\nUNION ALL ".join(
    f"""SELECT '{c}' AS column_name, count(*) AS row_count, count(*) - count({c}) AS null_count,
 {"NULL::DOUBLE" if c in LINE_COLUMNS[8:] else f"min({c})::DOUBLE"} AS min_value, {"NULL::DOUBLE" if c in LINE_COLUMNS[8:] else f"max({c})::DOUBLE"} AS max_value,
 count(DISTINCT {c}) AS distinct_count, true AS distinct_within_5_percent FROM lineitem""" for c in LINE_COLUMNS))
def profile_approx(spark, sf_dir):
    """Profile of lineitem with approximate distinct counts, and whether they are near the exact ones."""
    df = table(spark, sf_dir, "lineitem").select(*LINE_COLUMNS)
    exact = S.distinct_values(df).withColumnRenamed("distinct_count", "exact")
    rows = P.profile(df).join(exact, "column_name")
    near = F.abs(F.col("distinct_count") - F.col("exact")) <= 0.05 * F.col("exact")
    return rows.select("column_name", "row_count", "null_count", "min_value", "max_value",
                       F.col("exact").alias("distinct_count"), near.alias("distinct_within_5_percent"))


MERGED = {"lineitem": ["l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_shipdate", "l_linestatus"],
          "embeddings": ["vec_id", "embedding"]}
MERGED_NUMBERS = ("l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "vec_id")


@query("profile_merged", "\nUNION ALL ".join(
    f"""SELECT '{t}' AS table_name, '{c}' AS column_name, count(*) AS row_count, count(*) - count({c}) AS null_count,
 {f"min({c})::DOUBLE" if c in MERGED_NUMBERS else "NULL::DOUBLE"} AS min_value, {f"max({c})::DOUBLE" if c in MERGED_NUMBERS else "NULL::DOUBLE"} AS max_value,
 count(DISTINCT {c}) AS distinct_count, true AS distinct_within_5_percent, {"true" if c in MERGED_NUMBERS else "NULL::BOOLEAN"} AS quartiles_within_2_percent
 FROM {t}""" for t, columns in MERGED.items() for c in columns))
def profile_merged(spark, sf_dir):
    """Sketches stored part by part and merged; a part that comes again replaces itself. Exact values tell how near they are."""
    frames = []
    for name, columns in MERGED.items():
        df = table(spark, sf_dir, name).select(*columns)
        parts = df.withColumn("part", F.col(columns[0]) % 5)
        path = shared_folder(spark, "sketches")
        S.store(parts.where("part < 3"), path, "part", columns)
        S.store(parts.where("part >= 2"), path, "part", columns)
        merged = S.profile_stored(spark, path)
        rows = merged.join(S.distinct_values(df).withColumnRenamed("distinct_count", "exact"), "column_name")
        near = F.abs(F.col("distinct_count") - F.col("exact")) <= 0.05 * F.col("exact")
        numbers = [c for c in columns if c in MERGED_NUMBERS]
        found = {r.column_name: r.quantiles for r in merged.where("quantiles IS NOT NULL").collect()}
        shares = df.agg(*[
            (F.greatest(*[F.abs(F.count_if(F.col(c) <= q) / F.count(F.lit(1)) - p) for q, p in zip(found[c], S.QUANTILES)]) <= 0.02)
            | (F.approx_count_distinct(c) < 100) for c in numbers]).first()
        quartiles = F.create_map(*[F.lit(x) for c, ok in zip(numbers, shares) for x in (c, bool(ok))])
        frames.append(rows.select(
            F.lit(name).alias("table_name"), "column_name", "row_count", "null_count", "min_value", "max_value",
            F.col("exact").alias("distinct_count"), near.alias("distinct_within_5_percent"),
            F.try_element_at(quartiles, F.col("column_name")).alias("quartiles_within_2_percent")))
    return frames[0].unionByName(frames[1])


@query("profile_quartiles", """
SELECT 'l_extendedprice' AS column_name, quantile_disc(l_extendedprice, 0.25) AS q1,
 quantile_disc(l_extendedprice, 0.5) AS q2, quantile_disc(l_extendedprice, 0.75) AS q3 FROM lineitem
UNION ALL SELECT 'l_quantity', quantile_disc(l_quantity, 0.25), quantile_disc(l_quantity, 0.5),
 quantile_disc(l_quantity, 0.75) FROM lineitem""")
def profile_quartiles(spark, sf_dir):
    """Exact quartiles of two columns."""
    found = P.quantiles(table(spark, sf_dir, "lineitem"), ["l_extendedprice", "l_quantity"], [0.25, 0.5, 0.75])
    rows = [(c, *values) for c, values in found.items()]
    return spark.createDataFrame(rows, "column_name string, q1 double, q2 double, q3 double")


TOP = ["l_returnflag", "l_linestatus", "l_quantity", "l_shipdate"]


@query("top_values", """SELECT column_name, value, CAST(copies AS BIGINT) AS copies, CAST(rank AS INT) AS rank FROM (
 SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY copies DESC, value) AS rank FROM (
  SELECT 'l_returnflag' AS column_name, l_returnflag AS value, count(*) AS copies FROM lineitem GROUP BY ALL
  UNION ALL SELECT 'l_linestatus', l_linestatus, count(*) FROM lineitem GROUP BY ALL
  UNION ALL SELECT 'l_quantity', CAST(l_quantity AS VARCHAR), count(*) FROM lineitem GROUP BY ALL
  UNION ALL SELECT 'l_shipdate', strftime(l_shipdate, '%Y-%m-%d %H:%M:%S'), count(*) FROM lineitem GROUP BY ALL))
WHERE rank <= 5""")
def top_values(spark, sf_dir):
    """The five most frequent values of some columns."""
    return P.top_values(table(spark, sf_dir, "lineitem"), TOP, 5)


def shape_sql(column):
    return (f"translate({column}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789', "
            f"'{'A' * 26 + 'a' * 26 + '9' * 10}')")


@query("value_patterns", "SELECT column_name, pattern, CAST(copies AS BIGINT) AS copies, CAST(rank AS INT) AS rank FROM (\n"
       "SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY copies DESC, pattern) AS rank FROM (\n"
       + "\nUNION ALL ".join(
           f"SELECT '{c}' AS column_name, {shape_sql(c)} AS pattern, count(*) AS copies FROM part GROUP BY ALL"
           for c in ("p_name", "p_brand", "p_type"))
       + ")) WHERE rank <= 5")
def value_patterns(spark, sf_dir):
    """The five most frequent shapes of text columns."""
    return P.patterns(table(spark, sf_dir, "part"), ["p_name", "p_brand", "p_type"], 5)


EXPRESSED = {"customer": ["c_name", "c_mktsegment"], "part": ["p_name", "p_brand", "p_type"], "pages": ["url"], "documents": ["text", "lang", "source"]}


@query("pattern_expressions", "\nUNION ALL ".join(
    f"""SELECT '{t}' AS table_name, '{c}' AS column_name, count({c}) AS row_count, count({c})::BIGINT AS covered, count({c}) AS matched,
 true AS no_more_than_shapes FROM {t}""" for t, columns in EXPRESSED.items() for c in columns))
def pattern_expressions(spark, sf_dir):
    """Expressions of text columns: how many values they cover, how many values match one, and whether they are no more than the shapes."""
    frames = []
    for name, columns in EXPRESSED.items():
        df = table(spark, sf_dir, name).select(*columns)
        found = expressions(df, columns, 100_000).groupBy("column_name").agg(
            F.sum("copies").alias("covered"), F.collect_list("expression").alias("expressions"))
        lists = {r.column_name: r.expressions for r in found.collect()}
        rows = df.agg(*[x for c in columns for x in (
            F.count(c).alias(f"{c}_rows"), F.count_if(F.col(c).rlike("|".join(lists[c]))).alias(f"{c}_matched"),
            F.countDistinct(P.shape(F.col(c))).alias(f"{c}_shapes"))])
        each = rows.select(F.inline(F.array(*[
            F.struct(F.lit(c).alias("column_name"), F.col(f"{c}_rows").alias("row_count"), F.col(f"{c}_matched").alias("matched"),
                     (F.lit(len(lists[c])) <= F.col(f"{c}_shapes")).alias("no_more_than_shapes")) for c in columns])))
        frames.append(found.drop("expressions").join(each, "column_name").withColumn("table_name", F.lit(name)))
    return reduce(lambda a, b: a.unionByName(b), frames).select(
        "table_name", "column_name", "row_count", "covered", "matched", "no_more_than_shapes")


@query("page_patterns", "SELECT pattern, CAST(copies AS BIGINT) AS copies FROM (SELECT "
       f"{shape_sql('url')} AS pattern, count(*) AS copies FROM pages GROUP BY ALL) "
       "ORDER BY copies DESC, pattern LIMIT 20")
def page_patterns(spark, sf_dir):
    """The twenty most frequent shapes of web addresses."""
    return P.patterns(table(spark, sf_dir, "pages"), ["url"], 20).select("pattern", "copies")


@query("suggest_rules", """WITH s AS (
 SELECT 'o_orderkey' AS column_name, count(*) AS n, count(o_orderkey) AS filled, count(DISTINCT o_orderkey) AS d,
  NULL AS listed, CAST(min(o_orderkey)::DOUBLE AS VARCHAR) || ', ' || CAST(max(o_orderkey)::DOUBLE AS VARCHAR) AS span FROM orders
 UNION ALL SELECT 'o_custkey', count(*), count(o_custkey), count(DISTINCT o_custkey), NULL,
  CAST(min(o_custkey)::DOUBLE AS VARCHAR) || ', ' || CAST(max(o_custkey)::DOUBLE AS VARCHAR) FROM orders
 UNION ALL SELECT 'o_totalprice', count(*), count(o_totalprice), count(DISTINCT o_totalprice), NULL,
  CAST(min(o_totalprice)::DOUBLE AS VARCHAR) || ', ' || CAST(max(o_totalprice)::DOUBLE AS VARCHAR) FROM orders
 UNION ALL SELECT 'o_orderstatus', count(*), count(o_orderstatus), count(DISTINCT o_orderstatus),
  string_agg(DISTINCT '''' || o_orderstatus || '''', ', ' ORDER BY '''' || o_orderstatus || ''''), NULL FROM orders
 UNION ALL SELECT 'o_orderpriority', count(*), count(o_orderpriority), count(DISTINCT o_orderpriority),
  string_agg(DISTINCT '''' || o_orderpriority || '''', ', ' ORDER BY '''' || o_orderpriority || ''''), NULL FROM orders
 UNION ALL SELECT 'o_orderdate', count(*), count(o_orderdate), count(DISTINCT o_orderdate), NULL, NULL FROM orders)
SELECT column_name, 'not_null' AS suggestion, 'completeness' AS rule_category, 'is_not_null(col(''' || column_name || '''))' AS rule_logic FROM s WHERE n = filled
UNION ALL SELECT column_name, 'unique', 'integrity', 'unique(col(''' || column_name || '''))' FROM s WHERE n = filled AND n = d
UNION ALL SELECT column_name, 'in_list', 'accuracy', 'is_in_list(col(''' || column_name || '''), [' || listed || '])' FROM s WHERE listed IS NOT NULL AND d <= 20
UNION ALL SELECT column_name, 'range', 'accuracy', 'range_check(col(''' || column_name || '''), ' || span || ')' FROM s WHERE span IS NOT NULL""")
def suggest_rules(spark, sf_dir):
    """Rules that orders satisfy today."""
    return P.suggest_rules(table(spark, sf_dir, "orders"))


@query("outliers_iqr", """WITH b AS (SELECT quantile_disc(value, 0.25) AS a, quantile_disc(value, 0.75) AS z FROM events)
SELECT event_id, value FROM events, b WHERE value < a - 1.5 * (z - a) OR value > z + 1.5 * (z - a)""")
def outliers_iqr(spark, sf_dir):
    """Values far outside the quartiles."""
    return P.outliers(table(spark, sf_dir, "events"), ["value"]).select("event_id", "value")


@query("outliers_stddev", """WITH b AS (SELECT avg(value) AS m, stddev_samp(value) AS s FROM events)
SELECT event_id, value FROM events, b WHERE abs(value - m) > 3 * s""")
def outliers_stddev(spark, sf_dir):
    """Values more than three standard deviations from the mean."""
    return P.outliers(table(spark, sf_dir, "events"), ["value"], "stddev").select("event_id", "value")


def past_results_sql():
    from queries.base import scorecard_sql

    names = ", ".join(f"('{s[0]}', '{c}')" for s in LINEITEM_RULES for c in s[1])
    types = ", ".join(f"('{c}', '{t}')" for c, t in LINE_TYPES.items())
    return (f"WITH results AS ({scorecard_sql('lineitem', LINEITEM_RULES)}), names(rule_id, column_name) AS "
            f"(VALUES {names}), types(column_name, data_type) AS (VALUES {types}) "
            "SELECT column_name, data_type, rule_id AS rule_logic, count(*) AS uses, "
            "round(avg(failure_rate), 4) AS mean_failure_rate FROM results JOIN names USING (rule_id) "
            "JOIN types USING (column_name) GROUP BY ALL")


LINE_TYPES = {
    "l_discount": "double", "l_quantity": "double", "l_tax": "double", "l_returnflag": "string",
    "l_extendedprice": "double", "l_shipdate": "timestamp_ntz",
}


@query("recommend_rules", past_results_sql())
def recommend_rules(spark, sf_dir):
    """Rules for a table out of what earlier rules found on columns of the same name and type."""
    lineitem = table(spark, sf_dir, "lineitem")
    results = check_rows(lineitem, rules_from(LINEITEM_RULES), run_of("lineitem"))
    columns = describe(lineitem)
    history = results.select(
        F.explode("column_names").alias("column_name"), F.col("rule_id").alias("rule_logic"), "failure_rate"
    ).join(columns, "column_name")
    return P.recommend_rules(columns.where(F.col("column_name").isin(list(LINE_TYPES))), history)
