"""Row rules: every rule function and rule-text form, fused into one scan per table."""

from __future__ import annotations

from pyspark.sql import functions as F

from queries.base import (
    counts_sql, query, report, result_sql, rules_from, run_of, scorecard_sql, table,
)
from veriframe.functions import predicates as P
from veriframe.operators.row_checks import check_rows, with_predicates
from veriframe.plans.validators import MultiFieldValidator, SingleFieldValidator

# (id, columns, category, severity, threshold, rule text, the same condition in plain SQL[, null policy])
LINEITEM_RULES = [
    ("li_discount_range", ["l_discount"], "accuracy", "high", 5.0,
     "range_check(col('l_discount'), min_value=0.0, max_value=0.08)",
     "l_discount >= 0.0 AND l_discount <= 0.08"),
    ("li_quantity_range", ["l_quantity"], "accuracy", "critical", None,
     "range_check(col('l_quantity'), 1, 50)", "l_quantity BETWEEN 1 AND 50"),
    ("li_tax_exclusive", ["l_tax"], "accuracy", "medium", 30.0,
     "range_check(col('l_tax'), 0, 0.08, inclusive=False)", "l_tax > 0 AND l_tax < 0.08"),
    ("li_returnflag_list", ["l_returnflag"], "accuracy", "high", 40.0,
     "is_in_list(col('l_returnflag'), ['A', 'R'])", "l_returnflag IN ('A', 'R')"),
    ("li_returnflag_not_list", ["l_returnflag"], "accuracy", "low", None,
     "is_not_in_list(col('l_returnflag'), ['X', 'Y'])", "l_returnflag NOT IN ('X', 'Y')"),
    ("li_shipdate_present", ["l_shipdate"], "completeness", "critical", 0.0,
     "is_not_null(col('l_shipdate'))", "l_shipdate IS NOT NULL"),
    ("li_flag_not_empty", ["l_returnflag"], "completeness", "high", 0.0,
     "is_not_empty(col('l_returnflag'))", "NOT (l_returnflag IS NULL OR trim(l_returnflag) = '')"),
    ("li_status_regex", ["l_linestatus"], "accuracy", "medium", 60.0,
     "regex_match(col('l_linestatus'), '^[O]$')", "regexp_matches(l_linestatus, '^[O]$')"),
    ("li_status_length", ["l_linestatus"], "accuracy", "low", None,
     "length_check(col('l_linestatus'), 1, 1)", "length(trim(l_linestatus)) BETWEEN 1 AND 1"),
    ("li_price_numeric", ["l_extendedprice"], "accuracy", "medium", None,
     "is_numeric(col('l_extendedprice'))", "l_extendedprice IS NOT NULL AND NOT isnan(l_extendedprice)"),
    ("li_ship_fresh", ["l_shipdate"], "timeliness", "medium", 70.0,
     "is_fresh(col('l_shipdate'), 1000, timestamp'2001-12-31 00:00:00')",
     "date_diff('day', l_shipdate, TIMESTAMP '2001-12-31 00:00:00') <= 1000"),
    ("li_price_above_qty", ["l_extendedprice", "l_quantity"], "consistency", "high", None,
     "greater_than(col('l_extendedprice'), col('l_quantity'))", "l_extendedprice > l_quantity"),
    ("li_tax_below_discount", ["l_tax", "l_discount"], "consistency", "low", 50.0,
     "less_than(col('l_tax'), col('l_discount'))", "l_tax < l_discount"),
    ("li_part_differs", ["l_partkey", "l_suppkey"], "consistency", "low", 1.0,
     "not_equals(col('l_partkey'), col('l_suppkey'))", "l_partkey <> l_suppkey"),
    ("li_tax_equals_discount", ["l_tax", "l_discount"], "consistency", "low", 95.0,
     "equals(col('l_tax'), col('l_discount'))", "l_tax = l_discount"),
    ("li_sql_boolean", ["l_quantity", "l_returnflag"], "custom", "medium", 50.0,
     "col('l_quantity') > 10 AND NOT col('l_returnflag') = 'N' OR l_linenumber IN (1, 2)",
     "l_quantity > 10 AND NOT l_returnflag = 'N' OR l_linenumber IN (1, 2)"),
    ("li_sql_between", ["l_linenumber"], "custom", "medium", 20.0,
     "column BETWEEN 1 AND 6", "l_linenumber BETWEEN 1 AND 6"),
    ("li_sql_like", ["l_returnflag"], "custom", "low", None,
     "column LIKE '_'", "l_returnflag LIKE '_'"),
    ("li_arithmetic", ["l_extendedprice", "l_discount", "l_tax"], "consistency", "medium", 10.0,
     "col('l_extendedprice') * (1 - col('l_discount')) * (1 + col('l_tax')) >= 1000.5",
     "l_extendedprice * (1 - l_discount) * (1 + l_tax) >= 1000.5"),
    ("li_date_part", ["l_shipdate"], "custom", "low", 30.0,
     "year(col('l_shipdate')) < 2000 or month(col('l_shipdate')) == 7",
     "year(l_shipdate) < 2000 OR month(l_shipdate) = 7"),
]


@query("fused_scorecard", scorecard_sql("lineitem", LINEITEM_RULES))
def fused_scorecard(spark, sf_dir):
    """Twenty rules over lineitem in one scan."""
    df = table(spark, sf_dir, "lineitem")
    return report(check_rows(df, rules_from(LINEITEM_RULES), run_of("lineitem")))


ENTRY_RULES = [s for s in LINEITEM_RULES if s[0] in (
    "li_discount_range", "li_quantity_range", "li_returnflag_list", "li_shipdate_present",
    "li_status_regex", "li_price_above_qty",
)]


@query("entry_scorecard", scorecard_sql("lineitem", ENTRY_RULES))
def entry_scorecard(spark, sf_dir):
    """The flagship query: six rules over lineitem."""
    df = table(spark, sf_dir, "lineitem")
    return report(check_rows(df, rules_from(ENTRY_RULES), run_of("lineitem")))


# Contact data spelled out of customer columns, with gaps and faults of known kinds.
CONTACTS_SQL = """(SELECT c_custkey, c_nationkey, c_acctbal,
 CASE WHEN c_nationkey % 7 = 0 THEN NULL
      ELSE lower(substr(c_name, 1, 8)) || CAST(c_custkey AS VARCHAR)
        || CASE WHEN c_nationkey % 3 = 0 THEN '' ELSE '@' END || 'example.'
        || CASE WHEN c_nationkey % 5 = 0 THEN 'c' ELSE 'com' END END AS email,
 CASE WHEN c_nationkey % 4 = 0 THEN '(' || substr(c_name, 10, 3) || ') ' || substr(c_name, 13, 3) || '-' || substr(c_name, 16, 3)
      WHEN c_nationkey % 4 = 1 THEN substr(c_name, 10, 9) || '-' || CAST(c_nationkey AS VARCHAR)
      WHEN c_nationkey % 4 = 2 THEN c_name || '0'
      ELSE substr(c_name, 10, 9) || '.' || substr(c_name, 16, 3) END AS phone,
 CASE WHEN c_nationkey % 6 = 0 THEN '   ' WHEN c_nationkey % 6 = 1 THEN NULL
      ELSE ' ' || c_mktsegment || ' ' END AS segment,
 CASE WHEN c_nationkey % 8 = 0 THEN 'n/a' WHEN c_nationkey % 8 = 1 THEN 'NaN'
      ELSE CAST(c_custkey AS VARCHAR) || '.5' END AS amount
 FROM customer) AS contacts"""


def contacts(spark, sf_dir):
    nation = F.col("c_nationkey")
    key = F.col("c_custkey").cast("string")
    name = F.col("c_name")
    return table(spark, sf_dir, "customer").select(
        "c_custkey", "c_nationkey", "c_acctbal",
        F.when(nation % 7 == 0, None).otherwise(
            F.concat(
                F.lower(F.substring(name, 1, 8)), key,
                F.when(nation % 3 == 0, "").otherwise("@"), F.lit("example."),
                F.when(nation % 5 == 0, "c").otherwise("com"),
            )
        ).alias("email"),
        F.when(nation % 4 == 0, F.concat(
            F.lit("("), F.substring(name, 10, 3), F.lit(") "), F.substring(name, 13, 3),
            F.lit("-"), F.substring(name, 16, 3)))
        .when(nation % 4 == 1, F.concat(F.substring(name, 10, 9), F.lit("-"), nation.cast("string")))
        .when(nation % 4 == 2, F.concat(name, F.lit("0")))
        .otherwise(F.concat(F.substring(name, 10, 9), F.lit("."), F.substring(name, 16, 3)))
        .alias("phone"),
        F.when(nation % 6 == 0, "   ").when(nation % 6 == 1, None)
        .otherwise(F.concat(F.lit(" "), "c_mktsegment", F.lit(" "))).alias("segment"),
        F.when(nation % 8 == 0, "n/a").when(nation % 8 == 1, "NaN")
        .otherwise(F.concat(key, F.lit(".5"))).alias("amount"),
    )


EMAIL = "regexp_matches(email, '^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{2,}$')"
PHONE = (
    "regexp_matches(phone, '^[\\d\\s\\-\\(\\)\\.]+$') AND "
    "length(regexp_replace(phone, '[^0-9]', '', 'g')) >= 10"
)
CONTACT_RULES = [
    ("ct_email_format", ["email"], "accuracy", "high", 60.0, "is_email(col('email'))", EMAIL),
    ("ct_email_format_skip", ["email"], "accuracy", "high", 60.0, "is_email(col('email'))", EMAIL, "skip"),
    ("ct_phone_format", ["phone"], "accuracy", "medium", None, "is_phone(col('phone'))", PHONE),
    ("ct_segment_empty", ["segment"], "completeness", "low", None, "is_empty(col('segment'))",
     "segment IS NULL OR trim(segment) = ''"),
    ("ct_segment_filled", ["segment"], "completeness", "high", 30.0, "is_not_empty(column)",
     "NOT (segment IS NULL OR trim(segment) = '')"),
    ("ct_segment_null", ["segment"], "completeness", "low", 90.0, "is_null(col('segment'))",
     "segment IS NULL"),
    ("ct_segment_length", ["segment"], "accuracy", "low", 50.0,
     "length_check(col('segment'), min_length=9)", "length(trim(segment)) >= 9"),
    ("ct_segment_max", ["segment"], "accuracy", "low", None,
     "length_check(col('segment'), None, 8)", "length(trim(segment)) <= 8"),
    ("ct_amount_numeric", ["amount"], "accuracy", "medium", 10.0, "is_numeric(col('amount'))",
     "TRY_CAST(amount AS DOUBLE) IS NOT NULL AND NOT isnan(TRY_CAST(amount AS DOUBLE))"),
    ("ct_balance_floor", ["c_acctbal"], "accuracy", "high", 10.0,
     "range_check(col('c_acctbal'), min_value=0)", "c_acctbal >= 0"),
    ("ct_mixed", ["email", "c_acctbal"], "custom", "medium", None,
     "is_email(col('email')) AND (col('c_acctbal') > 0 OR NOT is_phone(phone))",
     f"{EMAIL} AND (c_acctbal > 0 OR NOT ({PHONE}))"),
    ("ct_raw_regex", ["phone"], "accuracy", "low", None,
     r"regex_match(col('phone'), r'^\(\d{3}\) \d{3}-\d{3}$')",
     r"regexp_matches(phone, '^\(\d{3}\) \d{3}-\d{3}$')"),
]


@query("contact_formats", scorecard_sql(CONTACTS_SQL, CONTACT_RULES, "contacts"))
def contact_formats(spark, sf_dir):
    """E-mail, phone, blank, length and number formats, both null policies."""
    rules = rules_from(CONTACT_RULES)
    return report(check_rows(contacts(spark, sf_dir), rules, run_of("contacts")))


TEXT_RULES = [
    ("doc_text_filled", ["text"], "completeness", "critical", 0.0, "is_not_empty(col('text'))",
     "NOT (text IS NULL OR trim(text) = '')"),
    ("doc_length_matches", ["n_chars", "text"], "consistency", "high", 0.0,
     "equals(col('n_chars'), length(col('text')))", "n_chars = length(text)"),
    ("doc_lang_list", ["lang"], "accuracy", "medium", None,
     "is_in_list(col('lang'), ['en', 'fr', 'de'])", "lang IN ('en', 'fr', 'de')"),
    ("doc_mentions_mail", ["text"], "accuracy", "low", None,
     "NOT regex_match(col('text'), '[a-z0-9.]+@[a-z0-9]+[.][a-z]+')",
     "NOT regexp_matches(text, '[a-z0-9.]+@[a-z0-9]+[.][a-z]+')"),
    ("doc_long_enough", ["text"], "accuracy", "low", 40.0, "length_check(col('text'), 200, 100000)",
     "length(trim(text)) BETWEEN 200 AND 100000"),
    ("doc_source_form", ["source"], "accuracy", "low", None, "column RLIKE '^src[0-9]+$'",
     "regexp_matches(source, '^src[0-9]+$')"),
]


@query("document_rules", scorecard_sql("documents", TEXT_RULES))
def document_rules(spark, sf_dir):
    """Rules over whole texts."""
    df = table(spark, sf_dir, "documents")
    return report(check_rows(df, rules_from(TEXT_RULES), run_of("documents")))


EVENT_RULES = [
    ("ev_type_list", ["event_type"], "accuracy", "high", 25.0,
     "is_in_list(col('event_type'), ['click', 'view', 'purchase', 'signup'])",
     "event_type IN ('click', 'view', 'purchase', 'signup')"),
    ("ev_value_range", ["value"], "accuracy", "medium", 5.0,
     "range_check(col('value'), 0.5, 150)", "value BETWEEN 0.5 AND 150"),
    ("ev_json_field", ["props"], "custom", "medium", None,
     "cast(get_json_object(col('props'), '$.k') as int) < 90",
     "CAST(json_extract_string(props, '$.k') AS INT) < 90"),
    ("ev_fresh", ["ts"], "timeliness", "high", 50.0,
     "is_fresh(col('ts'), 14, timestamp'2024-01-31 00:00:00')",
     "date_diff('day', ts, TIMESTAMP '2024-01-31 00:00:00') <= 14"),
    ("ev_age_hours", ["ts"], "timeliness", "low", None,
     "date_diff(timestamp_ntz'2024-01-31 00:00:00', col('ts'), 'hours') <= 480",
     "datesub('hour', ts, TIMESTAMP '2024-01-31 00:00:00') <= 480"),
    ("ev_age_minutes", ["ts"], "timeliness", "low", None,
     "date_diff(timestamp_ntz'2024-01-31 00:00:00', col('ts'), 'minutes') > 600",
     "datesub('minute', ts, TIMESTAMP '2024-01-31 00:00:00') > 600"),
]


@query("event_rules", scorecard_sql("events", EVENT_RULES))
def event_rules(spark, sf_dir):
    """Lists, ranges, JSON fields, freshness and elapsed time on events."""
    df = table(spark, sf_dir, "events")
    return report(check_rows(df, rules_from(EVENT_RULES), run_of("events")))


PAGE_RULES = [
    ("pg_url_scheme", ["url"], "accuracy", "medium", None, "column RLIKE '^https://'",
     "regexp_matches(url, '^https://')"),
    ("pg_url_no_query", ["url"], "custom", "low", 50.0, "NOT column LIKE '%?%'", "NOT url LIKE '%?%'"),
    ("pg_html_doctype", ["html"], "completeness", "low", None,
     "upper(col('html')) LIKE '%<!DOCTYPE HTML>%'", "upper(html) LIKE '%<!DOCTYPE HTML>%'"),
    ("pg_html_length", ["html"], "accuracy", "low", 10.0, "length_check(column, min_length=500)",
     "length(trim(html)) >= 500"),
]


@query("page_rules", scorecard_sql("pages", PAGE_RULES))
def page_rules(spark, sf_dir):
    """Rules over web addresses and whole pages."""
    return report(check_rows(table(spark, sf_dir, "pages"), rules_from(PAGE_RULES), run_of("pages")))


VECTOR_RULES = [
    ("vec_size", ["embedding"], "accuracy", "high", None, "size(col('embedding')) == 64",
     "len(embedding) = 64"),
    ("vec_label_range", ["label"], "accuracy", "low", 40.0, "range_check(column, 0, 4)",
     "label BETWEEN 0 AND 4"),
]


@query("embedding_rules", scorecard_sql("embeddings", VECTOR_RULES))
def embedding_rules(spark, sf_dir):
    """Array length as a rule."""
    df = table(spark, sf_dir, "embeddings")
    return report(check_rows(df, rules_from(VECTOR_RULES), run_of("embeddings")))


FLAGS = {
    "is_null": (lambda: P.is_null(F.col("segment")), "segment IS NULL"),
    "is_not_null": (lambda: P.is_not_null(F.col("segment")), "segment IS NOT NULL"),
    "is_empty": (lambda: P.is_empty(F.col("segment")), "segment IS NULL OR trim(segment) = ''"),
    "is_not_empty": (lambda: P.is_not_empty(F.col("segment")), "NOT (segment IS NULL OR trim(segment) = '')"),
    "length_check": (lambda: P.length_check(F.col("segment"), 8, 9),
                     "coalesce(length(trim(segment)) BETWEEN 8 AND 9, false)"),
    "length_open": (lambda: P.length_check(F.col("segment")), "segment IS NOT NULL"),
    "regex_match": (lambda: P.regex_match(F.col("phone"), r"\d{3}-"), r"regexp_matches(phone, '\d{3}-')"),
    "is_email": (lambda: P.is_email(F.col("email")), EMAIL),
    "is_phone": (lambda: P.is_phone(F.col("phone")), PHONE),
    "is_numeric": (lambda: P.is_numeric(F.col("amount")),
                   "TRY_CAST(amount AS DOUBLE) IS NOT NULL AND NOT isnan(TRY_CAST(amount AS DOUBLE))"),
    "range_check": (lambda: P.range_check(F.col("c_acctbal"), 0, 5000.5, inclusive=False),
                    "c_acctbal > 0 AND c_acctbal < 5000.5"),
    "range_open": (lambda: P.range_check(F.col("c_acctbal")), "c_acctbal IS NOT NULL"),
    "is_in_list": (lambda: P.is_in_list(F.col("c_nationkey"), [1, 2, 3]), "c_nationkey IN (1, 2, 3)"),
    "is_not_in_list": (lambda: P.is_not_in_list(F.col("segment"), [" HOUSEHOLD "]),
                       "segment NOT IN (' HOUSEHOLD ')"),
    "equals": (lambda: P.equals(F.col("c_custkey"), F.col("c_nationkey")), "c_custkey = c_nationkey"),
    "not_equals": (lambda: P.not_equals(F.col("email"), F.col("phone")), "email <> phone"),
    "greater_than": (lambda: P.greater_than(F.col("c_acctbal"), F.col("c_custkey")), "c_acctbal > c_custkey"),
    "less_than": (lambda: P.less_than(F.col("email"), F.col("phone")), "email < phone"),
}


@query(
    "rule_functions",
    "SELECT c_custkey, " + ", ".join(f"({sql}) AS {n}" for n, (_, sql) in FLAGS.items())
    + f" FROM {CONTACTS_SQL}",
)
def rule_functions(spark, sf_dir):
    """Every boolean rule function as a column of each row, nulls kept."""
    flags = [make().alias(n) for n, (make, _) in FLAGS.items()]
    return contacts(spark, sf_dir).select("c_custkey", *flags)


@query(
    "date_functions",
    """SELECT event_id, CAST(date_diff('day', ts, TIMESTAMP '2024-01-31 06:00:00') AS INT) AS days,
 CAST(datesub('hour', ts, TIMESTAMP '2024-01-31 06:00:00') AS BIGINT) AS hours,
 CAST(datesub('minute', ts, TIMESTAMP '2024-01-31 06:00:00') AS BIGINT) AS minutes,
 date_diff('day', ts, TIMESTAMP '2024-01-31 06:00:00') <= 7 AS fresh FROM events""",
)
def date_functions(spark, sf_dir):
    """Differences of dates in days, hours and minutes, and freshness against a fixed time."""
    now, ts = F.expr("timestamp_ntz'2024-01-31 06:00:00'"), F.col("ts")
    return table(spark, sf_dir, "events").select(
        "event_id",
        P.date_diff(now, ts).alias("days"),
        P.date_diff(now, ts, "hours").alias("hours"),
        P.date_diff(now, ts, "minutes").alias("minutes"),
        P.is_fresh(ts, 7, now).alias("fresh"),
    )


@query(
    "predicate_columns",
    "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, "
    + ", ".join(f"coalesce(({s[6]}), false) AS ok_{s[0]}" for s in LINEITEM_RULES[:6])
    + " FROM lineitem",
)
def predicate_columns(spark, sf_dir):
    """A boolean column per rule next to the key of each row."""
    df = with_predicates(table(spark, sf_dir, "lineitem"), rules_from(LINEITEM_RULES[:6]))
    return df.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
        *[f"ok_{s[0]}" for s in LINEITEM_RULES[:6]],
    )


DAILY = EVENT_RULES[:3]


@query(
    "partition_scorecard",
    result_sql(
        "\nUNION ALL ".join(
            counts_sql("events", s, "CAST(ts AS DATE) AS day, ", "GROUP BY CAST(ts AS DATE)")
            for s in DAILY
        ),
        "events",
        "day, ",
    ),
)
def partition_scorecard(spark, sf_dir):
    """One result row per rule and day."""
    df = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    return report(check_rows(df, rules_from(DAILY), run_of("events"), by=["day"]), "day")


@query(
    "validator_calls",
    result_sql(
        "\nUNION ALL ".join(
            counts_sql(CONTACTS_SQL, s)
            for s in [
                ("completeness", [], "completeness", "high", None, "", "NOT (segment IS NULL OR trim(segment) = '')"),
                ("completeness_nulls", [], "completeness", "high", None, "", "segment IS NOT NULL"),
                ("accuracy_range", [], "accuracy", "high", None, "", "c_acctbal >= 0 AND c_acctbal <= 9000"),
                ("accuracy_regex", [], "accuracy", "high", None, "", r"regexp_matches(phone, '^\d+-')"),
                ("accuracy_email", [], "accuracy", "high", None, "", EMAIL),
                ("accuracy_phone", [], "accuracy", "high", None, "", PHONE),
                ("consistency_equals", [], "consistency", "high", None, "", "c_custkey = c_nationkey"),
                ("consistency_not_equals", [], "consistency", "high", None, "", "c_custkey <> c_nationkey"),
                ("consistency_greater_than", [], "consistency", "high", None, "", "c_custkey > c_nationkey"),
                ("consistency_less_than", [], "consistency", "high", None, "", "c_custkey < c_nationkey"),
                ("business_logic", [], "custom", "high", None, "", "c_acctbal > 0 OR c_nationkey < 10"),
            ]
        ),
        "contacts",
    ),
)
def validator_calls(spark, sf_dir):
    """Each validator method, called on its own."""
    df, run = contacts(spark, sf_dir), run_of("contacts")
    one, many = SingleFieldValidator(run), MultiFieldValidator(run)
    keys = ["c_custkey", "c_nationkey"]
    frames = [
        one.validate_completeness(df, "segment"),
        one.validate_completeness(df, "segment", allow_empty_strings=True, rule_id="completeness_nulls"),
        one.validate_accuracy(df, "c_acctbal", "range", min_value=0, max_value=9000),
        one.validate_accuracy(df, "phone", "regex", pattern=r"^\d+-"),
        one.validate_accuracy(df, "email", "email"),
        one.validate_accuracy(df, "phone", "phone"),
        *[many.validate_consistency(df, keys, how)
          for how in ("equals", "not_equals", "greater_than", "less_than")],
        many.validate_business_logic(
            df, "col('c_acctbal') > 0 OR col('c_nationkey') < 10", ["c_acctbal", "c_nationkey"]
        ),
    ]
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return report(out)
