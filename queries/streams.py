"""Events as a stream: what the stream finds must equal what a batch finds."""

from __future__ import annotations

from pyspark.sql import functions as F

from queries.base import RUN_AT, counts_sql, query, report, result_sql, rules_from, run_of, scorecard_sql, table
from queries.row_rules import EVENT_RULES
from veriframe.plans.executor import RuleExecutor
from veriframe.plans.metadata import MetadataTables
from veriframe.session import shared_folder
from veriframe.streaming import checks as S
from veriframe.streaming import windows as W

STREAM_RULES = EVENT_RULES[:3]


def event_stream(spark, sf_dir):
    schema = table(spark, sf_dir, "events").schema
    stream = S.file_stream(spark, sf_dir, schema, glob="events.parquet")
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


@query("stream_split_rows", "SELECT event_id, user_id, event_type, concat_ws(',', "
       + ", ".join(f"CASE WHEN NOT coalesce(({s[6]}), false) THEN '{s[0]}' END" for s in STREAM_RULES)
       + ") AS violated FROM events WHERE NOT ("
       + " AND ".join(f"coalesce(({s[6]}), false)" for s in STREAM_RULES) + ")")
def stream_split_rows(spark, sf_dir):
    """Bad rows of a stream, appended to files."""
    folder = shared_folder(spark, "stream-split")
    _, bad = S.split_stream(event_stream(spark, sf_dir), rules_from(STREAM_RULES))
    wanted = bad.select("event_id", "user_id", "event_type", F.concat_ws(",", "violated").alias("violated"))
    S.catch_up(wanted, f"{folder}/rows", f"{folder}/checkpoint")
    return spark.read.schema(wanted.schema).parquet(f"{folder}/rows")


@query("stream_batch_results", scorecard_sql("events", STREAM_RULES))
def stream_batch_results(spark, sf_dir):
    """Results per batch of the stream, summed up."""
    folder = shared_folder(spark, "stream-results")
    S.check_batches(event_stream(spark, sf_dir), rules_from(STREAM_RULES),
                    f"{folder}/results", f"{folder}/checkpoint", "events")
    return report(S.total_results(S.read_batches(spark, f"{folder}/results"), run_of("events")))


@query("stream_catch_up", scorecard_sql("events", STREAM_RULES))
def stream_catch_up(spark, sf_dir):
    """Two runs from one checkpoint: the second finds nothing new, so nothing counts twice."""
    folder = shared_folder(spark, "stream-catch-up")
    for _ in range(2):
        S.check_batches(event_stream(spark, sf_dir), rules_from(STREAM_RULES),
                        f"{folder}/results", f"{folder}/checkpoint", "events")
    return report(S.total_results(S.read_batches(spark, f"{folder}/results"), run_of("events")))


def window_sql(width_days: int, source: str, start: str) -> str:
    return result_sql("\nUNION ALL ".join(
        counts_sql(source, s, f"{start} AS window_start, ", f"GROUP BY {start}") for s in STREAM_RULES
    ), "events", f"window_start, window_start + INTERVAL {width_days} DAY AS window_end, ")


def _windows(spark, sf_dir, name, width, slide=None):
    folder = shared_folder(spark, name)
    results = S.windowed_results(
        event_stream(spark, sf_dir), rules_from(STREAM_RULES), "ts", width, slide, "1 hour", run_of("events"))
    S.each_batch(results, lambda batch, _: batch, f"{folder}/windows", f"{folder}/checkpoint", "update")
    newest = S.latest_windows(S.read_batches(spark, f"{folder}/windows"))
    times = {c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end")}
    return report(newest.withColumns(times), "window_start", "window_end")


@query("stream_windows", window_sql(1, "events", "CAST(date_trunc('day', ts) AS TIMESTAMP)"))
def stream_windows(spark, sf_dir):
    """Results per rule and day of a stream."""
    return _windows(spark, sf_dir, "stream-windows", "1 day")


@query("stream_sliding_windows", window_sql(
    2, "(SELECT *, unnest([CAST(date_trunc('day', ts) AS TIMESTAMP), "
    "CAST(date_trunc('day', ts) AS TIMESTAMP) - INTERVAL 1 DAY]) AS w FROM events)", "w"))
def stream_sliding_windows(spark, sf_dir):
    """Results per rule in windows of two days that start every day."""
    return _windows(spark, sf_dir, "stream-sliding", "2 days", "1 day")


@query("stream_unique", "SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS window_start, user_id, count(*) AS copies "
       "FROM events GROUP BY ALL HAVING count(*) > 1")
def stream_unique(spark, sf_dir):
    """Users seen more than once on a day of the stream."""
    folder = shared_folder(spark, "stream-unique")
    counts = S.repeated_keys(event_stream(spark, sf_dir), ["user_id"], "ts", "1 day", "1 hour")
    S.each_batch(counts, lambda batch, _: batch, f"{folder}/keys", f"{folder}/checkpoint", "update")
    newest = S.read_batches(spark, f"{folder}/keys").groupBy("window_start", "user_id").agg(
        F.max_by("copies", "batch_id").alias("copies"))
    return newest.where("copies > 1").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("stream_first_rows", "SELECT count(DISTINCT user_id) AS users, count(DISTINCT user_id) AS row_count FROM events")
def stream_first_rows(spark, sf_dir):
    """One row per user out of the stream, with a watermark that remembers all of them."""
    folder = shared_folder(spark, "stream-first")
    first = S.first_rows(event_stream(spark, sf_dir), ["user_id"], "ts", "400 days", salts=4).select("user_id")
    S.catch_up(first, f"{folder}/rows", f"{folder}/checkpoint")
    rows = spark.read.schema(first.schema).parquet(f"{folder}/rows")
    return rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).agg(
        F.count(F.lit(1)).alias("users"), F.sum("n").alias("row_count"))


@query("stream_foreign_key", "SELECT *, NOT EXISTS (SELECT 1 FROM customer c "
       "WHERE c.c_custkey = e.user_id AND c.c_acctbal > 1000) AS is_orphan FROM events e")
def stream_foreign_key(spark, sf_dir):
    """Events whose user is not among the customers with some money."""
    folder = shared_folder(spark, "stream-orphans")
    parent = table(spark, sf_dir, "customer").where("c_acctbal > 1000")
    keys = S.store_keys(parent, ["c_custkey"], f"{folder}/keys")
    S.mark_orphans_per_batch(
        event_stream(spark, sf_dir), keys, ["user_id"], ["c_custkey"], f"{folder}/rows", f"{folder}/checkpoint")
    rows = S.read_batches(spark, f"{folder}/rows").drop("batch_id")
    return rows.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


# Events in ten files by number; every tenth event comes up to six files later than its neighbours.
ARRIVALS = 10
ARRIVAL = "least({n} - 1, event_id {div} ((SELECT max(event_id) FROM events) {div} {n} + 1) + CASE WHEN event_id % 10 = 3 THEN event_id % 7 ELSE 0 END)"
ARRIVAL_SQL = ARRIVAL.format(n=ARRIVALS, div="//")
LATE_SQL = f"""WITH arrived AS (SELECT *, {ARRIVAL_SQL} AS batch_id FROM events),
newest AS (SELECT batch_id, max(max(ts)) OVER (ORDER BY batch_id) AS newest FROM arrived GROUP BY batch_id),
marks AS (SELECT batch_id, lag(newest) OVER (ORDER BY batch_id) - INTERVAL 12 HOUR AS watermark, newest FROM newest),
timed AS (SELECT *, CAST(date_trunc('day', ts) AS TIMESTAMP) AS w, coalesce(date_trunc('day', ts) + INTERVAL 1 DAY <= watermark, false) AS late
  FROM arrived JOIN marks USING (batch_id))"""


def _late_stream(spark, sf_dir):
    """The events in files that arrive one after another, checked by day with twelve hours of patience."""
    folder = shared_folder(spark, "stream-late")
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    span = events.agg(F.max("event_id")).first()[0] // ARRIVALS + 1
    late = F.when(F.col("event_id") % 10 == 3, F.col("event_id") % 7).otherwise(0)
    arrival = F.least(F.lit(ARRIVALS - 1), F.floor(F.col("event_id") / span) + late)
    arrived = events.withColumn("arrival", arrival)
    for i in range(ARRIVALS):
        arrived.where(F.col("arrival") == i).drop("arrival").write.parquet(f"{folder}/in/{i}")
        stream = S.file_stream(spark, f"{folder}/in/*", events.schema)
        W.check_windows(stream, rules_from(STREAM_RULES), "ts", "1 day", f"{folder}/out", f"{folder}/checkpoint", late_by="12 hours")
    return f"{folder}/out"


@query("stream_late_rows", LATE_SQL + """ SELECT batch_id, count(*) AS row_count, count(*) FILTER (WHERE late) AS late_rows,
  any_value(watermark) AS watermark, any_value(newest) AS newest FROM timed GROUP BY batch_id""")
def stream_late_rows(spark, sf_dir):
    """How many events of each batch came after their day had been closed."""
    log = W.batch_log(spark, _late_stream(spark, sf_dir))
    times = {c: F.col(c).cast("timestamp_ntz") for c in ("watermark", "newest")}
    return log.drop("rows_without_time").withColumn("batch_id", F.col("batch_id").cast("bigint")).withColumns(times)


@query("stream_late_windows", LATE_SQL + result_sql("\nUNION ALL ".join(
    counts_sql("timed", s, "w AS window_start, ", "WHERE NOT late GROUP BY w") for s in STREAM_RULES
), "events", "window_start, window_start + INTERVAL 1 DAY AS window_end, ").replace("WITH counts", ", counts", 1))
def stream_late_windows(spark, sf_dir):
    """Results per rule and day, without events that came after their day had been closed."""
    results = W.window_results(spark, _late_stream(spark, sf_dir), run_of("events"))
    times = {c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end")}
    return report(results.withColumns(times), "window_start", "window_end")


@query("stream_two_assignments", "SELECT * REPLACE ('events' AS table_name) FROM ("
       + scorecard_sql("events", [(f"as-{c}", [c], "accuracy", "high", 5.0, "", f"length(CAST({c} AS VARCHAR)) >= 3") for c in ("event_type", "user_id")])
       + ")")
def stream_two_assignments(spark, sf_dir):
    """One rule on two columns of a stream; its batches are runs in the results table and the log."""
    root = shared_folder(spark, "stream-assigned")
    for i in range(2):
        table(spark, sf_dir, "events").where(F.col("event_id") % 2 == i).write.mode("append").parquet(f"{root}/data/events")
    tables = MetadataTables(spark, f"{root}/rules")
    tables.append_rows("data_sources", [{
        "source_id": "lake", "source_name": "Lake", "source_type": "s3", "connection_config": {"root": f"{root}/data"},
        "is_active": True, "created_at": RUN_AT}])
    tables.append_rows("validation_rules", [{
        "rule_id": "three_long", "rule_name": "three long", "rule_type": "single_field", "rule_category": "accuracy", "severity_level": "high",
        "threshold_value": 5.0, "rule_logic": "length(cast(column as string)) >= 3", "created_by": "admin", "version": 1, "is_active": True,
        "created_at": RUN_AT}])
    tables.append_rows("rule_assignments", [{
        "assignment_id": f"as-{c}", "rule_id": "three_long", "source_id": "lake", "table_name": "events", "column_names": [c],
        "execution_frequency": "streaming", "is_active": True, "priority_order": 1, "created_at": RUN_AT} for c in ("event_type", "user_id")])
    executor = RuleExecutor(tables)
    for _ in range(2):  # the second call finds nothing new and publishes nothing twice
        executor.execute_stream(["as-event_type", "as-user_id"], files_per_batch=1)
    done = tables.read("execution_logs").where("status = 'completed'").groupBy("assignment_id").agg(F.sum("records_processed").alias("_logged"))
    stored = tables.read("validation_results").join(done, "assignment_id")
    # counts that are not in the log, too, would show as rows without a partner
    total = S.total_results(stored, run_of("events")).join(done, "assignment_id").where("records_checked = _logged")
    return report(total.withColumn("rule_id", F.col("assignment_id")))
