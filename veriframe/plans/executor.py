"""Runs assigned rules: one plan per table, results and violations stored, errors isolated."""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import logging
import time
import urllib.parse
import uuid
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor, as_completed
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from veriframe.errors import RuleError
from veriframe.functions.ruletext import first_line
from veriframe.operators.cross_table import check_cross_table, check_totals
from veriframe.operators.freshness import check_freshness, rows_since
from veriframe.operators.integrity import check_foreign_key, check_primary_key, check_unique
from veriframe.operators.results import Run, error_rows, finish
from veriframe.operators.row_checks import check_rows, resolve
from veriframe.operators.samples import SAMPLE_SIZE, sample_violations
from veriframe.plans.analytics import lineage_rows
from veriframe.plans.metadata import MetadataTables, resolve_assignments
from veriframe.plans.rules import Rule
from veriframe.sources.connectors import create_source
from veriframe.streaming.checks import check_batches, read_batches

log = logging.getLogger(__name__)


def utc_now() -> dt.datetime:
    """The moment with its zone, so that neither the driver's nor the session's zone shifts it."""
    return dt.datetime.now(dt.UTC)


def rule_of(row: Row) -> Rule:
    """The rule of a resolved assignment."""
    return Rule(
        rule_id=row.rule_id,
        rule_name=row.rule_name,
        rule_logic=row.rule_logic,
        columns=tuple(row.column_names),
        rule_type=row.rule_type,
        rule_category=row.rule_category,
        severity_level=row.severity_level,
        threshold_value=row.threshold_value,
        assignment_id=row.assignment_id,
        null_policy=(row.additional_config or {}).get("null_policy") or "fail",
        options=dict(row.additional_config or {}),
    )


def _list(text: str | None) -> list[str]:
    return [part.strip() for part in (text or "").split(",") if part.strip()]


def check_table(
    df: DataFrame, rules: Sequence[Rule], run: Run, parent: Callable[[Rule], DataFrame]
) -> DataFrame:
    """Result rows of all rules of one table.

    Row rules share one scan, cross-table rules over the same parent one join. `parent` finds the
    other table of a foreign-key, cross-table or reconcile rule.
    """
    frames, bad = [], []
    row_rules = [r for r in rules if r.check == "row"]
    single = [r for r in row_rules if r.rule_type == "single_field" and len(r.columns) != 1]
    bad += [(r, "a single-field rule needs exactly one column") for r in single]
    row_rules = [r for r in row_rules if r not in single]
    if row_rules:
        frames.append(check_rows(df, row_rules, run))
    crossed: dict[tuple, list[Rule]] = {}
    for rule in rules:
        try:
            if rule.check == "unique":
                frames.append(check_unique(df, rule, run))
            elif rule.check == "primary_key":
                frames.append(check_primary_key(df, rule, run))
            elif rule.check == "foreign_key":
                keys = _list(rule.options["parent_columns"])
                frames.append(check_foreign_key(df, parent(rule), keys, rule, run))
            elif rule.check == "freshness":
                days = int(rule.options["max_age_days"])
                frames.append(check_freshness(df, rule, days, run=run))
            elif rule.check == "reconcile":
                frames.append(check_totals(
                    df, parent(rule), _list(rule.options["keys"]), _list(rule.options["parent_columns"]),
                    F.expr(rule.options["value"]), F.expr(rule.options["parent_value"]), rule, run,
                    float(rule.options.get("tolerance") or 0.005),
                ))
            elif rule.check == "cross_table":
                name = tuple(rule.options.get(k) for k in
                             ("parent_source", "parent_schema", "parent_table", "keys", "parent_columns"))
                crossed.setdefault(name, []).append(rule)
            elif rule.check != "row":
                bad.append((rule, f"unknown check: {rule.check}"))
        except Exception as e:
            bad.append((rule, _first_line(e)))
    for group in crossed.values():
        try:
            first = group[0].options
            frames.append(check_cross_table(
                df, parent(group[0]), _list(first["keys"]), _list(first["parent_columns"]), group, run
            ))
        except Exception as e:
            bad += [(rule, _first_line(e)) for rule in group]
    if bad:
        frames.append(finish(error_rows(df.sparkSession, bad), run))
    return reduce(DataFrame.unionByName, frames)


# Conditions of the engine or of storage, not of a rule.
_NOT_ABOUT_RULES = ("FAILED_READ_FILE", "FAILED_JDBC", "INTERNAL_ERROR", "TASK_WRITE_FAILED", "UNABLE_TO_ACQUIRE_MEMORY")


def about_rules(e: Exception) -> bool:
    """Whether an error comes from a rule and its data, not from a lost executor or an unreadable file."""
    if isinstance(e, PySparkException):
        condition = e.getCondition()
        return condition is not None and not condition.startswith(_NOT_ABOUT_RULES)
    return isinstance(e, (RuleError, KeyError, ValueError))


def _folder(value: str | None) -> str:
    """A value as the name of a partition's folder, in the way Spark reads it back."""
    return "__HIVE_DEFAULT_PARTITION__" if not value else urllib.parse.quote(value, safe="")


def _first_line(e: Exception) -> str:
    if isinstance(e, KeyError):
        return f"missing in additional_config: {e.args[0]}"
    return first_line(e)


class RuleExecutor:
    """Runs assignments found in the rule tables against their sources."""

    def __init__(self, tables: MetadataTables, spark: SparkSession | None = None):
        self.tables = tables
        self.spark = spark or tables.spark

    def load_rules_metadata(self, assignment_id: str) -> Row:
        """The assignment with its rule and source, active or not."""
        found = self._resolved([assignment_id], active_only=False)
        if not found:
            raise RuleError(f"assignment not found: {assignment_id}")
        return found[0]

    def execute_assignment(
        self, assignment_id: str, execution_id: str | None = None, sample_size: int = SAMPLE_SIZE
    ) -> Row:
        """Run one assignment; returns its result row. Inactive rules and assignments are refused."""
        row = self.load_rules_metadata(assignment_id)
        if not row.is_active:
            raise RuleError(f"assignment is not active: {assignment_id}")
        if not row.rule_is_active:
            raise RuleError(f"rule is not active: {row.rule_id}")
        return self.execute_batch([assignment_id], execution_id, sample_size).first()

    def execute_batch(
        self,
        assignment_ids: Sequence[str],
        execution_id: str | None = None,
        sample_size: int = SAMPLE_SIZE,
        since: dict[str, tuple[str, object]] | None = None,
        max_parallel: int = 5,
    ) -> DataFrame:
        """Run assignments table by table; a rule or table that fails does not stop the others.

        Up to `max_parallel` tables are checked at the same time. Returns the result rows in order
        of priority, then newest assignment first. `since` maps a table name to (column, last
        checked value) to validate newer rows only.
        """
        run_id = execution_id or str(uuid.uuid4())
        resolved = self._resolved(assignment_ids)
        skipped = sorted(set(assignment_ids) - {r.assignment_id for r in resolved})
        if skipped:
            log.warning("not found or not active, skipped: %s", ", ".join(skipped))
        tables: dict[tuple, list[Row]] = {}
        for row in resolved:
            tables.setdefault((row.source_id, row.schema_name, row.table_name), []).append(row)
        rows = []
        with ThreadPoolExecutor(max(1, max_parallel)) as pool:
            running = {}
            for (_, _, name), group in tables.items():
                self._log(group, run_id, "running", utc_now())
                job = (name, group, run_id, sample_size, (since or {}).get(name))
                running[pool.submit(self._run_table, *job)] = group
            # Only this thread appends to the shared tables, as soon as a table is done.
            for done in as_completed(running):
                made = done.result()
                self.tables.append_rows("validation_results", made)
                self._log(running[done], run_id, None, utc_now(), {r["assignment_id"]: r for r in made})
                rows += made
        if not rows:
            return self.tables.read("validation_results").limit(0)
        order = {r.assignment_id: i for i, r in enumerate(resolved)}
        rows.sort(key=lambda r: order[r["assignment_id"]])
        schema = StructType.fromDDL(self.tables.schema("validation_results"))
        results = self.spark.createDataFrame([tuple(r[c] for c in schema.names) for r in rows], schema)
        self.tables.append("data_lineage", lineage_rows(results))
        return results

    def execute_stream(
        self, assignment_ids: Sequence[str], files_per_batch: int | None = None
    ) -> DataFrame:
        """Check the files that are new since the last call, batch by batch.

        For row rules on tables of files. Returns the result rows of all batches so far, with
        `batch_id`; a batch that is repeated after a failure is stored once. Every batch is a run of
        its own in the results table, the log and the lineage.
        """
        tables: dict[tuple, list[Row]] = {}
        for row in self._resolved(assignment_ids):
            tables.setdefault((row.source_id, row.schema_name, row.table_name), []).append(row)
        if not tables:
            raise RuleError("none of the assignments is active")
        stored = []
        for (source_id, schema_name, name), group in tables.items():
            source = create_source(group[0].source_type, group[0].connection_config, self.spark)
            if not hasattr(source, "read_stream"):
                raise RuleError(f"tables of {group[0].source_type} cannot be read as a stream")
            rules = [rule_of(row) for row in group]
            # The checkpoint belongs to the table and the set of its assignments: every file is read
            # once for each set, so that a second set sees the earlier files, too.
            chosen = json.dumps([schema_name, sorted({row.assignment_id for row in group})])
            digest = hashlib.sha256(chosen.encode()).hexdigest()[:32]
            folder = self.tables.path(f"streams/{source_id}/{name}/{digest}")
            check_batches(
                source.read_stream(name, files_per_batch), rules, f"{folder}/results",
                f"{folder}/checkpoint", name,
            )
            results = read_batches(self.spark, f"{folder}/results")
            if results is not None:
                self._publish(results, f"{digest}-", source_id)
                stored.append(results)
        if not stored:
            return self.tables.read("validation_results").withColumn("batch_id", F.lit(0)).limit(0)
        return reduce(DataFrame.unionByName, stored)

    def _publish(self, batches: DataFrame, prefix: str, source_id: str) -> None:
        """Add the batches' results, states and lineage to the tables, those that are not there yet.

        Every table is looked up by itself, so a publication that broke off is completed by the next.
        """
        runs = batches.drop("batch_id").withColumn("run_id", F.concat(F.lit(prefix), "run_id"))
        done = F.when(F.col("status") == "error", "failed").otherwise("completed")
        events = runs.select(
            "run_id", "assignment_id", F.lit("streaming").alias("execution_type"), F.lit(source_id).alias("source_id"),
            done.alias("status"), F.col("validation_timestamp").alias("event_time"),
            F.col("records_checked").alias("records_processed"), "error_message")
        for name, rows, key in (("validation_results", runs, ["run_id", "assignment_id"]),
                                ("execution_logs", events, ["run_id", "assignment_id"]),
                                ("data_lineage", lineage_rows(runs), ["run_id", "table_name"])):
            there = self.tables.read(name).where(F.col("run_id").startswith(prefix)).select(*key).distinct()
            self.tables.append(name, rows.join(there, key, "left_anti"))

    def _resolved(self, assignment_ids: Sequence[str], active_only: bool = True) -> list[Row]:
        """Rule text is needed on the driver; there is one row per requested assignment."""
        wanted = self.tables.read("rule_assignments").where(
            F.col("assignment_id").isin(list(assignment_ids))
        )
        found = resolve_assignments(
            wanted, self.tables.read("validation_rules"), self.tables.read("data_sources"), active_only
        )
        return found.orderBy("priority_order", F.desc("created_at"), "assignment_id").collect()

    def _read(self, row: Row, table: str, schema: str | None) -> DataFrame:
        source = create_source(row.source_type, row.connection_config, self.spark)
        return source.read_data(table=table, schema=schema)

    def _run_table(self, name, group, run_id, sample_size, since) -> list[dict]:
        clock = time.monotonic()
        run = Run(run_id=run_id, at=utc_now(), table_name=name)
        rules = [rule_of(row) for row in group]

        def parent(rule: Rule) -> DataFrame:
            other = rule.options.get("parent_source")
            row = self._source(other) if other else group[0]
            return self._read(row, rule.options["parent_table"], rule.options.get("parent_schema"))

        try:
            df = self._read(group[0], name, group[0].schema_name)
            if since is not None:
                df = rows_since(df, *since)
            # One row per rule, so this is a handful of rows.
            results = self._collect(df, rules, run, parent)
            self._store_samples(df, rules, run, sample_size, group[0])
        except Exception as e:
            log.exception("table %s could not be checked", name)
            results = finish(error_rows(self.spark, [(r, _first_line(e)) for r in rules]), run).collect()
        took = int((time.monotonic() - clock) * 1000)
        return [{**r.asDict(), "execution_duration_ms": took} for r in results]

    def _collect(self, df, rules, run, parent) -> list[Row]:
        try:
            return check_table(df, rules, run, parent).collect()
        except Exception as e:
            if not about_rules(e):
                raise  # a lost executor or a file that cannot be read says nothing about a rule
            if len(rules) == 1:
                return finish(error_rows(self.spark, [(rules[0], _first_line(e))]), run).collect()
            # A rule that fails on some value stops the shared scan: find it, keep the others.
            middle = len(rules) // 2
            return self._collect(df, rules[:middle], run, parent) + self._collect(
                df, rules[middle:], run, parent
            )

    def _store_samples(self, df, rules, run, sample_size, table: Row) -> None:
        row_rules, _ = resolve(df, [r for r in rules if r.check == "row"])
        if not sample_size or not row_rules:
            return
        sampled = [rule for rule, _ in row_rules]
        key = list(dict.fromkeys(c for r in sampled for c in r.columns if c in df.columns))
        if not key:
            return
        try:
            samples = sample_violations(df, sampled, key, sample_size, run=run)
            # A folder per source, schema, table and run: tables are sampled at the same time.
            parts = {"source_id": table.source_id, "schema_name": table.schema_name, "table_name": run.table_name, "run_id": run.run_id}
            folder = "/".join(["violations", *(f"{k}={_folder(v)}" for k, v in parts.items())])
            samples.drop("run_id").write.mode("overwrite").partitionBy("run_date", "rule_id").parquet(
                self.tables.path(folder)
            )
        except Exception as e:
            log.warning("no sample of violations of %s: %s", run.table_name, _first_line(e))

    def _source(self, source_id: str) -> Row:
        found = self.tables.read("data_sources").where(F.col("source_id") == source_id).first()
        if found is None:
            raise RuleError(f"data source not found: {source_id}")
        return found

    def _log(self, group, run_id, status, at, results=None) -> None:
        events = []
        for row in group:
            result = (results or {}).get(row.assignment_id)
            state = status or ("failed" if result is None or result["status"] == "error" else "completed")
            events.append({
                "run_id": run_id,
                "assignment_id": row.assignment_id,
                "execution_type": row.execution_frequency,
                "source_id": row.source_id,
                "status": state,
                "event_time": at,
                "records_processed": result["records_checked"] if result else None,
                "error_message": result["error_message"] if result else None,
            })
        self.tables.append_rows("execution_logs", events)
