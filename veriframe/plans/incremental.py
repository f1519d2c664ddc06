"""Checking only the files that a rule has not seen, with results that hold for the whole table.

What was counted is kept by file, time of its last change, assignment and version of the rule. A run
lists the files, reads those for which some rule has no count, groups rules that miss the same
files into one scan, and adds up the counts of the files that are there now. So a new rule, or a rule
whose text has changed, sees old files, a file that was replaced or deleted counts as it is now, and
nothing is read twice for the same rule.
"""

from __future__ import annotations

import hashlib
import json
import logging
import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from veriframe.errors import RuleError
from veriframe.operators.results import Run, error_rows, finish, spread_counts
from veriframe.operators.row_checks import count_violations, resolve
from veriframe.plans.executor import RuleExecutor, about_rules, first_line, rule_of, utc_now
from veriframe.plans.rules import Rule
from veriframe.sources.connectors import create_source

log = logging.getLogger(__name__)

FILE_KEY = ["file_path", "modified"]


def rule_version(rule: Rule) -> str:
    """Digest of all that decides which rows violate a rule."""
    parts = [rule.rule_logic, rule.columns, rule.rule_type, rule.null_policy, sorted(rule.options.items())]
    return hashlib.sha256(json.dumps(parts).encode()).hexdigest()


class FileRuns:
    """Runs assigned row rules on tables of files, reading each file once for each version of a rule."""

    def __init__(self, executor: RuleExecutor):
        self.executor, self.tables, self.spark = executor, executor.tables, executor.spark

    def execute(self, assignment_ids: Sequence[str], execution_id: str | None = None) -> DataFrame:
        """Result rows for the whole tables, one per assignment; stored in the results table, too.

        A rule that fails on some value is an error row; its files stay unseen and come again.
        """
        run_id = execution_id or str(uuid.uuid4())
        groups: dict[tuple, list[Row]] = {}
        for row in self.executor._resolved(assignment_ids):
            groups.setdefault((row.source_id, row.schema_name, row.table_name), []).append(row)
        if not groups:
            raise RuleError("none of the assignments is active")
        frames = [self._run_table(group, run_id) for group in groups.values()]
        results = reduce(DataFrame.unionByName, frames)
        self.tables.append("validation_results", results)
        return self.tables.read("validation_results").where(F.col("run_id") == run_id)

    def _run_table(self, group: list[Row], run_id: str) -> DataFrame:
        first = group[0]
        source = create_source(first.source_type, first.connection_config, self.spark)
        if not hasattr(source, "read_files"):
            raise RuleError(f"tables of {first.source_type} have no files")
        rules = [rule_of(row) for row in group]
        if any(r.check != "row" for r in rules):
            raise RuleError("only rules about a row can be counted by file")
        run = Run(run_id=run_id, at=utc_now(), table_name=first.table_name)
        files = source.list_files(first.table_name)
        versions = {r.assignment_id: rule_version(r) for r in rules}
        good, bad = resolve(source.read_data(table=first.table_name), rules)
        for chosen, paths in self._unseen(files, first, [r for r, _ in good], versions):
            bad += self._count(source, first, [(r, p) for r, p in good if r.assignment_id in chosen], paths, versions)
        wrong = {r.assignment_id for r, _ in bad}
        frames = [self._totals(files, first, [r for r, _ in good if r.assignment_id not in wrong], versions, run)]
        if bad:
            frames.append(finish(error_rows(self.spark, bad), run))
        return reduce(DataFrame.unionByName, [f for f in frames if f is not None])

    def _seen(self, table: Row) -> DataFrame:
        """Counts of this table by file and rule; a count that was stored twice is the same twice."""
        same = F.col("source_id").eqNullSafe(table.source_id) & F.col("schema_name").eqNullSafe(table.schema_name)
        return self.tables.read("file_counts").where(same & (F.col("table_name") == table.table_name)).dropDuplicates(
            [*FILE_KEY, "assignment_id", "rule_version"])

    def _wanted(self, files: DataFrame, rules: Sequence[Rule], versions: dict[str, str]) -> DataFrame:
        """Every file with every rule."""
        each = F.array(*[
            F.struct(F.lit(r.assignment_id).alias("assignment_id"), F.lit(versions[r.assignment_id]).alias("rule_version")) for r in rules])
        return files.select("*", F.inline(each))

    def _unseen(self, files: DataFrame, table: Row, rules: Sequence[Rule], versions: dict[str, str]) -> list[tuple[set, list[str]]]:
        """(assignments, paths) of files that these assignments have not seen; the paths are those Spark is told to read."""
        if not rules:
            return []
        key = [*FILE_KEY, "assignment_id", "rule_version"]
        missing = self._wanted(files, rules, versions).join(self._seen(table).select(*key), key, "left_anti")
        by_file = missing.groupBy("path").agg(F.sort_array(F.collect_set("assignment_id")).alias("assignments"))
        sets = by_file.groupBy("assignments").agg(F.sort_array(F.collect_list("path")).alias("paths")).collect()
        return [(set(r.assignments), r.paths) for r in sets]

    def _count(self, source, table: Row, good, paths: list[str], versions: dict[str, str]) -> list[tuple[Rule, str]]:
        """Count rules on files and store the counts; returns rules that fail on some value, with the reason."""
        try:
            read = source.read_files(table.table_name, paths)
            counts = count_violations(read, good, ["_file_path", "_file_modified"])
            entries = [(rule, "checked", f"failed_{i}") for i, (rule, _) in enumerate(good)]
            rows = spread_counts(counts, entries, by=["_file_path", "_file_modified"]).select(
                F.col("_file_path").alias("file_path"), F.col("_file_modified").alias("modified"),
                "assignment_id", "records_checked", "records_failed")
            # files without rows have counts, too
            every = self._wanted(source.list_files(table.table_name).where(F.col("path").isin(paths)), [r for r, _ in good], versions)
            counted = every.join(rows, [*FILE_KEY, "assignment_id"], "left").fillna(0, ["records_checked", "records_failed"])
            self.tables.append("file_counts", counted.withColumns({
                "source_id": F.lit(table.source_id), "schema_name": F.lit(table.schema_name), "table_name": F.lit(table.table_name)}))
            return []
        except Exception as e:
            if not about_rules(e):
                raise
            if len(good) == 1:
                return [(good[0][0], first_line(e))]
            log.info("a rule fails on some value, counting %d rules in two parts", len(good))
            middle = len(good) // 2
            return self._count(source, table, good[:middle], paths, versions) + self._count(source, table, good[middle:], paths, versions)

    def _totals(self, files: DataFrame, table: Row, rules: Sequence[Rule], versions: dict[str, str], run: Run) -> DataFrame | None:
        """Result rows out of the counts of the files that are there now."""
        if not rules:
            return None
        key = [*FILE_KEY, "assignment_id", "rule_version"]
        counts = self._wanted(files, rules, versions).join(self._seen(table).select(*key, "records_checked", "records_failed"), key)
        places = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.assignment_id), F.lit(i))])
        wide = counts.withColumn("_place", places[F.col("assignment_id")]).agg(*[
            F.coalesce(F.sum(F.when(F.col("_place") == i, F.col(c))), F.lit(0)).alias(f"{c}_{i}")
            for i in range(len(rules)) for c in ("records_checked", "records_failed")])
        return finish(spread_counts(wide, [(r, f"records_checked_{i}", f"records_failed_{i}") for i, r in enumerate(rules)]), run)
