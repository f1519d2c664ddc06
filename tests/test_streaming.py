import datetime as dt
import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from veriframe.operators.results import Run
from veriframe.operators.row_checks import check_rows
from veriframe.plans.rules import Rule
from veriframe.streaming import checks as S
from veriframe.streaming import windows as W

SCHEMA = "k bigint, x int, ts timestamp"
RULES = [Rule("small", "x < 5", ("x",)), Rule("key", "is_not_null(k)", ("k",))]
START = dt.datetime(2024, 1, 1)


def write_file(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))


def rows_of(n, start=0, minutes=10):
    return [(i % 7 if i % 5 else None, i % 10, START + dt.timedelta(minutes=minutes * i)) for i in range(start, start + n)]


@pytest.fixture
def stream(spark, tmp_path):
    folder = tmp_path / "in"
    write_file(spark, folder, rows_of(40))
    write_file(spark, folder, rows_of(40, 40))
    return S.file_stream(spark, str(folder), SCHEMA, files_per_batch=1)


def test_batches_add_up_to_one_batch(spark, stream, tmp_path):
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")
    S.check_batches(stream, RULES, out, checkpoint, "t")
    stored = S.read_batches(spark, out)
    assert stored.select("batch_id").distinct().count() == 2
    whole = spark.createDataFrame(rows_of(80), SCHEMA)
    want = {r.rule_id: (r.records_checked, r.records_failed, r.status) for r in check_rows(whole, RULES, Run()).collect()}
    got = {r.rule_id: (r.records_checked, r.records_failed, r.status) for r in S.total_results(stored).collect()}
    assert got == want
    # New files only: a later run goes on where this one stopped.
    write_file(spark, tmp_path / "in", rows_of(10, 80))
    S.check_batches(stream, RULES, out, checkpoint, "t")
    total = S.total_results(S.read_batches(spark, out)).where("rule_id = 'small'").first()
    assert total.records_checked == 90


def test_split(spark, stream, tmp_path):
    good, bad = S.split_stream(stream, RULES)
    S.catch_up(good, str(tmp_path / "good"), str(tmp_path / "cp1"))
    S.catch_up(bad, str(tmp_path / "bad"), str(tmp_path / "cp2"))
    kept, held = spark.read.parquet(str(tmp_path / "good")), spark.read.parquet(str(tmp_path / "bad"))
    assert kept.count() + held.count() == 80
    assert kept.where("x >= 5 OR k IS NULL").count() == 0
    assert held.where("size(violated) = 0").count() == 0


def test_no_batch_yet(spark, tmp_path):
    assert S.read_batches(spark, str(tmp_path / "none")) is None


def test_windows_and_late_rows(spark, tmp_path):
    folder = tmp_path / "in"
    write_file(spark, folder, rows_of(60))
    stream = S.file_stream(spark, str(folder), SCHEMA, files_per_batch=1)

    def run():
        results = S.windowed_results(stream, RULES, "ts", "1 hour", late_by="30 minutes")
        return S.each_batch(results, lambda b, _: b, str(tmp_path / "w"), str(tmp_path / "cp"), "update")

    run()
    newest = S.latest_windows(S.read_batches(spark, str(tmp_path / "w")))
    assert newest.where("rule_id = 'small'").agg(F.sum("records_checked")).first()[0] == 60
    assert {r.records_checked for r in newest.where("rule_id = 'key'").collect()} == {6}
    # Three rows far behind the watermark are dropped.
    write_file(spark, folder, [(1, 1, START)] * 3)
    run()
    newest = S.latest_windows(S.read_batches(spark, str(tmp_path / "w")))
    assert newest.where("rule_id = 'small'").agg(F.sum("records_checked")).first()[0] == 60


def test_keys_on_a_stream(spark, stream, tmp_path):
    counts = S.repeated_keys(stream, ["k"], "ts", "1 day", "1 day")
    S.each_batch(counts, lambda b, _: b, str(tmp_path / "k"), str(tmp_path / "cp"), "update")
    newest = S.read_batches(spark, str(tmp_path / "k")).groupBy("window_start", "k").agg(
        F.max_by("copies", "batch_id").alias("copies"), F.max_by("is_violation", "batch_id").alias("bad"))
    want = spark.createDataFrame(rows_of(80), SCHEMA).dropna().groupBy("k").count()
    assert newest.agg(F.sum("copies")).first()[0] == want.agg(F.sum("count")).first()[0]
    assert newest.where("bad <> (copies > 1)").count() == 0
    first = S.first_rows(stream.dropna(), ["k"], "ts", "2 days").select("k")
    S.catch_up(first, str(tmp_path / "f"), str(tmp_path / "cp2"))
    assert spark.read.parquet(str(tmp_path / "f")).count() == 7


def test_orphans_on_a_stream(spark, stream, tmp_path):
    parent = spark.createDataFrame([(0,), (1,), (1,), (None,)], "id bigint")
    marked = S.mark_orphans(stream, parent, ["k"], ["id"], frequent=[])
    S.catch_up(marked, str(tmp_path / "o"), str(tmp_path / "cp"))
    rows = spark.read.parquet(str(tmp_path / "o"))
    assert rows.count() == 80
    orphans = sum(k not in (0, 1, None) for k, _, _ in rows_of(80))
    assert rows.where("is_orphan").count() == orphans
    keys = S.store_keys(parent, ["id"], str(tmp_path / "keys"))
    assert keys.count() == 2
    S.mark_orphans_per_batch(stream, keys, ["k"], ["id"], str(tmp_path / "b"), str(tmp_path / "cp3"))
    batches = S.read_batches(spark, str(tmp_path / "b"))
    assert batches.count() == 80 and batches.where("is_orphan").count() == orphans


def late_by_hand(batches, width, slide, delay):
    """(rows, without time, late) of each batch, and rows checked by window, row by row."""
    newest, log, windows = None, [], {}
    for rows in batches:
        watermark = None if newest is None else newest - delay
        late = none = 0
        for _, x, ts in rows:
            if ts is None:
                none += 1
                continue
            last = EPOCH + (ts - EPOCH) // slide * slide
            starts = [last - k * slide for k in range(-(-width // slide)) if last - k * slide > ts - width]
            open_ = [s for s in starts if watermark is None or s + width > watermark]
            late += not open_
            for s in open_:
                checked, failed = windows.get(s, (0, 0))
                windows[s] = (checked + 1, failed + (x is None or x >= 5))
        log.append((len(rows), none, late))
        times = [ts for _, _, ts in rows if ts is not None]
        newest = max([*times, *([newest] if newest else [])], default=None)
    return log, windows


EPOCH = dt.datetime(1970, 1, 1)
MINUTE = dt.timedelta(minutes=1)


@pytest.mark.parametrize("width, slide", [(60, 60), (60, 20), (50, 20)])
def test_late_rows_row_by_row(spark, tmp_path, width, slide):
    folder, out = tmp_path / "in", str(tmp_path / "out")
    batches = [
        [(1, i % 10, START + i * 7 * MINUTE) for i in range(30)] + [(1, 1, None)],
        [(2, i % 10, START + (i * 11 - 100) * MINUTE) for i in range(40)],
        [(3, 9, START), (3, 1, START - 5000 * MINUTE), (3, None, START + 300 * MINUTE)],
        [(4, 1, None), (4, 2, None)],
        [(5, i % 10, START + (400 - i * 13) * MINUTE) for i in range(40)],
    ]
    stream = None
    for rows in batches:  # each run goes on where the last one stopped
        write_file(spark, folder, rows)
        stream = stream or S.file_stream(spark, str(folder), SCHEMA)
        W.check_windows(stream, RULES[:1], "ts", f"{width} minutes", out, str(tmp_path / "cp"), f"{slide} minutes", "30 minutes")
    log, windows = late_by_hand(batches, width * MINUTE, slide * MINUTE, 30 * MINUTE)
    got = W.batch_log(spark, out).orderBy("batch_id").collect()
    assert [(r.row_count, r.rows_without_time, r.late_rows) for r in got] == log and sum(x[2] for x in log) > 2
    assert W.late_row_count(spark, out) == sum(x[2] for x in log) == W.late_rows(spark, out, SCHEMA).count()
    found = {r.window_start: (r.records_checked, r.records_failed) for r in W.window_results(spark, out).collect()}
    assert found == windows


def test_late_rows_of_more_than_a_hundred_batches(spark, tmp_path):
    folder, out = tmp_path / "in", str(tmp_path / "out")
    batches = [[(i, 1, START + i * 10 * MINUTE)] + [(i, 2, START - k * 60 * MINUTE) for k in range(i % 3)] for i in range(104)]
    folder.mkdir()
    for i, rows in enumerate(batches):
        columns = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.timestamp("us", "UTC")))]
        pq.write_table(pa.table(columns, ["k", "x", "ts"]), folder / f"{i:03}.parquet")
        os.utime(folder / f"{i:03}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))  # files come in order of their times
    stream = S.file_stream(spark, str(folder), SCHEMA, files_per_batch=1)
    W.check_windows(stream, RULES[:1], "ts", "10 minutes", out, str(tmp_path / "cp"))
    log, _ = late_by_hand(batches, 10 * MINUTE, 10 * MINUTE, 0 * MINUTE)
    assert len(log) == W.batch_log(spark, out).count() == 104
    assert W.late_row_count(spark, out) == sum(x[2] for x in log) > 100


def test_a_repeated_batch_counts_once(spark, tmp_path):
    folder, out = tmp_path / "in", str(tmp_path / "out")
    write_file(spark, folder, rows_of(20))
    write_file(spark, folder, [(1, 1, START)] * 3 + rows_of(5, 60))
    stream = S.file_stream(spark, str(folder), SCHEMA, files_per_batch=1)
    for checkpoint in ("cp1", "cp2"):  # a lost checkpoint: both batches come again
        W.check_windows(stream, RULES, "ts", "1 hour", out, str(tmp_path / checkpoint))
    assert W.late_row_count(spark, out) == 3 and W.batch_log(spark, out).agg(F.sum("row_count")).first()[0] == 28
    assert W.window_results(spark, out).where("rule_id = 'small'").agg(F.sum("records_checked")).first()[0] == 25
    with pytest.raises(Exception, match="cannot start every"):
        W.check_windows(stream, RULES, "ts", "1 hour", out, str(tmp_path / "cp3"), "2 hours")


def test_first_rows_of_a_hot_key_are_split(spark, tmp_path):
    folder = tmp_path / "in"
    write_file(spark, folder, [(7 if i % 3 else i % 5, i, START + i * MINUTE) for i in range(300)])
    stream = S.file_stream(spark, str(folder), SCHEMA)
    first = S.first_rows(stream, ["k"], "ts", "2 days", salts=8)
    query = S.catch_up(first, str(tmp_path / "f"), str(tmp_path / "cp"))
    rows = spark.read.parquet(str(tmp_path / "f"))
    assert rows.columns == ["k", "x", "ts"] and sorted(r.k for r in rows.collect()) == [0, 1, 2, 3, 4, 7]
    states = max((p["stateOperators"] for p in query.recentProgress if p["stateOperators"]), key=len)
    assert len(states) == 2  # groups of a key, then the key
