"""Run a query on Spark and its SQL on DuckDB, and compare the rows."""

from __future__ import annotations

import datetime as dt
import decimal
import glob
import math
import os
import time

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def cell(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, bool) or v is None or isinstance(v, (str, int)):
        return v
    if isinstance(v, float):
        return "nan" if math.isnan(v) else 0.0 if v == 0 else v
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(cell(x) for x in v)
    return v


def rows_sorted(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(cell(r[i]) for i in order) for r in rows]
    return sorted(out, key=repr), [columns[i] for i in order]


def compare(spark, con, fn, sql, sf_dir):
    """(problem or None, rows, spark seconds)."""
    t = time.time()
    df = fn(spark, sf_dir)
    got, got_columns = rows_sorted([tuple(r) for r in df.collect()], df.columns)
    seconds = time.time() - t
    if sql is None:
        return None, len(got), seconds
    cur = con.execute(sql)
    want, want_columns = rows_sorted(cur.fetchall(), [d[0] for d in cur.description])
    if got_columns != want_columns:
        return f"columns {got_columns} != {want_columns}", len(got), seconds
    types = [type(next((r[i] for r in got if r[i] is not None), None)).__name__ for i in range(len(got_columns))]
    types2 = [type(next((r[i] for r in want if r[i] is not None), None)).__name__ for i in range(len(got_columns))]
    if got != want:
        a, b = [r for r in got if r not in set(want)][:3], [r for r in want if r not in set(got)][:3]
        return f"rows {len(got)} != {len(want)}; {got_columns}\n   spark {a}\n   duck  {b}", len(got), seconds
    if types != types2:
        return f"types {list(zip(got_columns, types, types2))}", len(got), seconds
    return None, len(got), seconds


if __name__ == "__main__":
    import sys

    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    sf = sys.argv[1]
    only = sys.argv[2:]
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    con = connect(sf)
    sqls = e.oracle_sql()
    bad = 0
    for name, fn in e.queries().items():
        if only and not any(o in name for o in only):
            continue
        try:
            problem, n, s = compare(spark, con, fn, sqls.get(name), sf)
        except Exception as ex:  # report and go on with the next query
            problem, n, s = f"{type(ex).__name__}: {str(ex)[:600]}", 0, 0.0
        bad += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {name:32s} rows={n:<7d} {s:6.2f}s {'' if name in sqls else '(no sql) '}{problem or ''}", flush=True)
    print("failures:", bad)
