import pytest

from tests.oracle import compare, connect
from veriframe.llm import licenses, queries

MIT = next(t for n, t in licenses.KNOWN if n == "MIT" and len(t) > 500)


def test_query_against_sql(spark, small):
    problem, rows, _ = compare(spark, connect(small), queries.op2_licenses, queries.SQL["op2_licenses"], small)
    assert problem is None and rows > 0


@pytest.mark.parametrize("text", [
    MIT, MIT.upper().replace(",", " ;"), "Copyright (c) 2020 Somebody\n\n" + MIT, MIT.replace("sublicense", "sub-licence"), MIT.replace("\n", "\r\n \t"),
])
def test_equal_texts(spark, text):
    row = licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row.license_id == "MIT" and row.whole


def test_edges(spark):
    notice = "Released under the MIT licence!"
    rows = [(1, notice, "x"), (1, notice, "x"), (None, f"a\n{notice}\n{notice}", "x"), (2, None, "x"), (3, "", "x"), (4, MIT + " but not", "x"), (5, "w " * 50000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, license_id string")
    got = sorted((tuple(r) for r in licenses.scan(docs).collect()), key=repr)
    assert got == [(1, "MIT", True, 1), (1, "MIT", True, 1), (None, "MIT", False, 2)]
    assert licenses.scan(docs.limit(0)).collect() == []
