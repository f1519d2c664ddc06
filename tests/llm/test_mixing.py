import random
import re

import pytest
from pyspark.sql import functions as F

from veriframe.llm import mixing, queries
from tests.oracle import compare, connect

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shares_of(sizes, weights=(5, 2, 1), repeats=3, budget=None):
    """source -> target, by resharing the excess until none is left."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, out = sum(sizes.values()) if budget is None else budget, set(order), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level > repeats * sizes[s]}
        if not full:
            return out | {s: weight[s] * level for s in open_}
        for s in full:
            out[s] = repeats * sizes[s]
            left -= out[s]
        open_ -= full
    return out


def check(found, docs, repeats=3, budget=None):
    """The contract of a query's rows, and targets against the reshared ones."""
    sizes = {}
    for _, text, source in docs:
        sizes[source] = sizes.get(source, 0) + len(WORD.findall(text or ""))
    want = shares_of(sizes, repeats=repeats, budget=budget)
    rows = [r.asDict() for r in found.collect()]
    assert len(rows) == len(docs)
    assert sorted((repr(r["doc_id"]), r["size"]) for r in rows) == sorted((repr(d), len(WORD.findall(t or ""))) for d, t, _ in docs)
    taken, longest = {}, {}
    for r in rows:
        s = r["source"]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(want[s], rel=1e-9, abs=1e-9)
        assert 0 <= r["taken"] <= repeats * r["size"] and (not r["size"] or r["taken"] % r["size"] == 0)
        taken[s] = taken.get(s, 0) + r["taken"]
        longest[s] = max(longest.get(s, 0), r["size"])
    total = sum(want.values())
    assert sum(taken.values()) <= total + 1e-6 and sum(taken.values()) > total - max(longest.values(), default=0) - 1e-6 or not total
    for s in sizes:
        # a document of its own short, or as much over as the others are short together
        assert taken[s] > want[s] - longest[s] - 1e-6 and taken[s] <= want[s] + sum(longest.values()) + 1e-6
    return taken, want


def test_query(spark, small):
    docs = [(r.doc_id, r.text, r.source) for r in queries.table(spark, small, "documents").collect()]
    check(mixing.shares(queries.table(spark, small, "documents")), docs)
    problem, n, _ = compare(spark, connect(small), queries.QUERIES["op13_mixing"], queries.SQL["op13_mixing"], small)
    assert problem is None and n == len(docs)


def test_shares_when_sources_run_out(spark):
    rng = random.Random(5)
    docs = [(i, " ".join(["w"] * rng.randrange(0, 12)), s) for i, s in enumerate(
        [None] * 40 + ["a"] * 2 + ["b"] * 300 + ["c"] * 30 + ["A"] * 3 + ["é"] * 60 + ["z"] * 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    taken, want = check(mixing.shares(df.repartition(5)), docs)
    assert any(abs(want[s] - 3 * sum(len(t.split()) for _, t, x in docs if x == s)) < 1e-6 for s in want)  # some are used up
    check(mixing.shares(df, budget=400), docs, budget=400)
    check(mixing.shares(df, repeats=1, budget=10**6), docs, repeats=1, budget=10**6)


def test_mix_is_a_fair_queue(spark):
    docs = spark.range(900).select(F.col("id").alias("doc_id"), F.lit("a b c d").alias("text"),
                                   F.when(F.col("id") < 800, "big").otherwise("small").alias("source"))
    rows = mixing.mix(docs, weights=(3, 1), budget=1600).orderBy("position").collect()
    assert [r.position for r in rows] == list(range(0, 1600, 4))
    served = {"big": 0, "small": 0}
    for r in rows:  # at any time both have been served in proportion
        served[r.source] += r.size
        assert abs(served["big"] / 3 - served["small"]) <= 8
    first, second = ([r.doc_id for r in rows if r.source == "big"] for _ in range(2))
    assert first == second and first != sorted(first) and len(set(first)) == len(first)


def test_reruns_and_partitions_agree(spark, small):
    docs = queries.table(spark, small, "documents")
    names = ["doc_id", "size", "target", "taken"]
    one = sorted(map(tuple, mixing.shares(docs.repartition(7)).select(*names).collect()))
    assert one == sorted(map(tuple, mixing.shares(docs.orderBy(F.desc("n_chars"))).select(*names).collect()))


def test_edges(spark):
    docs = [(1, "a b", "s"), (1, "a b", "s"), (None, "x\ty", None), (None, "x\ty", None), (2, None, "s"), (3, "", "t"),
            (4, " \n ", "t"), (5, "long " * 60000, "s"), (6, " x ", "u"), (7, "éa b c", "u")]
    rows = [(*d, 1, 2.0, "k", 3) for d in docs]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size int, target double, _key string, _row int")
    check(mixing.shares(df.repartition(3)), docs)
    assert mixing.shares(df.limit(0)).collect() == [] and mixing.mix(df.limit(0)).collect() == []
    nothing = spark.createDataFrame([(1, "", "a"), (2, None, "b")], "doc_id long, text string, source string")
    assert sorted(r.taken for r in mixing.shares(nothing).collect()) == [0, 0]
    with pytest.raises(ValueError):
        mixing.targets(mixing.sized(df), weights=(1, 0))


def test_one_document_a_third_of_all_rows(spark):
    docs = [(7, "same words here", "hot")] * 400 + [(i, "w " * (i % 9), f"s{i % 4}") for i in range(800)]
    check(mixing.shares(spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(6)), docs)


def test_words(spark):
    texts = ["", " ", "a", " a", "a ", "\x0b\x0c\ra\tb\nc", "x", "xx x", "  x", "a\x00b", "a b", "é  ü", "\n\n"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", mixing.n_words(F.col("t")).alias("n")).collect()
    assert [r.n for r in rows] == [len(WORD.findall(r.t)) for r in rows]


def test_no_python_on_the_way(spark, small):
    plan = mixing.shares(queries.table(spark, small, "documents"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Cartesian|NestedLoop", plan)
