import zlib

import numpy as np
import pyarrow as pa
import pytest

from veriframe.llm import queries, toxicity
from veriframe.llm.arrays import Chunk


def model_of(texts):
    """Models of (label, text) pairs, counted without Spark."""
    rows = set()
    for d, (label, text) in enumerate(texts):
        word, before, _ = toxicity.tokens(Chunk(pa.array([text])))
        rows |= {(label, d, int(b), int(w)) for w, b in zip(word, before)}  # texts differ in what stands before
    counts = {}
    for label, _, b, w in rows:
        counts[label, b, w] = counts.get((label, b, w), 0) + 1
    keys = sorted(counts)
    label, first, second = (np.array([k[i] for k in keys], np.int64 if i == 0 else np.uint64) for i in range(3))
    return toxicity.TwoModels(label, first, second, np.array([counts[k] for k in keys]))


def test_repeated_expressions_count_and_rare_ones_hardly():
    m = model_of([(1, f"word{i} vile") for i in range(40)] + [(0, f"word{i + 40} good") for i in range(40)])
    differences = m.differences(*toxicity.tokens(Chunk(pa.array(["vile"])))[:2])
    rare = m.differences(*toxicity.tokens(Chunk(pa.array(["unseen"])))[:2])
    assert differences[0] > 2 and abs(rare[0]) < 0.5


def test_query_finds_held_out_toxic_documents(spark):
    sf = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in queries.op3_toxicity(spark, sf).collect()}
    assert len(rows) == queries.table(spark, sf, "documents").count()
    labels = {r.doc_id: r.toxic for r in queries.table(spark, sf, "labels").collect() if r.doc_id in rows}
    held = [(rows[d], y) for d, y in labels.items() if rows[d].held_out]
    assert all(rows[d].held_out == (zlib.crc32(str(d).encode()) % 4 == 2) for d in rows)
    hits = sum(r.predicted for r, y in held if y == 1)
    assert hits >= 0.6 * sum(y for _, y in held)
    assert sum(r.predicted for r, y in held if y == 0) <= 0.1 * len(held)


def test_edges(spark):
    rows = [(1, "vile vile", 1), (2, None, 1), (3, "", 1), (None, "vile", 1), (1, "vile vile", 1), (4, "!!! ###", 1), (5, "ok " * 9000, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int")
    labels = spark.createDataFrame([(1, 1), (1, None), (2, 0), (None, 1), (5, 0), (99, 1)], "doc_id long, toxic int")
    models = toxicity.fit(docs, labels)
    got = [r.score for r in toxicity.score(docs, models).collect()]
    assert len(got) == len(rows) and all(0 <= s <= 1 for s in got)
    none = toxicity.fit(docs, labels.limit(0))
    assert [r.score for r in toxicity.score(docs, none).collect()] == pytest.approx([0.5] * len(rows))
    assert toxicity.score(docs.limit(0), none).collect() == []
    assert toxicity.fit(docs.limit(0), labels).curve.tolist() is not None
