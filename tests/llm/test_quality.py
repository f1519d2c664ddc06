import itertools
import zlib

import numpy as np
import pyarrow as pa
import pytest

from veriframe.llm import quality, queries
from veriframe.llm.arrays import Chunk


def test_marginals_against_all_labellings():
    rng = np.random.default_rng(1)
    field = quality.Field(3)
    field.weights, field.pairs = rng.normal(size=3), rng.normal(size=(2, 2))
    sizes = [4, 1, 6]
    doc = np.repeat(np.arange(3), sizes)
    x = rng.normal(size=(len(doc), 3))
    good, pairs, _ = field.marginals(x, doc)
    want, want_pairs = [], np.zeros((2, 2))
    for d, n in enumerate(sizes):
        u = x[doc == d] @ field.weights
        weight, mass, both = 0.0, np.zeros(n), np.zeros((2, 2))
        for y in itertools.product((0, 1), repeat=n):
            w = np.exp(sum(u[i] * y[i] for i in range(n)) + sum(field.pairs[y[i], y[i + 1]] for i in range(n - 1)))
            weight += w
            mass += w * np.array(y)
            for a, b in zip(y, y[1:]):
                both[a, b] += w
        want += list(mass / weight)
        want_pairs += both / weight
    assert good == pytest.approx(want) and pairs == pytest.approx(want_pairs)


def test_lines_see_their_neighbours_and_not_other_documents():
    x, doc, length = quality.line_features(Chunk(pa.array(["first line\n\nsecond", "", "third"])))
    n = x.shape[1] // 3
    assert doc.tolist() == [0, 0, 2] and length.tolist() == [10, 6, 5]
    assert (x[0, 2 * n:] == x[1, :n]).all() and (x[1, n:2 * n] == x[0, :n]).all()
    assert not x[2, n:].any() and not x[0, n:2 * n].any()


def test_query_tells_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in queries.op1_quality(spark, sf).collect()}
    assert len(rows) == queries.table(spark, sf, "documents").count()
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) for d, r in rows.items())
    labels = {r.doc_id: r.quality for r in queries.table(spark, sf, "labels").collect() if r.doc_id in rows}
    held = [(rows[d].predicted, rows[d].score, y) for d, y in labels.items() if rows[d].held_out]
    assert np.mean([p == y for p, _, y in held]) >= 0.85
    good, bad = ([s for _, s, y in held if y == c] for c in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) >= 0.8


def test_edges(spark):
    rows = [(1, "A good line.\nAnother one.", 1), (2, None, 1), (3, "", 1), (None, "X!! Y!!", 1), (1, "A good line.\nAnother one.", 1),
            (4, "\n \n", 1), (5, "bad bad\n" * 9000, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int")
    labels = spark.createDataFrame([(1, 1), (1, None), (5, 0), (None, 1), (77, 1)], "doc_id long, quality int")
    got = [r.score for r in quality.score(docs, quality.fit(docs, labels)).collect()]
    assert len(got) == len(rows) and all(0 <= s <= 1 for s in got)
    none = quality.fit(docs, labels.limit(0))
    assert [r.score for r in quality.score(docs, none).collect()] == pytest.approx([0.5] * len(rows))
    assert quality.score(docs.limit(0), none).collect() == []
