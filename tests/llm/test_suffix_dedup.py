import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from veriframe.llm import queries, suffix_dedup


def brute(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(r[i:i + length] for r in raw for i in range(len(r) - length + 1))
    out = []
    for r in raw:
        gone = np.zeros(len(r) + 1, bool)
        for i in range(len(r) - length + 1):
            if seen[r[i:i + length]] > 1:
                gone[i:i + length] = True
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        left = bytes(b for b, g in zip(r, gone) if not g)
        out.append((len(r), int(gone.sum()), spans, hashlib.sha256(left).hexdigest()))
    return out


def check(spark, texts, length, monkeypatch=None):
    rows = [(i, t, "x") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_bytes string").repartition(3)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest())
           for r in suffix_dedup.remove_repeats(docs, length).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts, length)


def made(seed, n, length):
    """Texts sharing passages of about the length, also shorter, changed, overlapping and periodic."""
    rng = random.Random(seed)
    word = lambda k: "".join(rng.choice("abé \n") for _ in range(k))
    shared = [word(rng.randrange(length // 2, 3 * length)) for _ in range(6)] + ["ab" * length, "a" * (2 * length)]
    out = [None, "", "a" * length, word(length)]
    for _ in range(n):
        parts = [word(rng.randrange(length))]
        for _ in range(rng.randrange(4)):
            s = rng.choice(shared)
            a = rng.randrange(len(s))
            parts += [s[a:a + rng.randrange(len(s))], word(rng.randrange(4))]
        out.append("".join(parts))
    return out + out[5:9] + out[5:6]


@pytest.mark.parametrize(("seed", "length"), [(1, 48), (2, 100), (3, 48)])
def test_made_texts_against_brute_force(spark, seed, length):
    check(spark, made(seed, 60, length), length)


def test_query_against_brute_force(spark, small):
    docs = sorted((r.doc_id, r.text) for r in queries.table(spark, small, "documents").collect())
    got = sorted(tuple(r) for r in queries.op4_suffix_dedup(spark, small).collect())
    want = brute([t for _, t in docs], 400)
    assert got == [(d, *w) for (d, _), w in zip(docs, want)]
    assert sum(w[1] for w in want)


def test_empty_table_and_other_columns(spark):
    docs = spark.createDataFrame([(1, "text", 5)], "doc_id long, text string, kept int")
    assert suffix_dedup.remove_repeats(docs.limit(0)).collect() == []
    row = suffix_dedup.remove_repeats(docs).first()
    assert row.kept == bytearray(b"text") and row.n_removed == 0 and row.n_spans == 0


def test_multikey_order():
    rng = np.random.default_rng(0)
    keys = [rng.integers(0, 4, 300), rng.integers(0, 9, 300), rng.integers(0, 99, 300)]
    order = suffix_dedup.multikey_order(keys)
    rows = list(zip(*(k.tolist() for k in keys)))
    assert [rows[i] for i in order] == sorted(rows)


def test_stage_keeps_replacement_characters(spark):
    """A cut takes the halves of its own edges; characters elsewhere stay, also replacement characters."""
    import corpus_pipeline

    # Two characters around the run, and whether both stay whole before it and after it.
    edges = [("é", "è", True, False), ("€", "₭", True, False), ("😀", "😁", True, False), ("a", "b", True, True),
             ("é", "ũ", False, True), ("€", "ℬ", False, False), ("😀", "🚀", False, False)]
    rows = []
    for i, (left, right, _, _) in enumerate(edges):
        body = "".join(f"wort{i} {n} " for n in range(80)) + str(i)
        rows += [(2 * i, f"\ufffd eins {left}{body}{left} drei \ufffd!"), (2 * i + 1, f"zwei {i} {right}{body}{right} vier\ufffd")]
    rows.append((99, "nur \ufffd hier"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in corpus_pipeline.cut_repeats(spark, docs, "").collect()}
    assert got[99] == "nur \ufffd hier"
    for i, (left, right, before, after) in enumerate(edges):
        assert got[2 * i] == f"\ufffd eins {left * before}{left * after} drei \ufffd!"
        assert got[2 * i + 1] == f"zwei {i} {right * before}{right * after} vier\ufffd"
