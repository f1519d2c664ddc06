import random
import re

import numpy as np

from veriframe.llm import decontamination as dc
from veriframe.llm import queries


def norm(text):
    return re.sub(rb"[^0-9a-z\x80-\xff]+", b" ", bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())).strip()


def least_edits(item, text):
    """Edits of the best occurrence of item anywhere in text."""
    row = np.zeros(len(text) + 1, int)
    own = np.frombuffer(text, np.uint8)
    at = np.arange(len(text) + 1)
    for i, c in enumerate(item):
        new = np.empty_like(row)
        new[0] = i + 1
        new[1:] = np.minimum(row[:-1] + (own != c), row[1:] + 1)
        row = np.minimum.accumulate(new - at) + at
    return row.min()


def want(docs, items, q=dc.Q, rate=dc.RATE):
    out = {}
    for d, t in docs:
        text = norm(t)
        for i, x in items:
            item = norm(x)
            if len(item) >= q and text:
                budget = max(0, min(int(len(item) * rate), len(item) // q - 1))
                e = least_edits(item, text)
                if e <= budget:
                    out[d, i] = e
    return out


def best(rows):
    out = {}
    for r in rows:
        out[r.doc_id, r.item_id] = min(out.get((r.doc_id, r.item_id), 99), r.edits)
    return out


def edited(rng, text, n):
    chars = list(text)
    for _ in range(n):
        p = rng.randrange(len(chars))
        how = rng.randrange(3)
        if how == 0:
            chars[p] = rng.choice("abcdé")
        elif how == 1:
            del chars[p]
        else:
            chars.insert(p, rng.choice("xyz "))
    return "".join(chars)


def test_edited_passages_against_brute_force(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(2, 9)))
    items = [(i, " ".join(word() for _ in range(rng.randrange(2, 25)))) for i in range(12)]
    docs = []
    for d in range(60):
        x = rng.choice(items)[1]
        x = edited(rng, x, rng.randrange(0, max(1, len(x) // 8)))
        docs.append((d, " ".join([word() for _ in range(rng.randrange(30))] + [x.upper() if d % 3 else x.replace(" ", ",\n")] + [word() for _ in range(rng.randrange(30))])))
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    rows = dc.leaks(df, bench).collect()
    expected = want(docs, items)
    assert len(expected) > 20 and best(rows) == expected
    texts = dict(docs)
    for r in rows:  # the region itself is within the budget
        part = texts[r.doc_id].encode()[r.start:r.stop]
        assert least_edits(norm(dict(items)[r.item_id]), norm(part.decode(errors="replace"))) <= r.edits + 2
    assert {r.doc_id for r in dc.without_leaks(df, bench).collect()} == {d for d, _ in docs} - {d for d, _ in expected}


def test_query_finds_all_exact_passages(spark, small):
    docs = [(r.doc_id, norm(r.text)) for r in queries.table(spark, small, "documents").collect()]
    items = [(r.item_id, norm(r.text)) for r in queries.table(spark, small, "benchmark").collect()]
    exact = {(d, i) for d, t in docs for i, x in items if x in t}
    rows = queries.op8_decontamination(spark, small).collect()
    assert exact and exact <= {(r.doc_id, r.item_id) for r in rows if r.edits == 0}
    assert len(rows) <= 2 * len(exact)


def test_edges(spark):
    bench = spark.createDataFrame([(1, "a passage of the benchmark, number one"), (2, None), (3, ""), (4, "tiny"), (None, "no id at all here"),
                                   (5, "a passage of the benchmark, number one")], "item_id long, text string")
    rows = [(1, "x A PASSAGE of the benchmark number one y", "k"), (1, "x A PASSAGE of the benchmark number one y", "k"), (None, "a passage of the benchmark number one", "k"),
            (2, None, "k"), (3, "", "k"), (4, "tiny", "k"), (5, "word " * 9000, "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id string")
    got = sorted(((r.doc_id, r.item_id, r.edits) for r in dc.leaks(docs, bench).collect()), key=repr)
    assert got == [(1, 1, 0), (1, 1, 0), (None, 1, 0)]
    assert len(dc.without_leaks(docs, bench).collect()) == 4
    assert dc.leaks(docs, bench.limit(0)).collect() == [] and dc.leaks(docs.limit(0), bench).collect() == []
    assert dc.without_leaks(docs, bench.limit(0)).count() == len(rows)
