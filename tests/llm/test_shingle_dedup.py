import random

import corpus_pipeline
import numpy as np
from veriframe.llm import queries, shingle_dedup


def shingles(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    words = [w for w in low.split(" ") if w]
    size = min(5, len(words))
    return {tuple(words[i:i + size]) for i in range(len(words) - size + 1)} if words else set()


def brute(rows):
    """Numbers of the rows that stay: all pairs compared by Jaccard similarity."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or 5 * len(a & b) >= 4 * len(a | b):
                parent[root(i)] = root(j)
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(root(i), []).append((d is None, d or 0))
    return sorted(min(g) for g in groups.values())


def check(docs):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = corpus_pipeline.drop_near_duplicates(docs.sparkSession, docs, "")
    assert got.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got.collect()) == brute(rows)


def test_stage_against_jaccard(spark):
    check(queries.table(spark, "/root/testdata/sf0.01", "documents"))


def test_edited_copies(spark):
    """Copies with words replaced, at similarities around 0.8, in chains and beside unlike texts with a common passage."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    passage = " ".join(word() for _ in range(60))
    texts = [" ".join(word() for _ in range(150)) for _ in range(12)]
    for _ in range(300):
        words = rng.choice(texts).split(" ")
        for _ in range(rng.randrange(0, 9)):
            words[rng.randrange(len(words))] = word()
        texts.append(" ".join(words))
    texts += [" ".join(word() for _ in range(100)) + " " + passage for _ in range(60)] + ["", None, " \n", "A b", "a  B", "a b c"]
    rng.shuffle(texts)
    rows = [(None if i % 50 == 7 else i, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    check(docs)
    check(docs.limit(0))


def test_similarity_of_exactly_four_fifths(spark):
    words = [f"w{i}" for i in range(13)]
    rows = [(1, " ".join(words)), (2, " ".join(words + ["x", "y"])[:-2]), (3, " ".join(words[:12]) + " z")]  # 9 of 10, 8 of 10
    check(spark.createDataFrame(rows, "doc_id long, text string"))


def test_keys_meet_as_often_as_similarity_says():
    rng = np.random.default_rng(2)
    met = 0
    for _ in range(400):
        a = rng.integers(0, 2**64, 90, dtype=np.uint64)
        b = np.r_[a[:80], rng.integers(0, 2**64, 10, dtype=np.uint64)]  # similarity 0.8
        keys = shingle_dedup.band_keys(np.r_[a, b], np.array([0, 90]))
        shared = (keys[0] == keys[1]).sum()
        assert shared
        met += shared
    assert abs(met / 400 / shingle_dedup.BANDS - 0.8**4) < 0.03


def test_fingerprints_alone_find_close_copies(spark):
    """Without any MinHash key, SimHash and Golay keys link close copies, and sets decide: unlike texts stay apart."""
    rng = random.Random(8)
    text = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n))
    texts = [text(600) for _ in range(6)]
    texts += [t + " " + text(2) for t in texts for _ in range(4)]
    docs = spark.createDataFrame(list(enumerate(texts)), "_row long, text string")
    nodes = shingle_dedup._sketches(docs, 5, "text").selectExpr("_row AS node", "n", "fp")
    close = shingle_dedup.fingerprint_pairs(nodes)
    sets = shingle_dedup._sets(docs.withColumnRenamed("_row", "node"), 5)
    none = spark.createDataFrame([], "key long, node long, n long")
    roots = {r.node: r.root for r in shingle_dedup.similar_links(none, sets, 80, close).collect()}
    fps = {r.node: r.fp for r in nodes.collect()}
    group = lambda d: d if d < 6 else (d - 6) // 4
    near = [d for d in range(6, 30) if (fps[d] ^ fps[group(d)]).bit_count() <= 4]
    assert len(near) >= 20 and all(roots[d] == group(d) for d in near)
    assert all(root == group(d) for d, root in roots.items())
    unlike = nodes.selectExpr("node", "n", "0L AS fp")  # one fingerprint for all
    roots = {r.node: r.root for r in shingle_dedup.similar_links(none, sets, 80, shingle_dedup.fingerprint_pairs(unlike)).collect()}
    assert {roots.get(d, d) for d in range(6)} == set(range(6))
