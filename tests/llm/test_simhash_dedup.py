import numpy as np
import pytest
import xxhash

from veriframe.llm import queries
from veriframe.llm import simhash_dedup as sd


def brute_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    words = [w for w in low.split(" ") if w]
    size = min(4, len(words))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i:i + size]).encode(), 42)
              for i in range(len(words) - size + 1)] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows):
    """rows: (doc_id, fingerprint) -> {row index: smallest reachable doc_id}."""
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (_, a) in enumerate(rows):
        for j in range(i):
            if (a ^ rows[j][1]).bit_count() <= 4:
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return [least.get(root(i)) for i in range(len(rows))]


def check(df, texts):
    got = sorted(df.collect(), key=repr)
    rows = [(d, brute_fingerprint(t)) for d, t in texts]
    want = sorted(((d, f, c) for (d, f), c in zip(rows, brute_components(rows))), key=repr)
    assert sorted([(r.doc_id, int(r.fp) % 2**64, r.component_id) for r in got], key=repr) == want


def test_components_against_brute_force(spark, small):
    docs = queries.table(spark, small, "documents")
    texts = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    check(sd.near_duplicates(docs), texts)


def test_edges(spark):
    text = "one two  three\tfour five ünï côdé"
    rows = [(1, text, 9), (2, text.upper(), 9), (2, text, 9), (None, text, 9), (3, None, 9), (4, "", 9), (5, " \n ", 9),
            (6, "word", 9), (7, "a b c", 9), (8, "w " * 3000, 9), (None, "quite another text altogether", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp int").withColumnRenamed("fp", "component_id")
    check(sd.near_duplicates(docs), [(d, t) for d, t, _ in rows])
    assert sd.near_duplicates(docs.limit(0)).collect() == []


def test_code_is_the_extended_golay_code():
    weights = np.bincount([sd._encode(m).bit_count() for m in range(4096)], minlength=25)
    assert {i: n for i, n in enumerate(weights) if n} == {0: 1, 8: 759, 12: 2576, 16: 759, 24: 1}


def test_every_pair_within_four_bits_shares_a_key():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 2**64, 3000, dtype=np.uint64)
    b = a.copy()
    for i in range(len(b)):
        for bit in rng.choice(64, rng.integers(0, 5), replace=False):
            b[i] ^= np.uint64(1 << int(bit))
    keys = [set(zip(*(x.tolist() for x in sd.golay_keys(v)))) for v in (a, b)]
    assert {i for i, _ in keys[0] & keys[1]} == set(range(len(a)))


def clouds(n, seed):
    """Fingerprints in chains and clouds around a few centres."""
    rng = np.random.default_rng(seed)
    out = [int(x) for x in rng.integers(0, 2**64, 6, dtype=np.uint64)]
    while len(out) < n:
        f = out[rng.integers(0, len(out))]
        for bit in rng.choice(64, rng.integers(1, 6), replace=False):
            f ^= 1 << int(bit)
        out.append(f)
    return sorted(set(out))


@pytest.mark.parametrize(("small_run", "pair_limit"), [(64, 20_000), (2, 20_000), (2, 3)])
def test_components_of_clouds(spark, monkeypatch, small_run, pair_limit):
    """The pairwise, breadth-first and linear ways all find the same components."""
    fps = clouds(150, 5)
    rows = list(enumerate(fps))
    df = spark.createDataFrame([(f - 2**64 if f >= 2**63 else f,) for f in fps], "fp long")
    monkeypatch.setattr(sd, "SMALL_RUN", small_run)
    monkeypatch.setattr(sd, "PAIR_LIMIT", pair_limit)
    key, fp = [np.concatenate(x) for x in zip(*[(k, np.array(fps, np.uint64)[i]) for i, k in [sd.golay_keys(np.array(fps, np.uint64))]])]
    order = np.argsort(key, kind="stable")
    a, b, kind = sd.key_links(key[order], fp[order])
    crowded = {int(x) for x, k in zip(a, kind) if k == 1}
    links = [(int(x), int(y)) for x, y, k in zip(a, b, kind) if k == 0]
    if pair_limit == 3:
        assert crowded
        links += [(x, y) for x in crowded for y in crowded if x < y and (x ^ y).bit_count() <= 4]
    signed = lambda v: v - 2**64 if v >= 2**63 else v
    roots = dict(sd.connected(spark.createDataFrame([(signed(x), signed(y)) for x, y in links], "a long, b long")).collect())
    want = brute_components(rows)
    groups = {}
    for (i, f), c in zip(rows, want):
        groups.setdefault(c, set()).add(roots.get(signed(f), signed(f)))
    assert all(len(v) == 1 for v in groups.values()) and len({min(v) for v in groups.values()}) == len(groups)
    assert df.count() == len(fps)


def test_linear_way(spark):
    """Words within two bits of two fingerprints meet exactly if these are within four bits."""
    fps = [0, 0b1111, 0b11111 << 20, 0b111111111]
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    near = df.mapInArrow(sd._within_two, "word long, fp long").collect()
    words = {}
    for r in near:
        words.setdefault(r.fp, set()).add(r.word)
    for a in fps:
        for b in fps:
            assert bool(words[a] & words[b]) == ((a ^ b).bit_count() <= 4)


def test_rounds_end_when_edges_are_stars(spark, monkeypatch):
    written = []
    folder = sd.shared_folder
    monkeypatch.setattr(sd, "shared_folder", lambda spark, name: written.append(name) or folder(spark, name))
    path = [(i, i + 1) for i in range(-3000, 3000)] + [(9000, 9000 + i) for i in range(1, 50)]
    links = spark.createDataFrame(path, "a long, b long")
    roots = {**{i: -3000 for i in range(-2999, 3001)}, **{9000 + i: 9000 for i in range(1, 50)}}
    assert dict(sd.connected(links.coalesce(1)).collect()) == roots
    assert written == ["stars"]  # all edges lie in one task, and no round follows to see that nothing changes
    monkeypatch.setattr(sd, "EDGES", 7)
    got = sd.connected(links.repartition(5)).collect()
    assert dict(got) == roots and len(got) == len(roots)
    assert len(written) > 2


def test_stars(spark):
    for edges, stars in (([], True), ([(2, 1), (3, 1)], True), ([(2, 1), (3, 2)], False), ([(3, 1), (3, 2)], False), ([(2, 1), (2, 1)], False)):
        assert sd.are_stars(spark.createDataFrame(edges, "a long, b long")) == stars
