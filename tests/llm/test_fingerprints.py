import hashlib

import numpy as np

from veriframe.llm import fingerprints as fp
from veriframe.llm import queries


def check(rows, docs):
    """docs: (doc_id, text) in order, each followed by the next."""
    prints = fp.simhash([t for _, t in docs])
    want = []
    for i, (d, t) in enumerate(docs):
        following = docs[(i + 1) % len(docs)][1]
        k = len(t) // 3
        changed = t[:len(t) - k] + following[:k]
        other = fp.simhash([changed])[0]
        same = lambda a, b: 1 - sum((int(x) ^ int(y)).bit_count() for x, y in zip(a, b)) / 128
        want.append((d, len(t), hashlib.sha256(changed.encode()).hexdigest(), fp.digits(prints[i:i + 1])[0],
                     fp.digits(other[None])[0], same(prints[i], other), same(prints[i], prints[(i + 1) % len(docs)])))
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    assert sorted((tuple(r[c] for c in names) for r in rows), key=repr) == sorted(want, key=repr)


def test_query_against_brute_force(spark, small):
    docs = [(r.doc_id, r.text or "") for r in queries.table(spark, small, "documents").collect()]
    rows = queries.op6_fingerprints(spark, small).collect()
    check(rows, sorted(docs, reverse=True))
    long = [r for r in rows if r.n_chars > 1000]
    assert np.mean([r.near_edited > r.near_next for r in long]) > 0.95


def test_edges(spark):
    rows = [(3, "eins zwei drei vier", "t"), (2, None, "t"), (1, "", "t"), (None, "ohne Nummer ü", "t"), (9, "lang " * 9000, "t"), (5, "Wort", "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, tie string")
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    check(fp.with_neighbours(docs).collect(), [(d, t or "") for d, t, _ in order])
    one = docs.where("doc_id = 3")
    check(fp.with_neighbours(one).collect(), [(3, "eins zwei drei vier")])
    assert fp.with_neighbours(docs.limit(0)).collect() == []
    twice = one.union(one)
    check(fp.with_neighbours(twice).collect(), [(3, "eins zwei drei vier")] * 2)


def test_votes_by_hand():
    text = "a b a b a c"
    terms = {("a", "b"): 2, ("b", "a"): 2, ("a", "c"): 1}
    from veriframe.llm.arrays import Rolling, mix, pair_hash

    data = np.frombuffer(b"abc", np.uint8)
    h = dict(zip("abc", Rolling(data).of(np.arange(3), np.arange(1, 4))))
    for half in (0, 1):
        votes = np.zeros(64)
        for (x, y), w in terms.items():
            t = int(mix(pair_hash(h[x][None], h[y][None]) + np.uint64(half))[0])
            votes += w * np.array([1 if t >> (63 - b) & 1 else -1 for b in range(64)])
        want = sum(1 << (63 - b) for b in range(64) if votes[b] > 0)
        assert int(fp.simhash([text])[0, half]) == want


def test_permuted_tables_find_all_pairs(spark):
    rng = np.random.default_rng(2)
    prints = [int.from_bytes(rng.bytes(16)) for _ in range(30)]
    for p in prints[:30]:
        for n in (1, 2, 3, 4, 6):
            q = p
            for b in rng.choice(128, n, replace=False):
                q ^= 1 << int(b)
            prints.append(q)
    text = [f"{p:032x}" for p in prints]
    want = {(a, b) for a in text for b in text if a < b and (int(a, 16) ^ int(b, 16)).bit_count() <= 3}
    got = fp.pairs_within(spark.createDataFrame([(t,) for t in text + text[:3]], "fp string"), 3, 5).collect()
    assert {(r.a, r.b) for r in got} == want and len(got) == len(want)
    assert all(r.distance == (int(r.a, 16) ^ int(r.b, 16)).bit_count() for r in got)


def brute_classes(rows):
    """(doc_id, fingerprint) -> smallest reachable doc_id of each row."""
    prints = sorted({f for _, f in rows})
    parent = {f: f for f in prints}

    def root(f):
        while parent[f] != f:
            f = parent[f]
        return f

    for i, a in enumerate(prints):
        for b in prints[:i]:
            if (int(a, 16) ^ int(b, 16)).bit_count() <= 3:
                parent[root(a)] = root(b)
    least = {}
    for d, f in rows:
        if d is not None:
            least[root(f)] = min(least.get(root(f), d), d)
    return [(d, f, least.get(root(f))) for d, f in rows]


def test_query_finds_near_fingerprints(spark, small):
    rows = queries.op6_fingerprints(spark, small).collect()
    want = brute_classes([(r.doc_id, r.fingerprint) for r in rows])
    assert [(r.doc_id, r.fingerprint, r.near_class) for r in rows] == want
    assert any(r.near_class != r.doc_id for r in rows)


def test_classes_with_crowded_keys(spark, monkeypatch):
    rng = np.random.default_rng(4)
    prints = [int.from_bytes(rng.bytes(16)) for _ in range(5)]
    while len(prints) < 250:
        p = prints[rng.integers(0, len(prints))]
        for b in rng.choice(128, rng.integers(0, 6), replace=False):
            p ^= 1 << int(b)
        prints.append(p)
    rows = [(None if i % 9 == 2 else i, f"{p:032x}") for i, p in enumerate(prints)]
    df = spark.createDataFrame(rows, "doc_id long, fingerprint string")
    want = sorted(brute_classes(rows), key=repr)
    assert 5 < len({c for _, _, c in want}) < 200
    for crowded in (20_000, 2):
        monkeypatch.setattr(fp, "CROWDED", crowded)
        assert sorted(((r.doc_id, r.fingerprint, r.near_class) for r in fp.with_classes(df).collect()), key=repr) == want
    assert fp.with_classes(df.limit(0)).collect() == []
