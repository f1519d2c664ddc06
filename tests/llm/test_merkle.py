import hashlib
import random
import zlib

import pytest

from veriframe.llm import merkle, queries
from tests.oracle import compare, connect


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(values):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def climb(nodes, arity):
    """(top, siblings of each node on the way up)"""
    paths, owner = [[] for _ in nodes], list(range(len(nodes)))
    owners = [[i] for i in owner]
    while len(nodes) > 1:
        up, up_owners = [], []
        for at in range(0, len(nodes), arity):
            run = nodes[at:at + arity]
            for k in range(len(run)):
                for i in owners[at + k]:
                    paths[i].append(("".join(run[:k]), "".join(run[k + 1:])))
            up.append(h(*run))
            up_owners.append([i for o in owners[at:at + arity] for i in o])
        nodes, owners = up, up_owners
    return nodes[0], paths


def brute(rows, arity=3):
    """(leaf, subroot, root, proof) of (doc_id, source, lang, n_chars, text) rows."""
    by_source = {}
    for r in rows:
        by_source.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, leaf(r)))
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: climb([x[2] for x in sorted(by_source[s])], arity) for s in order}
    root, over = climb([trees[s][0] for s in order], arity)
    out = []
    for s, tops in zip(order, over):
        for (_, _, own), path in zip(sorted(by_source[s]), trees[s][1]):
            out.append((own, trees[s][0], root, tuple(path + tops)))
    return sorted(out)


def got(df):
    return sorted((r.leaf, r.subroot, r.root, tuple((x.left, x.right) for x in r.proof)) for r in df.collect())


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


@pytest.mark.parametrize("sizes, arity, levels", [
    ([1], 3, 7), ([1, 1], 3, 1), ([4, 1, 9], 3, 1), ([10, 27, 28, 30], 3, 2), ([82, 5, 3, 1, 1, 2, 1, 1, 1, 1, 1], 3, 2), ([9, 16, 3], 2, 3)])
def test_trees(spark, sizes, arity, levels):
    rows = [(i, f"s{k}", "en", i, f"text {i}\n") for k, n in enumerate(sizes) for i in range(n)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert got(merkle.manifest(df, arity=arity, levels=levels)) == brute(rows, arity)


def test_query(spark, small):
    docs = [tuple(r) for r in queries.table(spark, small, "documents").select("doc_id", "source", "lang", "n_chars", "text").collect()]
    want = {x[0]: x for x in brute(docs)}
    rows = {r.doc_id: r for r in queries.op11_manifest(spark, small).collect()}
    assert len(rows) == len(docs)
    changed = 0
    for d in docs:
        r, (own, subroot, root, proof) = rows[d[0]], want[leaf(d)]
        assert (r.leaf, r.subroot, r.root) == (own, subroot, root)
        assert r.proof_sha256 == h(*[x for step in proof for x in step])
        tampered = d[4] if zlib.crc32(str(d[0]).encode()) % 2 else d[4].replace("\n", "")
        folded = leaf((*d[:4], tampered))
        for left, right in proof:
            folded = h(left, folded, right)
        assert r.folded_root == folded and r.verified == (tampered == d[4])
        changed += tampered != d[4]
    assert 0 < changed < len(docs)


def test_against_sql(spark, small):
    problem, n, _ = compare(spark, connect(small), queries.QUERIES["op11_manifest"], queries.SQL["op11_manifest"], small)
    assert problem is None and n > 0


def test_edges(spark):
    rows = [(1, "s", "en", 3, "abc"), (1, "s", "en", 3, "abc"), (None, "s", None, None, None), (2, None, None, None, ""), (None, None, "en", 0, "é"),
            (3, "", "en", 1, "x" * 300_000), (4, "Ω", "-", 1, "-"), (5, "z", "1:a", 1, "a\x00b"), (-6, "s", "", -1, "7"), (10, "s", "", 5, "later")]
    schema = SCHEMA + ", leaf int, root string, _idx int, proof string, _digest int"
    df = spark.createDataFrame([(*r, 1, "r", 2, "p", 3) for r in rows], schema).repartition(4)
    assert got(merkle.manifest(df, levels=1)) == brute(rows)
    assert merkle.manifest(df.limit(0)).collect() == []


def test_a_third_of_all_rows_equal(spark):
    rows = [(7, "hot", "en", 1, "same")] * 120 + [(i, f"s{i % 3}", "en", i, f"t{i}") for i in range(240)]
    assert got(merkle.manifest(spark.createDataFrame(rows, SCHEMA).repartition(5), levels=2)) == brute(rows)


def test_windows_do_it(spark, small):
    plan = merkle.manifest(queries.table(spark, small, "documents"))._jdf.queryExecution().executedPlan().toString()
    assert "lead(" in plan and "lag(" in plan and "Python" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
