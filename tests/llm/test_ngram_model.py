import math
import re
import zlib
from collections import Counter

import pytest

from veriframe.llm import ngram_model, queries


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low) + [None]  # None: the end


def discounts(counts):
    n = [sum(c == i for c in counts) for i in (1, 2, 3, 4)]
    return ngram_model.estimate_discounts(n)


class Brute:
    """The textbook formula, with dictionaries."""

    def __init__(self, texts):
        self.uni, self.bi = Counter(), Counter()
        for t in texts:
            w = words(t)
            self.uni.update(w)
            self.bi.update(zip(["<s>", *w[:-1]], w))
        self.cont = Counter(b for _, b in self.bi)
        self.d2, self.d1 = discounts(self.bi.values()), discounts(self.cont.values())
        self.ctx, self.total, self.v = {}, sum(self.cont.values()), len(self.uni)
        for (a, _), c in self.bi.items():
            n, rest = self.ctx.get(a, (0, 0.0))
            self.ctx[a] = n + c, rest + self.cut(c, self.d2)
        self.rest = sum(self.cut(c, self.d1) for c in self.cont.values()) / self.total if self.total else 1

    def cut(self, c, d):
        return 0 if c == 0 else d[min(c, 3) - 1]

    def low(self, w):
        c = self.cont[w]
        return (max(c - self.cut(c, self.d1), 0) / self.total if c else 0) + self.rest / (self.v + 1)

    def p(self, a, w):
        if a not in self.ctx:
            return self.low(w)
        total, rest = self.ctx[a]
        c = self.bi[a, w]
        return max(c - self.cut(c, self.d2), 0) / total + rest / total * self.low(w)

    def row(self, text):
        w = words(text)
        n, v = sum(self.uni.values()), len(self.uni)
        return (len(w), sum(self.uni[x] > 0 for x in w), n, sum(math.log10((self.uni[x] + 1) / (n + v + 1)) for x in w),
                sum(math.log10(self.p(a, x)) for a, x in zip(["<s>", *w[:-1]], w)))


def check(rows, brute, texts):
    got = {}
    for r in rows:
        got.setdefault(r.doc_id, []).append(r)
    for d, t in texts:
        want = brute.row(t)
        assert any(tuple(r[c] for c in ("n_tokens", "n_known", "train_tokens")) == want[:3]
                   and (r.base_score, r.score) == pytest.approx(want[3:], rel=1e-6, abs=1e-9) for r in got[d]), d
    assert len(rows) == len(texts)


def test_query_against_brute_force(spark, small):
    texts = [(r.doc_id, r.text) for r in queries.table(spark, small, "documents").collect()]
    held = {d for d, _ in texts if zlib.crc32(str(d).encode()) % 7 == 2}
    rows = queries.op5_lm_scoring(spark, small).collect()
    assert {r.doc_id for r in rows if r.held_out} == held
    check(rows, Brute([t for d, t in texts if d not in held]), texts)
    assert sum(r.score - r.base_score for r in rows if r.held_out) > 0


def test_edges(spark):
    rows = [(1, "The the THE cat", 1.0), (1, "The the THE cat", 1.0), (None, "a b a b", 1.0), (2, None, 1.0), (3, "", 1.0),
            (4, " \x0b\n ", 1.0), (5, "né " * 4000, 1.0), (6, "Ünï ünï x y", 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    texts = [r[:2] for r in rows]
    check(ngram_model.score(docs, ngram_model.train(docs)).collect(), Brute([t for _, t in texts]), texts)
    none = ngram_model.train(docs.limit(0))
    check(ngram_model.score(docs, none).collect(), Brute([]), texts)
    assert ngram_model.score(docs.limit(0), none).collect() == []


def test_probabilities_add_up_to_one():
    brute = Brute(["a b c a b", "b c d", "a a a"])
    vocabulary = [*brute.uni, "unknown"]
    for before in ["<s>", "a", "b", "other"]:
        assert sum(brute.p(before, w) for w in vocabulary) == pytest.approx(1)
