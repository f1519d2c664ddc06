import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from veriframe.llm import alignment, queries
from veriframe.llm.wordpiece_ids import _byte_characters

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
LETTERS = {c: b for b, c in _byte_characters().items()}


@pytest.fixture(scope="module")
def tokens_of():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)

    def run(text):
        """((id, bytes) by A, by B) of a whole text."""
        own = []
        for i in a.encode(" " + text, add_special_tokens=False).ids:
            own.append((i, bytes(LETTERS[c] for c in a.id_to_token(i))))
        other = []
        for i in b.encode(text):
            p = b.id_to_piece(i)
            other.append((i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()))
        whole = (" " + text).encode()
        if not text or b"".join(x for _, x in own) != whole or b"".join(x for _, x in other) != whole:
            return [], []
        return own, other

    return run


def spans(tokens):
    at, out = 0, []
    for i, x in tokens:
        out.append((i, at, at + len(x)))
        at += len(x)
    return out


def brute(docs, tokens_of):
    """Rows of (doc_id, text) by their definition, token by token."""
    found, counts = [], Counter()
    for d, text in docs:
        a, b = (spans(x) for x in tokens_of(text or ""))
        links, low = [], 0
        for i, s, e in a:
            while low < len(b) and b[low][2] <= s:
                low += 1
            k = low
            while k < len(b) and b[k][1] < e:
                links.append((i, b[k][0]))
                k += 1
        counts.update(links)
        both = sorted({e for _, _, e in a} & {e for _, _, e in b})
        groups, i, j = [], 0, 0
        for end in both:
            left, right = [], []
            while i < len(a) and a[i][2] <= end:
                left.append(str(a[i][0]))
                i += 1
            while j < len(b) and b[j][2] <= end:
                right.append(str(b[j][0]))
                j += 1
            groups.append(",".join(left) + "|" + ",".join(right))
        found.append((d, len(a), len(b), groups, links))
    highest = {}
    for (_, b), n in counts.items():
        highest[b] = max(highest.get(b, 0), n)
    return [(d, na, nb, len(groups), len(links), sum(counts[x] == highest[x[1]] for x in links), sum(counts[x] for x in links), ";".join(groups))
            for d, na, nb, groups, links in found]


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


NAMES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


def test_query(spark, small, tokens_of):
    docs = [(r.doc_id, r.text) for r in queries.table(spark, small, "documents").collect()]
    want = [(*r[:7], hashlib.sha256(r[7].encode()).hexdigest() if r[1] else "") for r in brute(docs, tokens_of)]
    assert rows_of(queries.op12_alignment(spark, small).select("doc_id", *NAMES, "groups_sha256")) == sorted(want, key=repr)


def test_any_text(spark, tokens_of):
    rng = random.Random(3)
    letters = "ab cXYZé ßñςİﬁ中文한😀'’.,!?;){}-_|<>#127890\n\n\t\r\r\x0b\x0c  　▁\x1c\x00́​  "
    texts = ["it's THEY'RE we'll", "<|endoftext|> x <s></s><unk><0x0A>", "a;\r\nb", " x", "\nx", "\tx\n", "x \n y", " ", "  ", "\n", "\r", " \r",
             "a  b   c", "▁", "a▁b", "x  y", "x \n y", "){\r\n\r\n", "é b", "日本語 テスト"]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(600)]
    docs = list(enumerate(texts))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert rows_of(alignment.aligned(df, A, B)) == sorted(brute(docs, tokens_of), key=repr)


def test_edges(spark, tokens_of):
    docs = [(1, "same text"), (1, "same text"), (None, "x"), (None, "x"), (2, None), (3, ""), (4, "long words " * 20000), (5, "y" * 30000), (6, "中" * 4000)]
    rows = [(*d, 1, "g", 2) for d in docs]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_a int, groups string, pair int").repartition(3)
    assert rows_of(alignment.aligned(df, A, B)) == sorted(brute(docs, tokens_of), key=repr)
    assert alignment.aligned(df.limit(0), A, B).collect() == []


def test_forgetting_changes_nothing(tokens_of):
    import numpy as np
    import pyarrow as pa

    rng = random.Random(4)
    texts = [" ".join(rng.choice("ab cd efg hij’s 12 中文".split()) + rng.choice(["", "x", "\n"]) for _ in range(30)) for _ in range(60)]
    units = alignment.Units(alignment.Tokenizers(A, B))
    for part in range(0, 60, 20):
        listed = pa.array(texts[part:part + 20])
        sizes = np.array([len(x.encode()) + 1 for x in texts[part:part + 20]])
        data, starts, ends, row = alignment._units(listed, sizes, units)
        units.used = alignment.REMEMBERED_BYTES + 1
        number = units.of(data, starts, ends)
        for i, x in enumerate(texts[part:part + 20]):
            a, b = tokens_of(x)
            assert units.numbers[number[row == i], :2].sum(0).tolist() == [len(a), len(b)]


def test_pair_counts(spark, tokens_of):
    docs = [(i, f"the cat's hat {i % 7} über") for i in range(50)]
    found = {(r.a, r.b): (r["count"], r.best) for r in alignment.pair_counts(spark.createDataFrame(docs, "doc_id long, text string"), A, B).collect()}
    rows = brute(docs, tokens_of)
    assert sum(c for c, _ in found.values()) == sum(r[4] for r in rows)
    assert sum(c * c for c, _ in found.values()) == sum(r[6] for r in rows)
    assert sum(c for c, best in found.values() if best) == sum(r[5] for r in rows)
