import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from veriframe.llm import packing, queries
from veriframe.llm.arrays import Chunk
from veriframe.llm.wordpiece_ids import WordEncoder

PATH = public_tokenizers.path("word_bpe_49k.json")


def tokenizer():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t


def test_ids_equal_the_tokenizers():
    t, e = tokenizer(), WordEncoder(PATH)
    rng = random.Random(1)
    letters = "abcXYZ éßÄÑñςΣİﬁ中文한글😀'’.,!?-_|<>&%$#1234567890\n\t\r\x0b\x0c  ́​"
    texts = ["", " \n", "It's THEY'RE we'll", "<|endoftext|>a<|startoftext|>", "ΣΑΣ ΌΣΟΣ İstanbul é"]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randrange(200))) for _ in range(400)]
    for part in (texts[:100], texts[100:], texts):  # again, from memory
        ids, cuts = e.ids(Chunk(pa.array(part)))
        for i, x in enumerate(part):
            assert ids[cuts[i]:cuts[i + 1]].tolist() == t.encode(x, add_special_tokens=False).ids, repr(x)


@settings(deadline=None, max_examples=60)
@given(st.lists(st.integers(1, 40), max_size=120))
def test_plan_uses_every_piece_once(lengths):
    plan = packing.plan_patterns(np.bincount(lengths, minlength=41))
    used = np.zeros(41, np.int64)
    for pattern, times in plan.patterns:
        assert sum(pattern) <= 40 and times > 0
        np.add.at(used, pattern, times)
    assert used.tolist() == np.bincount(lengths, minlength=41).tolist()


def test_gaps_are_filled_exactly_by_one_two_or_three():
    for lengths in ([30, 10], [20, 13, 7], [25, 8, 4, 3], [15, 15, 10]):
        plan = packing.plan_patterns(np.bincount(lengths, minlength=41))
        assert [sorted(p) for p, _ in plan.patterns] == [sorted(lengths)]


def check(df, texts, capacity):
    t = tokenizer()
    rows = [r.asDict() for r in df.collect()]
    want = []
    for d, x in texts:
        ids = t.encode(x or "", add_special_tokens=False).ids + [0]
        for p, at in enumerate(range(0, len(ids), capacity)):
            part = np.array(ids[at:at + capacity], "<u4")
            want.append((d, p, at, len(part), zlib.crc32(part.tobytes())))
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted([tuple(r[k] for k in key) for r in rows], key=repr) == sorted(want, key=repr)
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences), sum(w[3] for w in want)


def test_query(spark, small):
    docs = queries.table(spark, small, "documents").select("doc_id", "text").collect()
    n, tokens = check(queries.op9_packing(spark, small), docs, 2048)
    assert n <= tokens // 2048 + 3


def test_edges(spark):
    rows = [(1, "a b c", 5), (1, "a b c", 5), (None, "x", 5), (None, "x", 5), (2, None, 5), (3, "", 5), (4, "long " * 5000, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length int")
    check(packing.pack(docs.repartition(3), PATH, 16), [r[:2] for r in rows], 16)
    assert packing.pack(docs.limit(0), PATH).collect() == []
