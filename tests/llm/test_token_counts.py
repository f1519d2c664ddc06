import math
import random
import re

import public_tokenizers

from veriframe.llm import queries
from veriframe.llm.token_counts import BLANK_MARK, Vocabulary, count_tokens, log_probabilities

PATH = public_tokenizers.path("piece_bpe_32k.model")


def brute(vocabulary, word):
    """Best segmentation by trying all of them, from the left."""
    best = {0: (0.0, 0)}
    for i in range(len(word)):
        score, n = best[i]
        for j in range(i + 1, len(word) + 1):
            piece = vocabulary.pieces.get(word[i:j], vocabulary.byte_score if j == i + 1 else None)
            if j == i + 1 and piece is not None:
                piece = max(piece, vocabulary.byte_score)
            if piece is not None:
                best[j] = max(best.get(j, (float("-inf"), 0)), (score + piece, n - 1))
    return -best[len(word)][1]


def test_trie_against_brute_force():
    v = Vocabulary.read(PATH)
    rng = random.Random(1)
    words = ["", "a", "the", "therefore", "there", "theß", "日本語", "é́", "x" * 80, "the" * 40, "😀😀"]
    words += ["".join(rng.choice("aehnrstiodé<|日") for _ in range(rng.randrange(1, 30))) for _ in range(400)]
    words = sorted({w.encode() for w in words if w}, key=lambda w: hash(w))
    assert v.count(words).tolist() == [brute(v, BLANK_MARK + w) for w in words]


def test_nodes_of_small_vocabularies():
    v = Vocabulary({b"a": -1.0, b"b": -1.0, b"ab": -1.5, b"abab": -3.0, "▁".encode(): -1.0})
    words = [b"a", b"ab", b"abab", b"ababab", b"b", b"ba", b"c", b"cab"]
    assert v.count(words).tolist() == [brute(v, BLANK_MARK + w) for w in words]
    assert v.count([b"abab"]).tolist() == [2]  # of equally good ones, the one with fewer pieces


def check(rows, docs):
    v = Vocabulary.read(PATH)
    want = []
    for d, t in docs:
        words = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())
        want.append((d, len(words), sum(v.count_one(BLANK_MARK + w) for w in words)))
    assert sorted((tuple(r) for r in rows), key=repr) == sorted(want, key=repr)


def test_query_against_single_words(spark, small):
    docs = [(r.doc_id, r.text) for r in queries.table(spark, small, "documents").where("n_chars < 2500").collect()]
    rows = [r for r in queries.op10_token_counts(spark, small).collect() if r.doc_id in dict(docs)]
    check(rows, docs)


def test_edges(spark):
    rows = [(1, "the cat", 1), (1, "the cat", 1), (None, "the cat", 1), (2, None, 1), (3, "", 1), (4, " \n", 1), (5, "ab" * 3000 + " the", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    check(count_tokens(docs, PATH).collect(), [r[:2] for r in rows])
    assert count_tokens(docs.limit(0), PATH).collect() == []


def test_counts_near_the_tokenizers_own(spark, small):
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_file=PATH)
    v = Vocabulary.read(PATH)
    assert v.count([b"the", b"therefore", b"government"]).tolist() == [1, 1, 1]
    texts = {r.doc_id: r.text or "" for r in queries.table(spark, small, "documents").collect()}
    words = {d: re.findall(r"[^\x20\x09-\x0D]+", t) for d, t in texts.items()}
    want = sum(len(own.encode(w)) for ws in words.values() for w in ws)
    got = sum(r.n_tokens for r in queries.op10_token_counts(spark, small).collect())
    assert abs(got / want - 1) < 0.02


def test_only_ranks_become_probabilities():
    assert log_probabilities([-1.5, -2.0]) == [-1.5, -2.0] and log_probabilities([]) == []
    assert abs(sum(math.exp(s) for s in log_probabilities([-2.0, -1.0, -3.0])) - 1) < 1e-12
