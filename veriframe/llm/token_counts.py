"""Token counts by dynamic programming over a trie of pre-tokens.

A text's pre-tokens are its words with the mark that stands for a blank before them. A pre-token's
tokens are those of its best segmentation into vocabulary pieces, by the sum of the pieces' scores;
among equally good ones, that with fewer pieces. Bytes that no piece covers are one token each, at
a score below every piece's.

The scores of a BPE file are negated merge ranks, whose sums mean nothing: they prefer many pieces of
low rank. They are read as log-probabilities by the law of Zipf and Mandelbrot, 1 / (OFFSET + rank).

Different pre-tokens are sorted, which lays them out as a trie: what a word shares with the one
before it is the same path. Best scores are computed once for each node, level by level for all
words at once, and the number of pieces at a word's last node is kept for the word. A worker
remembers counts of up to `REMEMBERED` words; that never changes a result.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriframe.llm.arrays import U64, Rolling, chunks, counts_by, find, memory, prepare, sums_by, table

BLANK_MARK = "▁".encode()
LONG = 64  # bytes; longer pre-tokens are computed one by one
REMEMBERED = 3_000_000
FILTER_BITS = 20
OFFSET = 30


def log_probabilities(scores: list[float]) -> list[float]:
    """Scores of a model file; different whole numbers below zero are ranks, and become log-probabilities."""
    ranked = [-s for s in scores if s > -1e6]  # pieces without a rank have a lower score
    if not ranked or len(set(ranked)) < len(ranked) or any(r < 0 or r != int(r) for r in ranked):
        return scores
    total = math.log(sum(1 / (OFFSET + r) for r in ranked))
    return [-math.log(OFFSET - s) - total for s in scores]


class Vocabulary:
    """Pieces and scores of a model file, found by the hash of their bytes."""

    def __init__(self, pieces: dict[bytes, float]):
        self.pieces = pieces
        self.byte_score = min(pieces.values(), default=0.0) - 10
        words = list(pieces)
        ends = np.cumsum([len(w) for w in words], dtype=np.int64)
        sizes = np.diff(np.r_[0, ends])
        hashes = Rolling(np.frombuffer(b"".join(words), np.uint8)).of(ends - sizes, ends)
        order = np.argsort(hashes)
        self.hashes, self.scores = hashes[order], np.array(list(pieces.values()), float)[order]
        self.sizes = np.unique(sizes).tolist()
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.filter[(hashes >> U64(64 - FILTER_BITS)).astype(np.int64)] = True
        self.known, self.counts = np.zeros(0, U64), np.zeros(0, np.int64)

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = [i for i in range(model.get_piece_size())
               if not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i) or model.is_unused(i))]
        scores = log_probabilities([model.get_score(i) for i in ids])
        return cls({model.id_to_piece(i).encode(): s for i, s in zip(ids, scores)})

    def count_one(self, word: bytes) -> int:
        """The same for a single pre-token of any length."""
        best = [(0.0, 0)]
        for end in range(1, len(word) + 1):
            score, n = best[end - 1]
            top = (score + self.byte_score, -(n + 1))
            for size in self.sizes:
                if size > end:
                    break
                piece = self.pieces.get(word[end - size:end])
                if piece is not None:
                    score, n = best[end - size]
                    top = max(top, (score + piece, -(n + 1)))
            best.append((top[0], -top[1]))
        return best[-1][1]

    def count_sorted(self, words: list[bytes]) -> np.ndarray:
        """Numbers of tokens of different sorted pre-tokens of at most LONG bytes: the trie."""
        n = len(words)
        sizes = np.array([len(w) for w in words], np.int64)
        starts = np.cumsum(sizes) - sizes
        data = np.frombuffer(b"".join(words), np.uint8)
        roll = Rolling(data)
        depths = int(sizes.max())
        letters = np.zeros((n, depths), np.int16) - 1
        row = np.repeat(np.arange(n), sizes)
        letters[row, np.arange(len(data)) - starts[row]] = data
        differs = letters[1:] != letters[:-1]
        shared = np.r_[0, np.where(differs.any(1), differs.argmax(1), depths)]  # with the word before
        best = [np.zeros(n)]  # by depth: score of the node, at the first word that has it
        count = [np.zeros(n, np.int64)]
        first = [np.zeros(n, np.int64)]  # by depth: that word, for each word
        result = np.zeros(n, np.int64)
        for depth in range(1, depths + 1):
            node = np.flatnonzero((shared < depth) & (sizes >= depth))
            mark = np.zeros(n, np.int64)
            mark[node] = node
            first.append(np.maximum.accumulate(mark))
            score, number = np.full(n, -np.inf), np.zeros(n, np.int64)
            up = first[depth - 1][node]
            score[node], number[node] = best[depth - 1][up] + self.byte_score, count[depth - 1][up] + 1
            end = starts[node] + depth
            for size in self.sizes:
                if size > depth:
                    break
                h = roll.of(end - size, end)
                maybe = np.flatnonzero(self.filter[(h >> U64(64 - FILTER_BITS)).astype(np.int64)])
                at, known = find(self.hashes, h[maybe])
                hit, at = maybe[known], at[known]
                if not len(hit):
                    continue
                own = node[hit]
                up = first[depth - size][own]
                s, c = best[depth - size][up] + self.scores[at], count[depth - size][up] + 1
                better = (s > score[own]) | ((s == score[own]) & (c < number[own]))
                score[own[better]], number[own[better]] = s[better], c[better]
            best.append(score)
            count.append(number)
            done = np.flatnonzero(sizes == depth)
            result[done] = number[first[depth][done]]
        return result

    def count(self, words: list[bytes]) -> np.ndarray:
        """Numbers of tokens of different pre-tokens, in any order."""
        marked = [BLANK_MARK + w for w in words]
        order = sorted(range(len(words)), key=marked.__getitem__)
        out = np.zeros(len(words), np.int64)
        short = [i for i in order if len(marked[i]) <= LONG]
        if short:
            out[short] = self.count_sorted([marked[i] for i in short])
        for i in order:
            if len(marked[i]) > LONG:
                out[i] = self.count_one(marked[i])
        return out

    def chunk_counts(self, chunk) -> tuple[np.ndarray, np.ndarray]:
        """(pre-tokens, tokens) of each document."""
        data, starts, ends, owner = chunk.words(lower=False)
        n = len(chunk.ends)
        if not len(starts):
            return np.zeros(n, np.int64), np.zeros(n, np.int64)
        words, place, inverse = np.unique(Rolling(data).of(starts, ends), return_index=True, return_inverse=True)
        if len(self.known) > REMEMBERED:
            self.known, self.counts = self.known[:0], self.counts[:0]
        _, have = find(self.known, words)
        new = np.flatnonzero(~have)
        if len(new):
            raw = data.tobytes()
            counts = self.count([raw[a:b] for a, b in zip(starts[place[new]].tolist(), ends[place[new]].tolist())])
            at = np.searchsorted(self.known, words[new])
            self.known, self.counts = np.insert(self.known, at, words[new]), np.insert(self.counts, at, counts)
        at, _ = find(self.known, words)
        return counts_by(owner, n), sums_by(owner, self.counts[at][inverse], n).astype(np.int64)


def vocabulary(path: str) -> Vocabulary:
    """This worker's vocabulary of a file."""
    own = memory("pieces")
    if path not in own:
        own[path] = Vocabulary.read(path)
    return own[path]


def count_tokens(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_tokens) per row.

    Null, empty and blank texts have none. Repeated rows are counted each for itself; rows without
    doc_id keep null. An empty table gives no rows. Other columns are not read.
    """
    prepare(docs.sparkSession)

    def run(batches):
        own = vocabulary(path)
        for batch in batches:
            for rows, chunk in chunks(batch, owner="pieces"):
                words, tokens = own.chunk_counts(chunk)
                yield table(doc_id=rows.column("doc_id"), n_words=words, n_tokens=tokens)

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        run, f"doc_id {docs.schema[doc_id].dataType.simpleString()}, n_words long, n_tokens long")
