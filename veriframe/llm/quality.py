"""Document quality by a linear-chain conditional random field over lines.

Each line that is not blank gets a label, good or bad. Its features are what the line looks like
(length, kinds of characters, repeated words, whether the line itself repeats in the text) and the
same of the lines before and after it; the chain adds how labels follow each other. A document's
quality is the mean of its lines' forward-backward marginals, weighted by their lengths, mapped to
a probability by a logistic curve.

The field is fitted on a bounded sample: at most `max_documents` labelled documents, those with the
smallest hash of their id, of which a quarter fits the curve. Each line of a document is taken to
have its document's label. All documents are scored in whole.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriframe.llm.arrays import Chunk, Rolling, chunks, pair_hash, prepare, sums_by, table
from veriframe.llm.toxicity import fit_logistic

MAX_DOCUMENTS = 4000
ROUNDS = 300
KINDS = {"upper": range(65, 91), "digit": range(48, 58), "stop": b".", "comma": b",;:", "pipe": b"|",
         "symbol": b"!\"#$%&'()*+-/<=>?@[\\]^_`{}~"}


def line_features(chunk: Chunk):
    """(features, document, length) of all lines that are not blank, in order."""
    data, n = chunk.data, len(chunk.data)
    breaks = np.flatnonzero(data == 10)  # documents end with one, too
    starts, ends = np.r_[0, breaks[:-1] + 1], breaks
    _, word_start, word_end, _ = chunk.words()
    line = np.searchsorted(ends, word_start)
    words = np.bincount(line, minlength=len(ends))
    keep = words > 0
    number = np.cumsum(keep) - 1  # of the lines that are kept
    starts, ends, line, words = starts[keep], ends[keep], number[line], words[keep].astype(float)
    if not len(starts):
        return np.zeros((0, 1)), np.zeros(0, np.int64), np.zeros(0)
    doc = np.searchsorted(chunk.ends, starts)
    length = (ends - starts).astype(float)
    roll = Rolling(data)
    columns = [np.ones(len(starts)), np.log1p(length) / 5, np.log1p(words) / 5, length / words / 10]
    for kind in KINDS.values():
        members = np.zeros(256, bool)
        members[list(kind)] = True
        total = np.concatenate(([0], np.cumsum(members[data], dtype=np.int64)))
        share = (total[ends] - total[starts]) / length
        columns += [share, np.sqrt(share)]
    word = roll.of(word_start, word_end)
    again = np.zeros(len(word))
    again[1:] = (word[1:] == word[:-1]) & (line[1:] == line[:-1])
    order = np.lexsort((word, line))
    new = np.r_[True, (np.diff(word[order]) != 0) | (np.diff(line[order]) != 0)]
    columns += [sums_by(line, again, len(starts)) / words, np.sqrt(np.bincount(line[order], new, len(starts)) / words)]
    whole = pair_hash(doc.astype(np.uint64), roll.of(starts, ends))
    _, inverse, count = np.unique(whole, return_inverse=True, return_counts=True)
    columns.append((count[inverse] > 1).astype(float))
    own = np.stack(columns, 1)
    before, after = np.zeros_like(own), np.zeros_like(own)
    same = doc[1:] == doc[:-1]
    before[1:][same] = own[:-1][same]
    after[:-1][same] = own[1:][same]
    return np.concatenate([own, before, after], 1), doc, length


class Field:
    """Weights of one label against the other, of label pairs and of first labels."""

    def __init__(self, size: int):
        self.weights = np.zeros(size)
        self.pairs = np.zeros((2, 2))
        self.curve = np.zeros(2)

    def marginals(self, x: np.ndarray, doc: np.ndarray):
        """(probability that a line is good, sums of pair marginals, log normalisers' sum)."""
        n = len(x)
        score = np.zeros((n, 2))
        score[:, 1] = x @ self.weights
        first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
        size = np.diff(np.r_[first, n])
        order = np.argsort(-size, kind="stable")  # at each step the longer documents are in front
        first, size = first[order], size[order]
        alive = np.searchsorted(-size, -np.arange(1, size.max(initial=0) + 1), "right")
        ahead, behind = score.copy(), np.zeros((n, 2))
        for t in range(1, len(alive)):
            at = first[:alive[t]] + t
            m = ahead[at - 1][:, :, None] + self.pairs
            ahead[at] += np.logaddexp(m[:, 0], m[:, 1])
        for t in range(len(alive) - 1, 0, -1):
            at = first[:alive[t]] + t
            m = self.pairs[None] + (score[at] + behind[at])[:, None, :]
            behind[at - 1] = np.logaddexp(m[:, :, 0], m[:, :, 1])
        both = ahead + behind
        total = np.logaddexp(both[:, 0], both[:, 1])
        good = np.exp(both[:, 1] - total)
        inner = np.flatnonzero(np.r_[False, doc[1:] == doc[:-1]]) if n else np.zeros(0, np.int64)
        pair = ahead[inner - 1][:, :, None] + self.pairs + (score[inner] + behind[inner])[:, None, :] - total[inner][:, None, None]
        return good, np.exp(pair).sum(0), inner

    def fit(self, x: np.ndarray, doc: np.ndarray, label: np.ndarray, rounds: int = ROUNDS, ridge: float = 1e-3) -> None:
        """Maximum likelihood by Adam on all lines at once."""
        if not len(x):
            return
        inner = np.flatnonzero(np.r_[False, doc[1:] == doc[:-1]])
        seen = np.zeros((2, 2))
        np.add.at(seen, (label[inner - 1], label[inner]), 1)
        state = [np.zeros(len(self.weights) + 4) for _ in range(2)]
        for k in range(1, rounds + 1):
            good, pair, _ = self.marginals(x, doc)
            grad = np.r_[x.T @ (label - good), (seen - pair).ravel()] / len(x)
            grad -= ridge * np.r_[self.weights, self.pairs.ravel()]
            state[0] = 0.9 * state[0] + 0.1 * grad
            state[1] = 0.99 * state[1] + 0.01 * grad**2
            step = 0.1 * (state[0] / (1 - 0.9**k)) / (np.sqrt(state[1] / (1 - 0.99**k)) + 1e-9)
            self.weights += step[:-4]
            self.pairs += step[-4:].reshape(2, 2)

    def document_quality(self, chunk: Chunk) -> np.ndarray:
        """Log-odds of the length-weighted mean marginal; zero for texts without lines."""
        x, doc, length = line_features(chunk)
        n = len(chunk.ends)
        if not len(x):
            return np.zeros(n)
        good = self.marginals(x, doc)[0]
        weight = sums_by(doc, length, n)
        mean = np.where(weight > 0, sums_by(doc, good * length, n) / np.maximum(weight, 1), 0.5)
        mean = np.clip(mean, 1e-6, 1 - 1e-6)
        return np.log(mean / (1 - mean))

    def score(self, quality: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.curve[0] + self.curve[1] * quality)))


def fit(docs: DataFrame, labels: DataFrame, max_documents: int = MAX_DOCUMENTS, doc_id: str = "doc_id",
        text: str = "text", label: str = "quality") -> Field:
    """The field and its curve from a bounded sample of labelled documents."""
    spark = prepare(docs.sparkSession)
    one = labels.where(F.col(doc_id).isNotNull() & F.col(label).isin(0, 1)).groupBy(F.col(doc_id).alias("doc_id")).agg(
        F.max(F.col(label).cast("int")).alias("label"))
    rows = [tuple(r) for r in one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_documents).collect()]
    picked = spark.createDataFrame(rows, f"doc_id {labels.schema[doc_id].dataType.simpleString()}, label int")
    width = line_features(_one_line())[0].shape[1]

    def lines(batches):
        for batch in batches:
            for rows, chunk in chunks(batch):
                x, doc, length = line_features(chunk)
                pick = np.asarray(rows.column("label"))[doc]
                ids = np.asarray(rows.column("part"))[doc]
                key = np.asarray(rows.column("key"))[doc]
                if len(doc):
                    yield table(key=key, part=ids, label=pick, line=np.arange(len(doc)), length=length, x=list(x))

    sample = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(picked), "doc_id")
    sample = sample.withColumn("key", F.xxhash64("doc_id", "text")).withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(4)))
    got = sample.mapInArrow(lines, "key long, part long, label int, line long, length double, x array<double>").orderBy("key", "line").toArrow()
    field = Field(width)
    key, part, label_, length = (got.column(c).to_numpy() for c in ("key", "part", "label", "length"))
    if not len(key):
        return field
    x = np.concatenate([c.values.to_numpy() for c in got.column("x").chunks]).reshape(-1, width)
    doc = np.cumsum(np.r_[0, np.diff(key) != 0])
    learn = part != 0
    field.fit(x[learn], doc[learn], label_[learn])
    rest = ~learn
    if rest.any():
        good = field.marginals(x[rest], doc[rest])[0]
        own, at = np.unique(doc[rest], return_inverse=True)
        mean = np.clip(sums_by(at, good * length[rest], len(own)) / sums_by(at, length[rest], len(own)), 1e-6, 1 - 1e-6)
        y = np.zeros(len(own))
        y[at] = label_[rest]
        z = np.log(mean / (1 - mean))
        field.curve = fit_logistic(np.stack([np.ones(len(z)), z], 1), y, np.ones(len(z)))
        field.curve[1] = max(field.curve[1], 0.0)
    return field


def _one_line() -> Chunk:
    import pyarrow as pa

    return Chunk(pa.array(["one line"]))


def score(docs: DataFrame, field: Field, doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row: doc_id, the columns in `keep`, score (0 to 1, higher: better).

    Null, empty and blank texts have no lines and get the curve's value at even odds. Equal texts
    have equal scores. Repeated rows stay repeated; rows without doc_id are scored. Without labelled
    documents all scores are 0.5. An empty table gives no rows.
    """
    spark = prepare(docs.sparkSession)
    sent = spark.sparkContext.broadcast(field)  # a few hundred numbers
    kept = "".join(f", {c} {docs.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches):
        for batch in batches:
            for rows, chunk in chunks(batch):
                quality = sent.value.document_quality(chunk)
                yield table(doc_id=rows.column("doc_id"), **{c: rows.column(f"_{c}") for c in keep}, score=sent.value.score(quality))

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), *[F.col(c).alias(f"_{c}") for c in keep]).mapInArrow(
        run, f"doc_id {docs.schema[doc_id].dataType.simpleString()}{kept}, score double")
