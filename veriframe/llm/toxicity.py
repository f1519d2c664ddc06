"""Toxicity by two class-conditional Kneser-Ney models.

Two bigram models are fitted, one on toxic and one on ordinary documents. At both levels
the counts are continuation counts, in how many different places a bigram or word follows, so that
copies and texts repeating themselves do not make an expression frequent. Both interpolate down to
their own word distribution and from there to one shared distribution, the counts of both
classes together; an expression that is rare in either class is therefore nearly as likely under
both and says little. A document's evidence is the difference of its two log-likelihoods divided
by its number of tokens, and the part of it that comes from strong expressions, divided by that
number and by its root, which tells a few strong words in a long text from chance. A logistic curve fitted on documents that the counts
have not seen turns both into a score.

Labels are taken from a bounded sample: at most `max_per_class` labelled documents of each class,
those with the smallest hash of their id. All documents are scored in whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriframe.llm.arrays import U64, Rolling, add_up, chunks, counts_by, find, pair_hash, prepare, sums_by, table
from veriframe.llm.ngram_model import discounted, estimate_discounts, how_many

MAX_PER_CLASS = 2000
CONTEXT_WEIGHT = 500  # occurrences of a context that its words alone outweigh
STRONG = 2.0  # an expression's difference above this is strong evidence
MIN_PER_CLASS = 50
SEPARATOR = np.ones(256, bool)  # words are runs of ASCII letters, digits and non-ASCII bytes
SEPARATOR[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
START = U64(0x1234567890ABCDEF)


def tokens(chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, word before, document) as hashes."""
    data, starts, ends, owner = chunk.words(SEPARATOR)
    word = Rolling(data).of(starts, ends)
    before = np.r_[START, word[:-1]]
    if len(owner):
        before[np.r_[True, owner[1:] != owner[:-1]]] = START
    return word, before[:len(word)], owner


def share_of(keys: np.ndarray, counts: np.ndarray, sought: np.ndarray) -> np.ndarray:
    at, known = find(keys, sought)
    return np.where(known, counts[at], 0) if len(keys) else np.zeros(len(sought))


class ClassModel:
    """What one class adds to the shared counts."""

    def __init__(self, first: np.ndarray, second: np.ndarray, count: np.ndarray):
        self.pairs, self.count = add_up([pair_hash(first, second)], [count])
        self.words, self.before = add_up([second], [np.ones(len(second), np.int64)])
        self.total = max(1, int(self.before.sum()))
        # What one document alone says goes to the shared counts as a whole.
        self.discounts = (1.0, *estimate_discounts(how_many(count))[1:])
        self.low_discounts = (1.0, *estimate_discounts(how_many(self.before))[1:])
        self.contexts, self.context_total = add_up([first], [count])
        _, self.rest = add_up([first], [count - discounted(count, self.discounts)])
        self.low_rest = float((self.before - discounted(self.before, self.low_discounts)).sum()) / self.total if len(self.words) else 1.0

    def log_likelihood(self, pair, word, before, shared) -> np.ndarray:
        """Class bigrams over class words over shared words."""
        low = discounted(share_of(self.words, self.before, word), self.low_discounts) / self.total + self.low_rest * shared
        total = share_of(self.contexts, self.context_total, before)
        used = total + CONTEXT_WEIGHT
        rest = (share_of(self.contexts, self.rest, before) + CONTEXT_WEIGHT) / used
        return np.log(discounted(share_of(self.pairs, self.count, pair), self.discounts) / used + rest * low)


class TwoModels:
    """Both classes and the shared backoff; `curve` maps evidence to a score.

    As Kneser-Ney continuation counts do, the shared counts tell in how many classes a word
    occurs, not how often: what is rare is nearly as likely for a class that has not seen
    it, and what one class alone uses often is not.
    """

    def __init__(self, label: np.ndarray, first: np.ndarray, second: np.ndarray, count: np.ndarray):
        self.classes = [ClassModel(first[label == c], second[label == c], count[label == c]) for c in (0, 1)]
        ones = [np.ones(len(c.words), np.int64) for c in self.classes]
        self.words, self.in_classes = add_up([c.words for c in self.classes], ones)
        self.total = int(self.in_classes.sum())
        self.curve = np.zeros(4)

    def evidence(self, word, before, owner, n: int) -> np.ndarray:
        """(n, 4): one, the difference per token, and the part of it that strong expressions give,
        per token and per root of the number of tokens."""
        difference = self.differences(word, before)
        length = np.maximum(counts_by(owner, n), 1)
        strong = sums_by(owner, np.where(difference > STRONG, difference, 0), n)
        return np.stack([np.ones(n), sums_by(owner, difference, n) / length, 10 * strong / length, strong / np.sqrt(length)], 1)

    def differences(self, word, before) -> np.ndarray:
        """Toxic less ordinary log-likelihood of each token."""
        pair = pair_hash(before, word)
        shared = (share_of(self.words, self.in_classes, word) + 1 / (len(self.words) + 1)) / (self.total + 1)
        ordinary, toxic = (c.log_likelihood(pair, word, before, shared) for c in self.classes)
        return toxic - ordinary

    def score(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(evidence @ self.curve, -500, 500)))


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.01, rounds: int = 50) -> np.ndarray:
    """Weighted logistic regression by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        grad = x.T @ (weight * (y - p)) - ridge * w
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + (ridge + 1e-9) * np.eye(len(w))
        step = np.linalg.solve(hessian, grad)
        w += step * min(1.0, 5 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return w


def bounded_labels(labels: DataFrame, max_per_class: int, doc_id: str, label: str) -> tuple[DataFrame, dict[int, int]]:
    """(sample of (doc_id, label), number of labelled documents of each class)."""
    one = labels.where(F.col(doc_id).isNotNull() & F.col(label).isin(0, 1)).groupBy(F.col(doc_id).alias("doc_id")).agg(
        F.max(F.col(label).cast("int")).alias("label"))
    totals = {r.label: r["count"] for r in one.groupBy("label").count().collect()}
    size = min(max_per_class, max(MIN_PER_CLASS, min(totals.get(0, 0), totals.get(1, 0))))  # as many of each
    picked = [one.where(F.col("label") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(size) for c in (0, 1)]
    rows = [tuple(r) for p in picked for r in p.collect()]  # at most 2 * max_per_class
    return labels.sparkSession.createDataFrame(rows, f"doc_id {labels.schema[doc_id].dataType.simpleString()}, label int"), totals


def fit(docs: DataFrame, labels: DataFrame, max_per_class: int = MAX_PER_CLASS, doc_id: str = "doc_id",
        text: str = "text", label: str = "toxic") -> TwoModels:
    """Models and curve from the labelled documents; three quarters of them are counted, one curves."""
    prepare(docs.sparkSession)
    picked, totals = bounded_labels(labels, max_per_class, doc_id, label)
    sample = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(picked), "doc_id")
    part = F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(4))
    sample = sample.withColumn("curve", part == 0)

    def count(batches):
        for batch in batches:
            for rows, chunk in chunks(batch):
                word, before, owner = tokens(chunk)
                label_ = np.asarray(rows.column("label"))[owner]
                if not len(word):
                    continue
                # The word before the bigram; at a text's start, the start mark.
                third = np.where(before == START, START, np.r_[START, before[:-1]])
                yield table(label=pa.array(label_, pa.int32()), third=third.view(np.int64),
                            first=before.view(np.int64), second=word.view(np.int64))

    counted = sample.where("not curve").mapInArrow(count, "label int, third long, first long, second long").distinct().groupBy(
        "label", "first", "second").agg(F.count("*").alias("n")).toArrow()  # bounded by the sample
    got = [counted.column(c).to_numpy() for c in ("label", "first", "second", "n")]
    models = TwoModels(got[0], got[1].view(U64), got[2].view(U64), got[3])

    def weigh(batches):
        for batch in batches:
            for rows, chunk in chunks(batch):
                e = models.evidence(*tokens(chunk), rows.num_rows)
                yield table(label=rows.column("label"), mean=e[:, 1], strong=e[:, 2], root=e[:, 3])

    seen = sample.where("curve").mapInArrow(weigh, "label int, mean double, strong double, root double").toArrow()
    y = seen.column("label").to_numpy().astype(float)
    x = np.stack([np.ones(len(y)), *(seen.column(c).to_numpy() for c in ("mean", "strong", "root"))], 1)
    share = {c: totals.get(c, 0) / max(1, (y == c).sum()) for c in (0, 1)}  # undo the balanced sample
    weight = np.where(y == 1, share[1], share[0]) / max(share[0], share[1], 1e-9)
    # More evidence never lowers a score: a weight that comes out negative is held at zero.
    used = [0, 1, 2, 3]
    while True:
        weights = fit_logistic(x[:, used], y, weight)
        wrong = [f for f, w in zip(used, weights) if f and w < 0]
        if not wrong:
            break
        used = [f for f in used if f not in wrong]
    models.curve = np.zeros(4)
    models.curve[used] = weights
    return models


def score(docs: DataFrame, models: TwoModels, doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row: doc_id, the columns in `keep`, score (0 to 1, higher: more toxic) and difference per token.

    Null, empty and wordless texts have no evidence and get the score of the curve at zero. Equal
    texts have equal scores. Repeated rows stay repeated; rows without doc_id are scored. Without
    labelled documents all scores are 0.5. An empty table gives no rows.
    """
    spark = prepare(docs.sparkSession)
    sent = spark.sparkContext.broadcast(models)  # bounded by the sample of labelled documents
    kept = "".join(f", {c} {docs.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches):
        models = sent.value
        for batch in batches:
            for rows, chunk in chunks(batch):
                e = models.evidence(*tokens(chunk), rows.num_rows)
                yield table(doc_id=rows.column("doc_id"), **{c: rows.column(f"_{c}") for c in keep},
                            score=models.score(e), difference=e[:, 1])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), *[F.col(c).alias(f"_{c}") for c in keep]).mapInArrow(
        run, f"doc_id {docs.schema[doc_id].dataType.simpleString()}{kept}, score double, difference double")
