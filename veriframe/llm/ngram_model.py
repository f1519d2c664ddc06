"""Interpolated modified Kneser-Ney bigram model over words, counted in Spark.

Counting takes three rounds, each one shuffle of arrays that tasks have already summed up: words,
then bigrams grouped by their first word, then continuation counts grouped by their second word.
The model lies in the shared folder as sorted arrays, cut into buckets by the leading bits of the
word's hash: `words` and `counts`, the `bigrams` of each first word and how often they occur, the
totals of each context, and `continuations`. Scoring workers map these files into memory and look
words up by binary search; no worker and no driver ever holds the model.

Words are runs of bytes other than white space, A-Z in lower case; every text ends with one end
token, which is counted and scored. Scores are base-10 logarithms.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriframe.llm.arrays import U64, Chunk, Rolling, add_up, binary_rows, chunks, counts_by, find, memory, prepare, read_array, sums_by, table, write_array
from veriframe.session import shared_folder

END, BEGIN = U64(0x0123456789ABCDEF), U64(0xFEDCBA9876543210)
WORD_BITS = 40  # a bigram's key: place of the first word in its bucket, number of the second
HELD_ROWS = 2_000_000


def token_hashes(chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, document, place of the end tokens) of all tokens, each text's end included."""
    data, starts, ends, owner = chunk.words()
    n = len(chunk.ends)
    hashes = Rolling(data).of(starts, ends)
    stops = np.cumsum(counts_by(owner, n))
    hashes = np.insert(hashes, stops, END)
    owner = np.insert(owner, stops, np.arange(n))
    return hashes, owner, stops + np.arange(n)


class Model:
    """What the driver knows of a model: its folder, and a few numbers per bucket."""

    def __init__(self, folder: str, buckets: int):
        self.folder, self.buckets = folder, buckets
        self.shift = U64(64 - int(math.log2(buckets)))
        self.offsets = np.zeros(buckets + 1, np.int64)
        self.tokens = self.words = 0
        self.discounts = self.low_discounts = (0.0, 0.0, 0.0)
        self.low_total, self.low_rest = 0.0, 1.0

    def path(self, name: str, bucket: int) -> str:
        return f"{self.folder}/{name}-{bucket:05d}.bin"

    def array(self, name: str, bucket: int, dtype) -> np.ndarray:
        own = memory("ngrams")
        key = (self.folder, name, bucket)
        if key not in own:
            if any(k[0] != self.folder for k in own):
                own.clear()  # another model's files
            own[key] = read_array(self.path(name, bucket), dtype)
        return own[key]

    def lookup(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number, or -1 for an unknown word; count) of each hash."""
        distinct, inverse = np.unique(hashes, return_inverse=True)
        number, count = np.full(len(distinct), -1, np.int64), np.zeros(len(distinct), np.int64)
        bucket = (distinct >> self.shift).astype(np.int64)
        cuts = np.searchsorted(bucket, np.arange(self.buckets + 1))
        for b in np.flatnonzero(np.diff(cuts)):
            part = slice(cuts[b], cuts[b + 1])
            at, known = find(self.array("words", b, U64), distinct[part])
            if known.any():
                number[part] = np.where(known, at + self.offsets[b], -1)
                count[part] = np.where(known, self.array("counts", b, np.int64)[at], 0)
        return number[inverse], count[inverse]

    def bucket_of(self, number: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.offsets, number, "right") - 1

    def low(self, number: np.ndarray) -> np.ndarray:
        """Probability of words by the number of different words before them."""
        p = np.full(len(number), self.low_rest / (self.words + 1))
        for b, at in self.by_bucket(number):
            k = self.array("continuations", b, np.float32)[number[at] - self.offsets[b]].astype(np.float64)
            p[at] += discounted(k, self.low_discounts) / max(self.low_total, 1)
        return p

    def by_bucket(self, number: np.ndarray):
        """(bucket, places) of all known words."""
        bucket = np.where(number < 0, -1, self.bucket_of(number)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        for b in np.flatnonzero(np.diff(cuts)):
            yield int(b), order[cuts[b]:cuts[b + 1]]

    def probability(self, before: np.ndarray, number: np.ndarray) -> np.ndarray:
        low = self.low(number)
        p = low.copy()
        for b, at in self.by_bucket(before):
            place = before[at] - self.offsets[b]
            total = self.array("context_total", b, np.float32)[place].astype(np.float64)
            rest = sum(
                d * self.array(f"context_{i + 1}", b, np.uint32)[place] for i, d in enumerate(self.discounts)
            )
            used = total > 0
            total = np.where(used, total, 1)
            key = place.astype(U64) << U64(WORD_BITS) | np.maximum(number[at], 0).astype(U64)
            order = np.argsort(key)
            found, known = find(self.array("bigrams", b, U64), key[order])
            c = np.zeros(len(at))
            if known.any():
                c[order] = np.where(known, self.array("bigram_counts", b, np.float32)[found], 0)
            c[number[at] < 0] = 0
            p[at] = np.where(used, discounted(c, self.discounts) / total + rest / total * low[at], low[at])
        return p


def discounted(count: np.ndarray, discounts: tuple) -> np.ndarray:
    cut = np.select([count == 0, count == 1, count == 2], [0.0, discounts[0], discounts[1]], discounts[2])
    return np.maximum(count - cut, 0)


def estimate_discounts(n: list[int]) -> tuple[float, float, float]:
    """Discounts for counts 1, 2 and 3 or more from how many things were counted 1 to 4 times."""
    y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.0
    out = [i + 1 - (i + 2) * y * n[i + 1] / n[i] if n[i] else 0.5 * (i + 1) for i in range(3)]
    return tuple(min(max(d, 0.05), i + 1) for i, d in enumerate(out))


def how_many(counts: np.ndarray) -> list[int]:
    return [int((counts == i).sum()) for i in (1, 2, 3, 4)]


class Held:
    """Counts a task has summed up so far, given out by bucket when there are many."""

    def __init__(self):
        self.parts: dict[int, tuple[list, list]] = {}
        self.rows = 0

    def add(self, bucket: int, keys: np.ndarray, counts: np.ndarray) -> None:
        have = self.parts.setdefault(bucket, ([], []))
        have[0].append(keys)
        have[1].append(counts)
        self.rows += len(keys)

    def squeeze(self) -> None:
        self.parts = {b: tuple([x] for x in add_up(k, c)) for b, (k, c) in self.parts.items()}
        self.rows = sum(len(k[0]) for k, _ in self.parts.values())

    def out(self) -> pa.RecordBatch:
        self.squeeze()
        rows = [(b, k[0].astype(U64).tobytes(), c[0].astype(np.uint32).tobytes()) for b, (k, c) in self.parts.items()]
        self.__init__()
        return table(bucket=pa.array([r[0] for r in rows], pa.int32()), keys=pa.array([r[1] for r in rows], pa.binary()),
                     counts=pa.array([r[2] for r in rows], pa.binary()))


def gathered(part: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Keys and counts of one bucket, summed up."""
    keys = [np.frombuffer(x, U64) for x in part.column("keys").to_pylist()]
    counts = [np.frombuffer(x, np.uint32).astype(np.int64) for x in part.column("counts").to_pylist()]
    return add_up(keys, counts)


BLOCKS = "bucket int, keys binary, counts binary"


def train(docs: DataFrame, text: str = "text") -> Model:
    """Count and write the model of all texts of `docs`."""
    spark = prepare(docs.sparkSession)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    model = Model(shared_folder(spark, "ngrams"), 1 << max(4, math.ceil(math.log2(parts))))
    texts = docs.select(F.col(text).alias("text"))

    def blocks(pairs):
        """A function over batches that sums up the (bucket, keys, counts) of each chunk."""
        def run(batches):
            held = Held()
            for batch in batches:
                for _, chunk in chunks(batch, owner="ngrams"):
                    for bucket, keys, counts in pairs(chunk):
                        held.add(bucket, keys, counts)
                    if held.rows > HELD_ROWS:
                        held.squeeze()
                        if held.rows > HELD_ROWS // 2:
                            yield held.out()
            yield held.out()
        return run

    def split(bucket, keys, counts):
        cuts = np.searchsorted(bucket, np.arange(model.buckets + 1))
        for b in np.flatnonzero(np.diff(cuts)):
            yield int(b), keys[cuts[b]:cuts[b + 1]], counts[cuts[b]:cuts[b + 1]]

    def word_pairs(chunk):
        keys, counts = np.unique(token_hashes(chunk)[0], return_counts=True)
        yield from split((keys >> model.shift).astype(np.int64), keys, counts)
        yield int(BEGIN >> model.shift), np.array([BEGIN]), np.zeros(1, np.int64)

    def write_words(part: pa.Table) -> pa.Table:
        b = part.column("bucket")[0].as_py()
        keys, counts = gathered(part)
        write_array(model.path("words", b), keys)
        write_array(model.path("counts", b), counts)
        # The next rounds replace these where a word has a bigram.
        write_array(model.path("bigrams", b), keys[:0])
        write_array(model.path("bigram_counts", b), np.zeros(0, np.float32))
        for name, kind in (("context_total", np.float32), ("context_1", np.uint32), ("context_2", np.uint32),
                           ("context_3", np.uint32), ("continuations", np.float32)):
            write_array(model.path(name, b), np.zeros(len(keys), kind))
        return pa.table({"bucket": pa.array([b], pa.int32()), "n": [len(keys)], "total": [int(counts.sum())]})

    found = texts.mapInArrow(blocks(word_pairs), BLOCKS).groupBy("bucket").applyInArrow(write_words, "bucket int, n long, total long")
    sizes = {r.bucket: r for r in found.collect()}  # one row per bucket
    for b in range(model.buckets):
        if b not in sizes:
            write_array(model.path("words", b), np.zeros(0, U64))
            write_array(model.path("counts", b), np.zeros(0, np.int64))
    n = np.array([sizes[b].n if b in sizes else 0 for b in range(model.buckets)], np.int64)
    if n.max(initial=0) >= 1 << (64 - WORD_BITS):
        raise ValueError("too many different words in a bucket: raise spark.sql.shuffle.partitions")
    model.offsets = np.r_[0, np.cumsum(n)]
    model.tokens = sum(r.total for r in sizes.values())
    model.words = max(0, int(n.sum()) - 1)  # without the begin mark

    def bigram_pairs(chunk):
        hashes, _, ends = token_hashes(chunk)
        number, _ = model.lookup(np.append(hashes, BEGIN))
        number, begin = number[:-1], number[-1]
        before = np.r_[begin, number[:-1]]
        before[ends[:-1] + 1] = begin
        bucket = model.bucket_of(before)
        key = (before - model.offsets[bucket]).astype(U64) << U64(WORD_BITS) | number.astype(U64)
        order = np.lexsort((key, bucket))
        bucket, key = bucket[order], key[order]
        first = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (bucket[1:] != bucket[:-1])])
        yield from split(bucket[first], key[first], np.diff(np.r_[first, len(key)]))

    def write_bigrams(part: pa.Table) -> pa.Table:
        b = part.column("bucket")[0].as_py()
        keys, counts = gathered(part)
        write_array(model.path("bigrams", b), keys)
        write_array(model.path("bigram_counts", b), counts.astype(np.float32))
        size = int(model.offsets[b + 1] - model.offsets[b])
        place = (keys >> U64(WORD_BITS)).astype(np.int64)
        write_array(model.path("context_total", b), np.bincount(place, counts, size).astype(np.float32))
        for i, hit in enumerate((counts == 1, counts == 2, counts > 2)):
            write_array(model.path(f"context_{i + 1}", b), np.bincount(place, hit, size).astype(np.uint32))
        word, times = np.unique(keys & U64((1 << WORD_BITS) - 1), return_counts=True)
        to = model.bucket_of(word.astype(np.int64))
        cuts = np.searchsorted(to, np.arange(model.buckets + 1))
        used = np.flatnonzero(np.diff(cuts))
        cuts = np.r_[cuts[used], len(word)]
        return pa.table({
            "bucket": pa.array(np.r_[used, -1], pa.int32()),
            "keys": pa.array([*binary_rows(word, cuts), np.array(how_many(counts), np.int64).tobytes()], pa.binary()),
            "counts": pa.array([*binary_rows(times.astype(np.uint32), cuts), b""], pa.binary()),
        })

    path = shared_folder(spark, "continuations")
    texts.mapInArrow(blocks(bigram_pairs), BLOCKS).groupBy("bucket").applyInArrow(write_bigrams, BLOCKS).write.parquet(path)
    second = spark.read.parquet(path)
    n = sum((np.frombuffer(r.keys, np.int64) for r in second.where("bucket < 0").collect()), np.zeros(4, np.int64))
    model.discounts = estimate_discounts(n.tolist())

    def write_continuations(part: pa.Table) -> pa.Table:
        b = part.column("bucket")[0].as_py()
        word, times = gathered(part)
        out = np.zeros(int(model.offsets[b + 1] - model.offsets[b]), np.float32)
        out[word.astype(np.int64) - model.offsets[b]] = times
        write_array(model.path("continuations", b), out)
        return pa.table({"total": [int(times.sum())], "types": [len(times)]} | {f"n{i + 1}": [x] for i, x in enumerate(how_many(times))})

    rows = second.where("bucket >= 0").groupBy("bucket").applyInArrow(
        write_continuations, "total long, types long, n1 long, n2 long, n3 long, n4 long"
    ).agg(*[F.sum(c).alias(c) for c in ("total", "types", "n1", "n2", "n3", "n4")]).first()
    if rows.total:
        model.low_discounts = estimate_discounts([rows.n1, rows.n2, rows.n3, rows.n4])
        d1, d2, d3 = model.low_discounts
        model.low_total = float(rows.total)
        model.low_rest = (d1 * rows.n1 + d2 * rows.n2 + d3 * (rows.types - rows.n1 - rows.n2)) / rows.total
    return model


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row: doc_id, the columns in `keep`, n_tokens, n_known, train_tokens, base_score, score, perplexity.

    `score` is the model's log10 probability of the text with its end, `base_score` that of an
    add-one unigram model. Null and empty texts consist of the end token. Repeated rows are scored
    each for itself. An empty table gives no rows; a model of no texts gives every token the
    probability of an unknown word, 1.
    """
    prepare(docs.sparkSession)
    kept = "".join(f", {c} {docs.schema[c].dataType.simpleString()}" for c in keep)
    id_type = docs.schema[doc_id].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for rows, chunk in chunks(batch, owner="ngrams"):
                hashes, owner, ends = token_hashes(chunk)
                number, count = model.lookup(np.append(hashes, BEGIN))
                number, count, begin = number[:-1], count[:-1], number[-1]
                before = np.r_[begin, number[:-1]]
                before[ends[:-1] + 1] = begin
                n = rows.num_rows
                p = np.log10(model.probability(before, number))
                base = np.log10((count + 1) / (model.tokens + model.words + 1))
                tokens, total = counts_by(owner, n), sums_by(owner, p, n)
                yield table(
                    doc_id=rows.column("doc_id"), **{c: rows.column(f"_{c}") for c in keep}, n_tokens=tokens,
                    n_known=counts_by(owner[count > 0], n), train_tokens=np.full(n, model.tokens, np.int64),
                    base_score=sums_by(owner, base, n), score=total, perplexity=10 ** np.minimum(-total / tokens, 300),
                )

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), *[F.col(c).alias(f"_{c}") for c in keep]).mapInArrow(
        run, f"doc_id {id_type}{kept}, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"
    )
