"""Best-fit packing of token sequences with exact-complement hashing.

Documents become pieces of at most `capacity` tokens. How pieces share sequences depends on their
lengths alone, so the plan is made from the number of pieces of each length: a table of `capacity`
numbers, however many documents there are. The plan is a list of patterns (lengths that share one
sequence, and how many sequences are filled that way). For each gap it looks up one, two or three
available lengths that fill it exactly; where none do, the longest length that fits goes in and
the search goes on with what is left of the gap. Each pattern is used as often as availability
allows, so the number of patterns depends on the capacity and not on the data.

Pieces find their place by their rank among the pieces of equal length.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veriframe.llm.arrays import chunks, prepare, table
from veriframe.llm.wordpiece_ids import encoder
from veriframe.session import shared_folder

END_ID = 0


class Plan:
    """Sequences for given numbers of pieces by length."""

    def __init__(self, counts: np.ndarray):
        self.capacity = len(counts) - 1
        self.left = counts.astype(np.int64).copy()
        self.left[0] = 0
        self.have = self.left > 0
        # pairs[s]: ordered pairs of available lengths that add up to s
        self.pairs = np.convolve(self.have.astype(np.int64), self.have.astype(np.int64))
        self.patterns: list[tuple[list[int], int]] = []

    def _retire(self, length: int) -> None:
        """The last piece of a length is used up."""
        self.have[length] = False
        n = len(self.have)
        self.pairs[length:length + n] -= 2 * self.have
        self.pairs[2 * length] -= 1

    def _pair(self, gap: int, free: np.ndarray) -> list[int] | None:
        for a in range(gap - 1, (gap - 1) // 2, -1) if gap < 8 else self._larger(gap, free):
            b = gap - a
            if free[a] > 0 and free[b] > (a == b):
                return [a, b]
        return None

    def _larger(self, gap: int, free: np.ndarray) -> np.ndarray:
        low = (gap + 1) // 2
        return np.flatnonzero((free[low:gap] > 0) & (free[gap - low:0:-1] > 0))[::-1] + low

    def _exact(self, gap: int, free: np.ndarray) -> list[int] | None:
        """One, two or three available lengths that add up to the gap."""
        if free[gap] > 0:
            return [gap]
        if self.pairs[gap] and (found := self._pair(gap, free)):
            return found
        for a in np.flatnonzero((free[1:gap] > 0) & (self.pairs[gap - 1:0:-1] > 0))[::-1] + 1:
            free[a] -= 1
            found = self._pair(gap - a, free)
            free[a] += 1
            if found:
                return [int(a), *found]
        return None

    def make(self) -> list[tuple[list[int], int]]:
        for longest in range(self.capacity, 0, -1):
            while self.left[longest]:
                pattern, gap = [longest], self.capacity - longest
                free = self.left.copy()
                free[longest] -= 1
                while gap:
                    part = self._exact(gap, free)
                    if part is None:
                        fits = np.flatnonzero(free[:gap + 1] > 0)
                        if not len(fits):
                            break
                        part = [int(fits[-1])]
                    pattern += [int(x) for x in part]
                    for x in part:
                        free[x] -= 1
                    gap -= sum(part)
                need = Counter(pattern)
                times = int(min(self.left[x] // n for x, n in need.items()))
                for x, n in need.items():
                    self.left[x] -= times * n
                    if not self.left[x]:
                        self._retire(x)
                self.patterns.append((pattern, times))
        return self.patterns

    def slots(self) -> dict[str, np.ndarray]:
        """Where ranks go: for (length, from rank) on, sequence = first + rank - from, and the offset."""
        used: Counter = Counter()
        rows, sequence = [], 0
        for pattern, times in self.patterns:
            at = 0
            for x in pattern:
                rows.append((x, used[x], sequence, at))
                used[x] += times
                at += x
            sequence += times
        rows.sort()
        return dict(zip(("length", "rank", "sequence", "offset"), np.array(rows, np.int64).reshape(-1, 4).T))


def plan_patterns(counts: np.ndarray) -> Plan:
    plan = Plan(counts)
    plan.make()
    return plan


def pieces(docs: DataFrame, vocabulary: str, capacity: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of each document: place, length, checksum, and rank among its task's equal lengths."""
    prepare(docs.sparkSession)
    id_type = docs.schema[doc_id].dataType.simpleString()

    def run(batches):
        words, task = encoder(vocabulary), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for rows, chunk in chunks(batch, owner="encoder"):
                ids, cuts = words.ids(chunk)
                n = np.diff(cuts) + 1  # with the end token
                count = -(-n // capacity)
                owner = np.repeat(np.arange(len(n)), count)
                piece = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
                start = piece * capacity
                length = np.minimum(capacity, n[owner] - start)
                full = np.insert(ids, cuts[1:], END_ID).astype("<u4")
                first = (cuts[:-1] + np.arange(len(n)))[owner] + start
                crc = [zlib.crc32(full[a:b]) for a, b in zip(first.tolist(), (first + length).tolist())]
                order = np.argsort(length, kind="stable")
                ordered = length[order]
                new = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
                rank = np.empty(len(length), np.int64)
                rank[order] = np.arange(len(length)) - np.repeat(new, np.diff(np.r_[new, len(length)]))
                rank += seen[length]
                seen += np.bincount(length, minlength=capacity + 1)
                yield table(
                    doc_id=rows.column("doc_id").take(pa.array(owner)), piece=pa.array(piece, pa.int32()), start=start,
                    length=length, ids_crc32=pa.array(crc, pa.int64()), task=pa.array([task] * len(owner), pa.int32()), rank=rank,
                )

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        run, f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long, task int, rank long"
    )


def pack(docs: DataFrame, vocabulary: str, capacity: int = 2048, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids and the end id; only documents longer than `capacity` are cut. Null and
    empty texts are one piece of one token. Repeated rows are packed each for itself, also without
    doc_id. An empty table gives no rows. Other columns of `docs` are not read.
    """
    spark = docs.sparkSession
    path = shared_folder(spark, "pieces")
    pieces(docs, vocabulary, capacity, doc_id, text).write.parquet(path)
    cut = spark.read.parquet(path)
    groups = cut.groupBy("task", "length").agg((F.max("rank") + 1).alias("n"))
    shared = shared_folder(spark, "piece-counts")
    groups.write.parquet(shared)
    groups = spark.read.parquet(shared)
    counts = np.zeros(capacity + 1, np.int64)
    for row in groups.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most `capacity` rows
        counts[row.length] = row.n
    slots = plan_patterns(counts).slots()
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    offsets = groups.select("task", "length", F.coalesce(before, F.lit(0)).alias("before"))
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    id_type = cut.schema["doc_id"].dataType.simpleString()
    key = slots["length"] << 44 | slots["rank"]

    def place(batches):
        for batch in batches:
            length, rank = np.asarray(batch.column("length")), np.asarray(batch.column("rank"))
            at = np.searchsorted(key, length << 44 | rank, "right") - 1
            yield table(
                **{n: batch.column(n) for n in names[:5]},
                sequence_id=slots["sequence"][at] + rank - slots["rank"][at], offset=slots["offset"][at],
            )

    ranked = cut.join(offsets, ["task", "length"]).select(*names[:5], (F.col("rank") + F.col("before")).alias("rank"))
    return ranked.mapInArrow(
        place, f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )
