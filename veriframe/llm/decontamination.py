"""Benchmark passages in documents: q-gram lemma filtering and banded alignment.

Texts are compared as runs of letters and digits in lower case, separated by single spaces. An
item of n characters occurs in a text with at most k = floor(n * rate) edits only if the two share
at least n + 1 - q * (k + 1) q-grams whose diagonals (place in the text less place in the item)
differ by at most k. Diagonals are therefore counted in bands of twice k + 1, each overlapping the
next by half, so that one band holds all of them; bands below the bound are dropped, and what is
left is verified by an alignment that stays in the band. Items too short for their budget get the
largest budget whose bound is at least one; items shorter than q characters are not looked for.

Items are sent to the workers in blocks of at most `BLOCK_BYTES` of text; each block is one scan
of the documents, which are never shuffled. All counting is on bytes of UTF-8.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriframe.llm.arrays import LOWER, U64, Chunk, Rolling, chunks, find, prepare, table

Q = 8
RATE = 0.1
BLOCK_BYTES = 4 << 20
FILTER_BITS = 20
TABLE_CELLS = 1 << 23
WORD = np.zeros(256, bool)
WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def normalised(chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, their places in the chunk, first and end place of each document)."""
    inside = WORD.take(chunk.data)
    after = np.r_[False, inside[:-1]]
    keep = inside | after  # one separator after each word
    place = np.flatnonzero(keep)
    data = np.where(inside, LOWER.take(chunk.data), np.uint8(32))[keep]
    first = np.searchsorted(place, chunk.starts)
    end = np.searchsorted(place, chunk.ends, "right")
    # The last word's separator is not part of the text.
    trailing = (end > first) & (data[np.maximum(end - 1, 0)] == 32 if len(data) else False)
    return data, place, first, end - trailing


class Items:
    """An index of the q-grams of some items."""

    def __init__(self, ids: list, texts: list[str], q: int, rate: float):
        self.q = q
        self.ids = np.array(ids, np.int64)
        data, _, first, end = normalised(Chunk(pa.array(texts, pa.string())))
        self.data, self.first = data, first
        self.size = end - first
        budget = np.floor(self.size * rate).astype(np.int64)
        self.budget = np.maximum(np.minimum(budget, self.size // q - 1), 0)
        self.bound = self.size + 1 - q * (self.budget + 1)
        count = np.where(self.size >= q, self.size - q + 1, 0)
        owner = np.repeat(np.arange(len(count)), count)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        grams = Rolling(data).grams(q)[first[owner] + place] if len(owner) else np.zeros(0, U64)
        order = np.argsort(grams, kind="stable")
        self.owner, self.place = owner[order], place[order]
        self.grams, self.from_, self.many = np.unique(grams[order], return_index=True, return_counts=True)
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.filter[(self.grams >> U64(64 - FILTER_BITS)).astype(np.int64)] = True

    def candidates(self, data, first, end):
        """Bands that meet the bound, as (document, item, lowest diagonal), and exact occurrences, as
        (document, item, diagonal): all grams of the item on one diagonal. No band holds an exact
        occurrence and another one, so such bands are not among the first."""
        q, none = self.q, (np.zeros(0, np.int64),) * 3
        if len(data) < q or not len(self.grams):
            return none, none
        grams = Rolling(data).grams(q)
        at = np.flatnonzero(self.filter.take((grams >> U64(64 - FILTER_BITS)).view(np.int64)))
        gram, known = find(self.grams, grams.take(at))
        at, gram = at[known], gram[known]
        doc = np.searchsorted(end, at, "right")
        doc = np.minimum(doc, len(end) - 1)
        inside = (at >= first[doc]) & (at + q <= end[doc])
        at, gram, doc = at[inside], gram[inside], doc[inside]
        many = self.many.take(gram)
        source = np.repeat(np.arange(len(at)), many)
        hit = (self.from_.take(gram) - (np.cumsum(many) - many)).take(source) + np.arange(len(source))
        # Items that share fewer grams with a whole text than the bound asks of a band go first.
        item = self.owner.take(hit)
        pair = (doc * len(self.ids)).take(source) + item
        if len(end) * len(self.ids) <= TABLE_CELLS:
            shared = np.bincount(pair, minlength=1).take(pair)
        else:
            _, inverse, count = np.unique(pair, return_inverse=True, return_counts=True)
            shared = count[inverse]
        enough = np.flatnonzero(shared >= self.bound.take(item))
        if not len(enough):
            return none, none
        source, hit, item = source[enough], hit[enough], item[enough]
        doc, at = doc[source], at[source]
        diagonal = at - first[doc] - self.place[hit]
        order = np.lexsort((diagonal, item, doc))
        d, i, g = doc[order], item[order], diagonal[order]
        new = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (i[1:] != i[:-1]) | (g[1:] != g[:-1])])
        full = np.diff(np.r_[new, len(d)]) == self.size[i[new]] - q + 1
        exact = tuple(x[new[full]] for x in (d, i, g))
        width = self.budget[item] + 1
        band = diagonal // width  # a band is this one and the next
        place = self.place[hit]
        doc, item, band, place = (np.r_[x, y] for x, y in ((doc, doc), (item, item), (band, band - 1), (place, place)))
        order = np.lexsort((place, band, item, doc))
        doc, item, band, place = doc[order], item[order], band[order], place[order]
        # Each gram of the item counts once in a band, however often the text repeats it.
        once = np.r_[True, (np.diff(doc) != 0) | (np.diff(item) != 0) | (np.diff(band) != 0) | (np.diff(place) != 0)]
        doc, item, band = doc[once], item[once], band[once]
        new = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (band[1:] != band[:-1])])
        new = new[np.diff(np.r_[new, len(doc)]) >= self.bound[item[new]]]
        low = band[new] * (self.budget[item[new]] + 1)
        solved = {(x, y, b) for x, y, z, w in zip(*(v.tolist() for v in exact), (self.budget[exact[1]] + 1).tolist())
                  for b in (z // w * w, (z // w - 1) * w)}
        rest = np.array([c not in solved for c in zip(doc[new].tolist(), item[new].tolist(), low.tolist())], bool)
        return (doc[new][rest], item[new][rest], low[rest]), exact

    def align(self, data, first, end, doc, item, diagonal):
        """(edits, start, stop) of the best occurrence of each item in its band; places in the document."""
        budget = self.budget[item]
        low = diagonal - budget - 1
        wide = int((4 * budget + 5).max())
        column = np.arange(wide)
        far = 1 << 20
        size = end[doc] - first[doc]
        start = low[:, None] + column
        cost = np.where((start >= 0) & (start <= size[:, None]), 0, far)
        allowed = column < (4 * budget + 5)[:, None]
        cost = np.where(allowed, cost, far)
        result = np.full((len(doc), 3), far)
        steps = self.size[item]
        for i in range(int(steps.max())):
            done = steps == i
            self._finish(result, cost, start, low + i, done)
            at = low[:, None] + i + column  # the text's character that a match would use
            valid = (at >= 0) & (at < size[:, None])
            text = data[np.clip(first[doc][:, None] + at, 0, len(data) - 1)]
            own = self.data[np.minimum(self.first[item] + i, len(self.data) - 1)]
            match = np.where(valid, cost + (text != own[:, None]), far)
            skip = np.full_like(cost, far)
            skip[:, :-1] = cost[:, 1:] + 1  # the item's character is missing in the text
            origin = np.empty_like(start)
            origin[:, :-1] = start[:, 1:]
            origin[:, -1] = 0
            start = np.where(skip < match, origin, start)
            cost = np.minimum(match, skip)
            # Extra characters of the text: the best from the left, one edit per place.
            slope = cost - column
            best = np.minimum.accumulate(slope, 1)
            source = np.maximum.accumulate(np.where(slope == best, column, 0), 1)
            source = np.where(slope == best, column, source)
            cost = np.where(allowed, best + column, far)
            start = np.take_along_axis(start, source, 1)
        self._finish(result, cost, start, low + steps, steps == int(steps.max()))
        return result.T

    def _finish(self, result, cost, start, low, done) -> None:
        if done.any():
            rows = np.flatnonzero(done)
            best = cost[rows].argmin(1)
            result[rows] = np.stack([cost[rows, best], start[rows, best], low[rows] + best], 1)

    def passages(self, chunk: Chunk):
        """(document, item, start, stop, edits) of all occurrences within budget; byte places in the text."""
        data, place, first, end = normalised(chunk)
        (doc, item, diagonal), exact = self.candidates(data, first, end)
        found = [(d, i, g, g + int(self.size[i]), 0) for d, i, g in zip(*(x.tolist() for x in exact))]
        for part in range(0, len(doc), 512):
            d, i, g = (x[part:part + 512] for x in (doc, item, diagonal))
            edits, start, stop = self.align(data, first, end, d, i, g)
            good = (edits <= self.budget[i]) & (stop > start)
            found += zip(*(x[good].tolist() for x in (d, i, start, stop, edits)))
        out = []
        for d, i, start, stop, edits in sorted(found, key=lambda r: (r[0], r[1], r[4], r[2], r[3])):
            # The best of overlapping alignments of one item.
            k = len(out) - 1
            while k >= 0 and out[k][:2] == (d, i) and not (start < out[k][3] and out[k][2] < stop):
                k -= 1
            if k < 0 or out[k][:2] != (d, i):
                out.append((d, i, start, stop, edits))
        if not out:
            return [np.zeros(0, np.int64)] * 5
        d, i, start, stop, edits = (np.array(x, np.int64) for x in zip(*out))
        begin = place[first[d] + start] - chunk.starts[d]
        return [d, self.ids[i], begin, place[first[d] + stop - 1] + 1 - chunk.starts[d], edits]


def item_blocks(benchmark: DataFrame, item_id: str, text: str, q: int, rate: float):
    """Indexes of all items, a block of bounded size at a time; equal texts are one item, with the smallest id."""
    items = benchmark.where(F.col(item_id).isNotNull() & F.col(text).isNotNull()).groupBy(F.col(text).alias("text")).agg(
        F.min(F.col(item_id).cast("long")).alias("item_id"))
    ids, texts, size = [], [], 0
    for row in items.orderBy("item_id").toLocalIterator():
        ids.append(row.item_id)
        texts.append(row.text)
        size += len(row.text)
        if size >= BLOCK_BYTES:
            yield Items(ids, texts, q, rate)
            ids, texts, size = [], [], 0
    if ids:
        yield Items(ids, texts, q, rate)


def leaks(docs: DataFrame, benchmark: DataFrame, q: int = Q, rate: float = RATE, doc_id: str = "doc_id",
          text: str = "text", item_id: str = "item_id") -> DataFrame:
    """(doc_id, item_id, start, stop, edits): each occurrence of an item, in bytes of the document's text.

    Null and empty texts have none. Repeated rows are searched each for itself; rows without
    doc_id are reported with null. Items with equal texts are reported by the smallest id. Empty
    tables give no rows.
    """
    spark = prepare(docs.sparkSession)
    id_type = docs.schema[doc_id].dataType.simpleString()
    schema = f"doc_id {id_type}, item_id long, start long, stop long, edits long"
    found = spark.createDataFrame([], schema)
    for block in item_blocks(benchmark, item_id, text, q, rate):
        sent = spark.sparkContext.broadcast(block)

        def run(batches, sent=sent):
            for batch in batches:
                for rows, chunk in chunks(batch):
                    d, i, start, stop, edits = sent.value.passages(chunk)
                    yield table(doc_id=rows.column("doc_id").take(pa.array(d)), item_id=i, start=start, stop=stop, edits=edits)

        found = found.unionByName(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema))
    return found


def without_leaks(docs: DataFrame, benchmark: DataFrame, q: int = Q, rate: float = RATE, text: str = "text") -> DataFrame:
    """The rows of `docs`, all columns, whose text holds no benchmark item."""
    spark = prepare(docs.sparkSession)
    for block in item_blocks(benchmark, "item_id", "text", q, rate):
        sent = spark.sparkContext.broadcast(block)

        def run(batches, sent=sent):
            for batch in batches:
                for rows, chunk in chunks(batch, text):
                    clean = np.ones(rows.num_rows, bool)
                    clean[sent.value.passages(chunk)[0]] = False
                    yield rows.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
