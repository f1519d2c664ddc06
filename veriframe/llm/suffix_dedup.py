"""Removal of repeated byte strings: sampled suffixes, range-partitioned and sorted.

A byte is removed if a string of `length` bytes covers it that starts at another place too, in any
document. Whether a place is the start of such a string is decided by its suffix: sorted suffixes
that agree on their first `length` bytes stand next to each other. Sorting every suffix of the
corpus is not needed, so suffixes are thinned out in exact steps first:

1. Each window of `length` bytes is represented by its anchor, the leftmost of its 100-byte grams
   with the smallest hash. Equal windows have equal anchors, so a window whose anchor gram occurs
   once in the corpus is unique. All windows in a row that share an anchor value are one run; a
   run whose whole text occurs twice is repeated throughout.
2. The other runs are cut into cells of up to 20 windows at fixed distances from the anchor. Where
   the part common to a cell's windows is unique, so are they; where the cell's whole text occurs
   twice, they all repeat.
3. The suffixes at the windows that are left are keyed by their leading eight bytes and by the
   digest of the rest of the window. Splitters sampled from these keys range-partition them; each
   bucket is sorted by multikey quicksort, most significant key first, and neighbours are
   compared, also across the boundaries of batches. Equal keys never straddle two buckets. Keys
   that the sample itself holds twice are proven repeats: they stay out of the shuffle, so that no
   bucket is filled by one passage.

Digests are 64 bits of a random polynomial, compared together with lengths.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriframe.llm.arrays import U64, Rolling, chunks, mix, prepare, table
from veriframe.llm.scratch import drop, kept

LENGTH = 400
GRAM = 100
CELL = 20
OFTEN, SALTS = 1000, 64
SAMPLE = 20_000  # splitter candidates


def sliding(values: np.ndarray, width: int, best: np.ufunc, fill) -> np.ndarray:
    """best of each `width` values in a row: running bests from both ends of blocks of that width."""
    n = len(values)
    pad = np.full(-(-n // width) * width, fill, values.dtype)
    pad[:n] = values
    rows = pad.reshape(-1, width)
    ahead = best.accumulate(rows, 1).ravel()
    back = best.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
    return best(back[:n - width + 1], ahead[width - 1:n])


def window_runs(roll: Rolling, start: int, end: int, length: int, gram: int):
    """Runs of windows of one document with the same smallest gram: first and last window, hash of
    the gram, all gram hashes, the smallest hash of each window."""
    at = np.arange(start, end - gram + 1)
    h = roll.of(at, at + gram)
    least = sliding(h, length - gram + 1, np.minimum, ~U64(0))
    first = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
    last = np.r_[first[1:], len(least)] - 1
    return first, last, least[first], h, least


def anchor_counts(first, last, value, h, least, wide: int) -> np.ndarray:
    """At how many places in the windows of a run its gram stands; more than one in periodic text."""
    edge = np.zeros(wide - 1, U64)
    anchor = np.flatnonzero(sliding(np.concatenate([edge, least, edge]), wide, np.maximum, U64(0)) == h)
    distinct, number = np.unique(h[anchor], return_inverse=True)
    step = len(h) + 1
    places = np.sort(number * step + anchor)
    base = np.searchsorted(distinct, value) * step
    return np.searchsorted(places, base + last + wide) - np.searchsorted(places, base + first)


def anchors(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """(key, first, last, gram, whole, times): all runs of windows. `whole` is the digest of a run's
    text, `times` the number of places in it where the gram stands."""
    def run(batches):
        for batch in batches:
            for rows, chunk in chunks(batch):
                roll = Rolling(chunk.data)
                key = np.asarray(rows.column("key"))
                out = []
                for i in np.flatnonzero(chunk.ends - chunk.starts >= length):
                    s, e = int(chunk.starts[i]), int(chunk.ends[i])
                    first, last, value, h, least = window_runs(roll, s, e, length, gram)
                    times = anchor_counts(first, last, value, h, least, length - gram + 1)
                    whole = roll.of(s + first, s + last + length)
                    out.append((np.full(len(first), key[i]), first, last, value, whole, times))
                if out:
                    k, a, b, g, w, t = (np.concatenate(x) for x in zip(*out))
                    yield table(key=k, first=a, last=b, gram=g.view(np.int64), whole=w.view(np.int64), times=t)

    return docs.mapInArrow(run, "key long, first long, last long, gram long, whole long, times long")


def repeated(df: DataFrame, key: str) -> DataFrame:
    """The values of a key column that occur at least twice; counted before the shuffle."""
    return df.groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1").select(key)


def marked(df: DataFrame, key: str, base: DataFrame, *row: str) -> DataFrame:
    """`df` with `all`: whether the row's value of a key column occurs at least twice in `base`, a written table.

    Rows of a value that holds a large share, and rows without one, are dealt to `SALTS` groups by the
    columns `row`. At most `OFTEN` values can hold that share.
    """
    counts = base.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1")
    large = F.col("_n") > base.count() // OFTEN + SALTS
    often = counts.where(large).select(key, F.lit(True).alias("_often"))
    known = counts.select(key, F.lit(True).alias("all"), F.explode(
        F.when(large, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))).alias("_salt"))
    group = F.pmod(F.xxhash64(*row), F.lit(SALTS)).cast("int")
    dealt = df.join(F.broadcast(often), key, "left").withColumn("_salt", F.when(F.col("_often") | F.col(key).isNull(), group).otherwise(0))
    return dealt.join(known, [key, "_salt"], "left").drop("_salt", "_often").withColumn("all", F.coalesce("all", F.lit(False)))


def cells(segments: DataFrame, length: int, gram: int, cell: int) -> DataFrame:
    """(seg, first, last, core, whole): cells of the windows of undecided runs.

    `core` is the digest of what the cell's windows have in common with its place in the grid;
    `whole` that of the cell's text, or null where the run does not fill the cell.
    """
    def run(batches):
        for batch in batches:
            out = []
            for seg, text in zip(batch.column("seg").to_pylist(), batch.column("bytes").to_pylist()):
                data = np.frombuffer(text, np.uint8)
                n = len(data)
                roll = Rolling(data)
                first, last, least, h, _ = window_runs(roll, 0, n, length, gram)
                window = np.arange(n - length + 1)
                value = np.repeat(least, last - first + 1)
                distinct, number = np.unique(h, return_inverse=True)
                places = np.sort(number * (n + 1) + np.arange(len(h)))
                base = np.searchsorted(distinct, value) * (n + 1)
                anchor = places[np.searchsorted(places, base + window)] - base  # the first at or after the window
                grid = (anchor - window) // cell
                new = np.flatnonzero(np.r_[True, (grid[1:] != grid[:-1]) | (anchor[1:] != anchor[:-1])])
                stop = np.r_[new[1:], len(window)] - 1
                a, g = anchor[new], grid[new]
                begin = a - g * cell  # the last window of the full cell
                core = mix(roll.of(begin, begin + length - cell + 1) + g.astype(U64))
                full = stop - new == cell - 1
                whole = mix(roll.of(new, stop + length) + g.astype(U64)).view(np.int64)
                out.append((np.full(len(new), seg), new, stop, core.view(np.int64), whole, ~full))
            if out:
                s, a, b, c, w, partial = (np.concatenate(x) for x in zip(*out))
                yield table(seg=s, first=a, last=b, core=c, whole=pa.array(w, mask=partial))

    return segments.select("seg", "bytes").mapInArrow(run, "seg long, first long, last long, core long, whole long")


def suffixes(segments: DataFrame, length: int) -> DataFrame:
    """(lead, rest, seg, first): keys of the suffixes at the undecided windows `at` of a segment."""
    def run(batches):
        for batch in batches:
            out = []
            for seg, text, spans in zip(*(batch.column(c).to_pylist() for c in ("seg", "bytes", "spans"))):
                data = np.frombuffer(text, np.uint8)
                roll = Rolling(data)
                at = np.unique(np.concatenate([np.arange(s["first"], s["last"] + 1) for s in spans]))
                lead = np.ascontiguousarray(data[at[:, None] + np.arange(8)]).view(">u8").ravel().astype(U64)
                lead = (lead ^ U64(1 << 63)).view(np.int64)  # bytes in order as signed numbers
                out.append((lead, roll.of(at + 8, at + length).view(np.int64), np.full(len(at), seg), at))
            if out:
                lead, rest, seg, at = (np.concatenate(x) for x in zip(*out))
                yield table(lead=lead, rest=rest, seg=seg, first=at)

    return segments.mapInArrow(run, "lead long, rest long, seg long, first long")


def multikey_order(keys: list[np.ndarray]) -> np.ndarray:
    """Multikey quicksort: sort by the first key, then only what ties by the next."""
    order = np.argsort(keys[0], kind="quicksort")
    for depth in range(1, len(keys)):
        tied = np.zeros(len(order), bool)
        equal = np.ones(max(0, len(order) - 1), bool)
        for k in keys[:depth]:
            equal &= k[order[1:]] == k[order[:-1]]
        tied[1:] |= equal
        tied[:-1] |= equal
        at = np.flatnonzero(tied)
        if not len(at):
            break
        run = np.cumsum(np.r_[True, ~equal])[at]
        order[at] = order[at][np.lexsort((keys[depth][order[at]], run))]
    return order


def repeated_suffixes(keys: DataFrame) -> DataFrame:
    """(seg, first) of all suffixes whose key occurs at least twice."""
    spark = keys.sparkSession
    keys = kept(keys, "suffixes")
    total = keys.count()
    buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    every = max(1, total // SAMPLE)
    sample = keys.where(F.pmod(F.xxhash64("seg", "first"), F.lit(every)) == 0).select("lead", "rest")
    frequent = sample.groupBy("lead", "rest").count().where("count > 1").drop("count")
    sampled = sorted((r.lead, r.rest) for r in sample.limit(4 * SAMPLE).collect())
    splitters = [sampled[len(sampled) * i // buckets] for i in range(1, buckets)] if len(sampled) >= buckets else sampled
    leads = np.array([s[0] for s in splitters], np.int64)
    rests = np.array([s[1] for s in splitters], np.int64)

    def deal(batches):
        """Bucket: how many splitters are at or before the key."""
        for batch in batches:
            lead, rest = (np.asarray(batch.column(c)) for c in ("lead", "rest"))
            low, high = np.searchsorted(leads, lead, "left"), np.searchsorted(leads, lead, "right")
            for i in np.flatnonzero(low < high):
                low[i] += np.searchsorted(rests[low[i]:high[i]], rest[i], "right")
            yield table(bucket=pa.array(low, pa.int32()), **{c: batch.column(c) for c in ("lead", "rest", "seg", "first")})

    def compare(batches):
        """A bucket's rows in order of the leading key, in whole groups of it."""
        held = []

        def flush(rows):
            lead, rest, seg, first = (np.concatenate(x) for x in zip(*rows))
            order = multikey_order([lead, rest])
            same = (lead[order[1:]] == lead[order[:-1]]) & (rest[order[1:]] == rest[order[:-1]])
            hit = order[np.r_[False, same] | np.r_[same, False]]
            return table(seg=seg[hit], first=first[hit])

        size = 0
        for batch in batches:
            part = [np.asarray(batch.column(c)) for c in ("lead", "rest", "seg", "first")]
            held.append(part)
            size += len(part[0])
            if size >= 500_000:
                part = [np.concatenate(x) for x in zip(*held)]
                done = int(np.searchsorted(part[0], part[0][-1]))  # the last group may go on
                if done:
                    yield flush([[x[:done] for x in part]])
                held = [[x[done:] for x in part]]
                size = len(held[0][0])
        if size:
            yield flush(held)

    known = keys.join(F.broadcast(frequent), ["lead", "rest"]).select("seg", "first")  # at most the sample
    rest = keys.join(F.broadcast(frequent), ["lead", "rest"], "left_anti")
    dealt = rest.mapInArrow(deal, "bucket int, lead long, rest long, seg long, first long")
    found = dealt.repartition(buckets, "bucket").sortWithinPartitions("lead").drop("bucket").mapInArrow(compare, "seg long, first long")
    return known.unionByName(found)


def merge_spans(first: np.ndarray, last: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of bytes covered by the windows `first` to `last`; runs that touch are one."""
    order = np.argsort(first, kind="stable")
    starts, ends = first[order], np.maximum.accumulate(last[order] + length)
    new = np.flatnonzero(np.r_[True, starts[1:] > ends[:-1]])
    return starts[new], ends[np.r_[new[1:], len(starts)] - 1]


def text_key(text: str):
    """A key of the whole text: equal texts share their runs and results."""
    return F.xxhash64(F.octet_length(text), F.col(text), F.lit("key"))


def repeated_spans(docs: DataFrame, length: int = LENGTH, text: str = "text") -> DataFrame:
    """(key, spans): for each text with repeats, its removed runs as [start, end) in bytes.

    `key` is `text_key`. Texts shorter than `length` have none.
    """
    spark = prepare(docs.sparkSession)
    gram = max(9, min(GRAM, length // 4))
    cell = max(1, min(CELL, length // 8))
    texts = docs.select(F.col(text).alias("text")).where(F.octet_length("text") >= length).withColumn("key", text_key("text"))

    found = kept(anchors(texts, length, gram), "anchors")
    twice = found.groupBy("gram").agg(F.sum("times").alias("times")).where("times > 1").select("gram")
    runs = kept(found.drop("times").join(twice, "gram"), "runs")
    drop(found)
    found = kept(marked(runs, "whole", runs, "key", "first").select("key", "first", "last", "gram", "whole", "all"), "decided-runs")
    drop(runs)
    # What an undecided run is compared with: the others, and one of each repeated text with its gram.
    left = found.where("not all").drop("all", "whole").distinct()
    others = found.where("all").groupBy("whole").agg(F.min(F.struct("gram", "key", "first", "last")).alias("r")).select("r.*")
    others = others.join(left.select("gram").distinct(), "gram", "left_semi")
    runs = left.unionByName(others).groupBy("key").agg(F.collect_set(F.struct("first", "last")).alias("runs"))

    def cut(batches):
        for batch in batches:
            out = []
            for key, text, runs in zip(*(batch.column(c).to_pylist() for c in ("key", "text", "runs"))):
                raw = text.encode()
                out += [(key, r["first"], raw[r["first"]:r["last"] + length]) for r in runs]
            if out:
                k, a, t = zip(*out)
                yield table(key=pa.array(k, pa.int64()), start=pa.array(a, pa.int64()), bytes=pa.array(t, pa.binary()))

    segments = texts.dropDuplicates(["key"]).join(runs, "key").select("key", "text", "runs").mapInArrow(cut, "key long, start long, bytes binary")
    segments = segments.withColumn("seg", F.xxhash64("key", "start"))
    segments = kept(segments, "segments")
    found_cells = kept(cells(segments, length, gram, cell), "cells")
    # a whole cell that occurs twice has a core that does
    grid = marked(found_cells.join(repeated(found_cells, "core"), "core"), "whole", found_cells, "seg", "first")
    grid = kept(grid.select("seg", "first", "last", "core", "whole", "all"), "decided-cells")
    drop(found_cells)
    left = grid.where("not all").select("core", "seg", "first", "last")
    others = grid.where("all").groupBy("whole").agg(F.min(F.struct("core", "seg", "first", "last")).alias("r")).select("r.*")
    others = others.join(left.select("core").distinct(), "core", "left_semi")
    open_cells = left.unionByName(others).groupBy("seg").agg(F.collect_set(F.struct("first", "last")).alias("spans"))
    keyed = suffixes(segments.join(open_cells, "seg").select("seg", "bytes", "spans"), length)
    singles = repeated_suffixes(keyed)
    windows = grid.where("all").select("seg", "first", "last").unionByName(singles.withColumn("last", F.col("first")))
    inside = windows.join(segments.select("seg", "key", "start").distinct(), "seg").select(
        "key", (F.col("first") + F.col("start")).alias("first"), (F.col("last") + F.col("start")).alias("last"))
    spans = found.where("all").select("key", "first", "last").unionByName(inside)

    def join_up(batches):
        for batch in batches:
            out = []
            for spans in batch.column("spans").to_pylist():
                s, e = merge_spans(*(np.array([x[c] for x in spans], np.int64) for c in ("first", "last")), length)
                out.append([{"start": a, "end": b} for a, b in zip(s.tolist(), e.tolist())])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield table(key=batch.column("key"), spans=pa.array(out, kind))

    grouped = spans.distinct().groupBy("key").agg(F.collect_list(F.struct("first", "last")).alias("spans"))
    return grouped.mapInArrow(join_up, "key long, spans array<struct<start:long,end:long>>")


# In hexadecimal: the end of a character that a piece begins with, or the beginning of one at its end.
HALVES = "^(?:[89AB].){1,3}|(?:[CD].|E.(?:[89AB].)?|F.(?:[89AB].){0,2})$"


def remove_repeats(docs: DataFrame, length: int = LENGTH, text: str = "text", characters: bool = False) -> DataFrame:
    """`docs` with the columns n_bytes, n_removed, n_spans and kept (binary, the remaining bytes).

    Null texts are empty. Repeated rows are copies of each other. Matches never cross documents. A
    text that is shorter than `length` is kept whole. An empty table gives no rows. Other columns
    pass through; a column of `docs` with one of the four names is replaced. With `characters`, the
    rest of a character that a run cuts is not in `kept`, which then is valid UTF-8; the numbers stay.
    """
    spans = repeated_spans(docs, length, text)
    own = docs.columns
    whole = F.coalesce(F.col(text), F.lit(""))
    joined = docs.withColumn("_key", text_key(text)).join(
        spans.select(F.col("key").alias("_key"), F.col("spans").alias("_spans")), "_key", "left")
    body = whole.cast("binary")
    # Bytes between the removed runs.
    edges = F.concat(F.array(F.lit(0).cast("long")), F.flatten(F.transform("_spans", lambda s: F.array(s["start"], s["end"]))),
                     F.array(F.octet_length(whole).cast("long")))
    pieces = F.transform(
        F.sequence(F.lit(0), F.size("_spans")),
        lambda i: F.substring(F.col("_body"), F.element_at("_edges", 2 * i + 1).cast("int") + 1,
                              (F.element_at("_edges", 2 * i + 2) - F.element_at("_edges", 2 * i + 1)).cast("int")),
    )
    out = joined.withColumn("_body", body).withColumn("_edges", F.when(F.col("_spans").isNotNull(), edges))
    new = {
        "n_bytes": F.octet_length("_body").cast("long"),
        "n_removed": F.coalesce(F.aggregate("_spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"]), F.lit(0).cast("long")),
        "n_spans": F.when(F.col("_spans").isNull(), 0).otherwise(F.size("_spans")).cast("long"),
    }
    shown = (lambda piece: F.regexp_replace(F.hex(piece), HALVES, "")) if characters else F.hex
    kept = F.when(F.col("_spans").isNull(), F.col("_body")).otherwise(F.unhex(F.array_join(F.transform(pieces, shown), "")))
    return out.select(*[c for c in own if c not in (*new, "kept")], *[v.alias(k) for k, v in new.items()], kept.alias("kept"))
