"""Near-duplicate documents by 64-bit SimHash and Golay-code fuzzy hashing.

Fingerprints that differ in at most four bits are linked; components of links are groups of near
duplicates. To find links, a fingerprint is cut into segments of 23, 23 and 18 bits. Four errors
in three segments leave two segments with two errors together, so at most two in each. A segment
is extended by a parity bit to an even word of 24 bits and decoded by the extended binary Golay
code to all codewords within four bits: one, or the six of a sextet. Two segments that differ in
at most two bits always share one of these codewords, because the tetrads of a sextet partition
the 24 places. A key therefore names a pair of segments and one codeword index of each; linked
fingerprints share at least one key, and each pair that shares one is verified by its distance.

Exact copies are merged before keys are made. A key held by more than `PAIR_LIMIT` different
fingerprints is not compared pairwise: its fingerprints are linked through every word within two
bits of them, which finds the same links in linear work.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriframe.llm.arrays import U64, chunks, counts_by, prepare, table
from veriframe.session import shared_folder

RADIUS = 4
SEED = 42
SEGMENTS = ((0, 23), (23, 23), (46, 18))  # first bit and width
PAIR_LIMIT = 20_000
SMALL_RUN = 64
EDGES = 500_000  # that a task connects at a time


# --- fingerprints -------------------------------------------------------------------------------
def shingle_hashes(chunk, width: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of all shingles of lower-case words joined by spaces, and their documents."""
    data, starts, ends, owner = chunk.words()
    if not len(starts):
        return np.zeros(0, U64), owner
    lengths = ends - starts
    # Normalise: each word is followed by exactly one space.
    keep = np.zeros(len(data) + 1, np.int8)
    keep[starts] += 1
    keep[ends + 1] -= 1
    keep = np.cumsum(keep[:-1], dtype=np.int8).astype(bool)
    raw = data.copy()
    raw[ends] = 0x20
    raw = raw[keep].tobytes()
    first = np.concatenate(([0], np.cumsum(lengths + 1)[:-1]))
    last = first + lengths
    n_words = counts_by(owner, len(chunk.ends))
    first_word = np.cumsum(n_words) - n_words
    place = np.arange(len(starts)) - first_word[owner]
    size = np.minimum(n_words, width)[owner]  # a text with fewer words is one shingle
    begins = np.flatnonzero(place + size <= n_words[owner])
    stop = begins + size[begins] - 1
    digest = xxhash.xxh64_intdigest
    hashes = [digest(raw[a:b], SEED) for a, b in zip(first[begins].tolist(), last[stop].tolist())]
    return np.array(hashes, U64), owner[begins]


def majority(hashes: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """A fingerprint per document: a bit is 1 if it is set in over half of the hashes."""
    out = np.zeros(n, U64)
    counts = counts_by(owner, n)
    step = 1 << 16
    votes = np.zeros((n, 64), np.int64)
    for at in range(0, len(hashes), step):  # bounded memory for long texts
        part, own = hashes[at:at + step], owner[at:at + step]
        bits = np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        cuts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        votes[own[cuts]] += np.add.reduceat(bits, cuts, axis=0, dtype=np.int32)
    ones = (2 * votes > counts[:, None]).astype(np.uint8)
    out[:] = np.packbits(ones, axis=1).reshape(-1, 8).view(">u8").ravel()
    return out


def fingerprints(docs: DataFrame, width: int = 4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp): the 64-bit fingerprint of each row as a long. Null texts are empty; a text
    without words has fingerprint zero."""
    prepare(docs.sparkSession)
    id_type = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for rows, chunk in chunks(batch):
                fp = majority(*shingle_hashes(chunk, width), rows.num_rows)
                yield table(doc_id=rows.column("doc_id"), fp=pa.array(fp.view(np.int64)))

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        run, f"doc_id {id_type}, fp long"
    )


# --- Golay code ---------------------------------------------------------------------------------
GOLAY_GENERATOR = 0b101011100011  # fixed value: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1, and its unit term


def _encode(message: int) -> int:
    """Systematic codeword of the extended code: 12 message bits, 11 check bits, parity."""
    rest = message << 11
    for bit in range(22, 10, -1):
        if rest >> bit & 1:
            rest ^= GOLAY_GENERATOR << (bit - 11)
    word = message << 11 | rest
    return word << 1 | (word.bit_count() & 1)


def _code_tables() -> tuple[np.ndarray, np.ndarray]:
    """Check bits of each message, and for each syndrome its error patterns (up to six, -1 fills)."""
    checks = np.array([_encode(m) & 0xFFF for m in range(4096)], np.int64)
    patterns: list[list[int]] = [[] for _ in range(4096)]
    bits = [1 << i for i in range(24)]
    errors = [[0]]
    errors.append(bits)
    for _ in range(3):
        errors.append([e | b for e in errors[-1] for b in bits if b > e])
    for weight in (0, 2, 4):  # even words only
        for e in errors[weight]:
            s = int(checks[e >> 12]) ^ (e & 0xFFF)
            if not patterns[s] or patterns[s][0].bit_count() == weight:
                patterns[s].append(e)
    table_ = np.full((4096, 6), -1, np.int64)
    for s, found in enumerate(patterns):
        table_[s, :len(found)] = found
    return checks, table_


_tables: list = []


def codeword_keys(words: np.ndarray) -> np.ndarray:
    """(n, 6) codeword indices within four bits of each even-extended 23-bit word; -1 fills."""
    if not _tables:
        _tables.extend(_code_tables())
    checks, patterns = _tables
    x = words.astype(np.int64)
    x = x << 1 | (np.bitwise_count(x).astype(np.int64) & 1)
    found = patterns[checks[x >> 12] ^ (x & 0xFFF)]
    return np.where(found >= 0, (x[:, None] ^ found) >> 12, -1)


def golay_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the fingerprint, key) for all keys of the fingerprints."""
    decoded = [codeword_keys((fp >> U64(at)) & U64((1 << width) - 1)) for at, width in SEGMENTS]
    index, keys = [], []
    for pair, (a, b) in enumerate(((0, 1), (0, 2), (1, 2))):
        left, right = decoded[a][:, :, None], decoded[b][:, None, :]
        i, x, y = np.nonzero((left >= 0) & (right >= 0))
        index.append(i)
        keys.append(pair << 24 | decoded[a][i, x] << 12 | decoded[b][i, y])
    return np.concatenate(index), np.concatenate(keys)


# --- links within a key -------------------------------------------------------------------------
def _labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index of each component of an undirected graph."""
    label = np.arange(n)
    while True:
        left, right = label[a], label[b]
        apart = left != right
        if not apart.any():
            return label
        np.minimum.at(label, np.maximum(left, right)[apart], np.minimum(left, right)[apart])
        while not np.array_equal(label, up := label[label]):
            label = up


def _spread(fp: np.ndarray) -> np.ndarray:
    """Component label of each fingerprint of one key: breadth-first, each row compared once."""
    n = len(fp)
    label = np.full(n, -1)
    for seed in range(n):
        if label[seed] >= 0:
            continue
        label[seed], front = seed, np.array([seed])
        while len(front):
            rest = np.flatnonzero(label < 0)
            near = np.zeros(len(rest), bool)
            for block in np.array_split(front, -(-len(front) // 256)):
                far = ~near
                near[far] = (np.bitwise_count(fp[block][:, None] ^ fp[rest[far]][None, :]) <= RADIUS).any(0)
            front = rest[near]
            label[front] = seed
    return label


def key_links(key: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows sorted by key -> (a, b, kind): links that connect what the keys' rows connect.

    kind 1 marks a fingerprint (a = b) whose key has too many rows to compare.
    """
    cuts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    size = np.diff(np.r_[cuts, len(key)])
    run = np.repeat(np.arange(len(cuts)), size)
    small = size <= SMALL_RUN
    left, right = [], []
    active = np.flatnonzero(small[run] & (size[run] > 1))
    ends = (cuts + size)[run]
    for step in range(1, SMALL_RUN):
        active = active[active + step < ends[active]]
        if not len(active):
            break
        near = np.bitwise_count(fp[active] ^ fp[active + step]) <= RADIUS
        left.append(active[near])
        right.append(active[near] + step)
    label = _labels(len(key), *(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right)))
    over = []
    for r in np.flatnonzero(~small):
        part = slice(cuts[r], cuts[r] + size[r])
        if size[r] > PAIR_LIMIT:
            over.append(np.arange(part.start, part.stop))
        else:
            label[part] = part.start + _spread(fp[part])
    linked = np.flatnonzero(label != np.arange(len(key)))
    extra = np.concatenate(over) if over else np.zeros(0, np.int64)
    kind = np.r_[np.zeros(len(linked), np.int32), np.ones(len(extra), np.int32)]
    return np.r_[fp[linked], fp[extra]], np.r_[fp[label[linked]], fp[extra]], kind


def fingerprint_links(distinct: DataFrame) -> DataFrame:
    """(a, b): links that connect exactly the components of the different fingerprints `fp`."""
    spark = prepare(distinct.sparkSession)

    def expand(batches):
        for batch in batches:
            fp = np.asarray(batch.column("fp")).view(U64)
            i, key = golay_keys(fp)
            yield table(key=pa.array(key), fp=pa.array(fp[i].view(np.int64)))

    def compare(batches):
        held_k, held_f, seen = [], [], set()

        def flush(k, f):
            a, b, kind = key_links(k, f)
            rows = [x for x in dict.fromkeys(zip(a.tolist(), b.tolist(), kind.tolist())) if x not in seen]
            if len(seen) < 500_000:
                seen.update(rows)
            if rows:
                a, b, kind = zip(*rows)
                to = lambda v: pa.array(np.array(v, U64).view(np.int64))
                yield table(a=to(a), b=to(b), kind=pa.array(kind, pa.int32()))

        for batch in batches:
            held_k.append(np.asarray(batch.column("key")))
            held_f.append(np.asarray(batch.column("fp")).view(U64))
            if sum(map(len, held_k)) >= 200_000:
                k, f = np.concatenate(held_k), np.concatenate(held_f)
                done = int(np.searchsorted(k, k[-1]))  # the last key may go on
                held_k, held_f = [k[done:]], [f[done:]]
                if done:
                    yield from flush(k[:done], f[:done])
        if held_k and sum(map(len, held_k)):
            yield from flush(np.concatenate(held_k), np.concatenate(held_f))

    keyed = distinct.select("fp").mapInArrow(expand, "key long, fp long")
    found = keyed.repartition("key").sortWithinPartitions("key").mapInArrow(compare, "a long, b long, kind int")
    path = shared_folder(spark, "links")
    found.distinct().write.parquet(path)
    found = spark.read.schema(found.schema).parquet(path)
    links = found.where("kind = 0").select("a", "b")
    crowded = found.where("kind = 1").select(F.col("a").alias("fp")).distinct()
    if crowded.isEmpty():
        return links
    near = crowded.mapInArrow(_within_two, "word long, fp long")
    meets = near.groupBy("word").agg(F.min("fp").alias("b"))
    return links.unionByName(near.join(meets, "word").where("fp <> b").select(F.col("fp").alias("a"), "b")).distinct()


def _within_two(batches):
    flips = [0] + [1 << i for i in range(64)] + [1 << i | 1 << j for i in range(64) for j in range(i)]
    masks = np.array(flips, U64)
    for batch in batches:
        fps = np.asarray(batch.column("fp")).view(U64)
        for part in np.array_split(fps, max(1, len(fps) // 100)):
            words = (part[:, None] ^ masks[None, :]).ravel().view(np.int64)
            yield table(word=pa.array(words), fp=pa.array(np.repeat(part, len(masks)).view(np.int64)))


# --- components ---------------------------------------------------------------------------------
def contracted(edges: DataFrame) -> DataFrame:
    """(a, b) with a > b: the edges of each task, up to `EDGES` at a time, as stars around their smallest nodes."""
    most = EDGES

    def stars(a, b):
        nodes, ends = np.unique(np.concatenate([*a, *b]), return_inverse=True)
        left, right = np.split(ends, 2)
        label = _labels(len(nodes), left, right)
        leaf = np.flatnonzero(label != np.arange(len(nodes)))
        return table(a=nodes[leaf], b=nodes[label[leaf]])

    def run(batches):
        a, b, size = [], [], 0
        for batch in batches:
            a.append(np.asarray(batch.column("a")))
            b.append(np.asarray(batch.column("b")))
            size += batch.num_rows
            if size >= most:
                yield stars(a, b)
                a, b, size = [], [], 0
        if size:
            yield stars(a, b)

    return edges.mapInArrow(run, "a long, b long")


def are_stars(edges: DataFrame) -> bool:
    """Whether each node of the edges (a, b) is either the a of one or the b of any number."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("up")))
    counts = ends.groupBy("node").agg(F.sum("up").alias("up"), F.min("up").alias("least"))
    return counts.where("up > 1 or (up = 1 and least = 0)").isEmpty()


def connected(links: DataFrame) -> DataFrame:
    """(node, root) for all nodes of undirected links: alternating large and small stars.

    Each task first connects the edges it has, so that rounds only join up what lies in several.
    A round is written to the shared folder, which cuts the lineage, and the last is the one whose
    edges are stars: no further round has to show that nothing changes.
    """
    spark = prepare(links.sparkSession)

    def kept(df: DataFrame) -> DataFrame:
        path = shared_folder(spark, "stars")
        contracted(df.distinct()).write.parquet(path)
        return spark.read.schema("a long, b long").parquet(path)

    edges = kept(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
    while not are_stars(edges):
        both = edges.union(edges.select("b", "a"))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        large = large.where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(least, "a").select(F.explode(F.array(
            F.struct(F.col("b").alias("a"), F.col("low").alias("b")),
            F.struct(F.col("a"), F.col("low").alias("b")))).alias("e")).select("e.*").where("a <> b")
        edges = kept(small)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(docs: DataFrame, width: int = 4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) per row of `docs`; component_id is the smallest doc_id reachable.

    Rows with equal fingerprints are one node, also those without words. Repeated rows stay
    repeated. Rows without doc_id keep null there and get the smallest id of their group, or null.
    An empty table gives no rows. Other columns of `docs` are not read.
    """
    spark = docs.sparkSession
    path = shared_folder(spark, "fingerprints")
    fingerprints(docs, width, doc_id, text).write.parquet(path)
    fps = spark.read.parquet(path)
    reps = fps.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    roots = connected(fingerprint_links(reps)).withColumnRenamed("node", "fp")
    reps = reps.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = reps.groupBy("root").agg(F.min("first_id").alias("component_id"))
    members = reps.join(least, "root").select("fp", "component_id")
    return fps.join(members, "fp").select("doc_id", "fp", "component_id")


def hex_digits(fp: str):
    """16 lower-case hexadecimal digits of a long column."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
