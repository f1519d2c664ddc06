"""Document fingerprints: SimHash over weighted terms, and search by permuted block tables.

Terms are pairs of neighbouring lower-case words (a text of one word has that word), weighted by
one plus the whole part of the binary logarithm of how often they occur. Each term's 128-bit hash
votes with its weight on every bit; a bit is one if over half of the weight votes for it. The
likeness of two fingerprints is the share of their bits that are equal: about one half for
unrelated texts, one for equal ones.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriframe.llm.arrays import CHUNK_BYTES, U64, Chunk, Rolling, counts_by, mix, pair_hash, prepare, table
from veriframe.llm.simhash_dedup import connected
from veriframe.session import shared_folder

BITS = 128
RADIUS = 3
CROWDED = 20_000


def simhash(texts: list[str]) -> np.ndarray:
    """(n, 2): the two 64-bit halves of each text's fingerprint; zero for texts without words."""
    n = len(texts)
    chunk = Chunk(pa.array(texts, pa.string()))
    data, starts, ends, owner = chunk.words()
    word = Rolling(data).of(starts, ends)
    words = counts_by(owner, n)
    pairs = owner[1:] == owner[:-1]
    single = words[owner] == 1
    term = np.r_[pair_hash(word[:-1], word[1:])[pairs], word[single]]
    owner = np.r_[owner[1:][pairs], owner[single]]
    order = np.lexsort((term, owner))
    term, owner = term[order], owner[order]
    out = np.zeros((n, 2), U64)
    if not len(term):
        return out
    new = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (owner[1:] != owner[:-1])])
    times = np.diff(np.r_[new, len(term)])
    term, owner = term[new], owner[new]
    weight = (np.frexp(times)[1]).astype(np.uint8)  # 1 + floor(log2)
    total = np.bincount(owner, weight, n).astype(np.int64)
    for half in (0, 1):
        votes = np.zeros((n, 64), np.int64)
        for at in range(0, len(term), 1 << 16):  # bounded memory for long texts
            own = owner[at:at + (1 << 16)]
            hashed = mix(term[at:at + (1 << 16)] + U64(half))
            bits = np.unpackbits(hashed.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
            bits *= weight[at:at + (1 << 16), None]
            cuts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            votes[own[cuts]] += np.add.reduceat(bits, cuts, axis=0, dtype=np.int32)
        ones = (2 * votes > total[:, None]).astype(np.uint8)
        out[:, half] = np.packbits(ones, axis=1).reshape(-1, 8).view(">u8").ravel()
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return 1 - np.bitwise_count(a ^ b).sum(1) / BITS


def digits(fp: np.ndarray) -> list[str]:
    return [f"{a:016x}{b:016x}" for a, b in fp.tolist()]


def edit(text: str, following: str) -> str:
    """The last third of a text replaced by the beginning of another."""
    third = len(text) // 3
    return text[:len(text) - third] + following[:third]


def compared(ids: list, texts: list[str], prints: np.ndarray):
    """Result columns of all but the last of some neighbouring texts."""
    changed = [edit(a, b) for a, b in zip(texts, texts[1:])]
    other = simhash(changed)
    return {
        "doc_id": ids[:-1], "n_chars": [len(t) for t in texts[:-1]],
        "edited_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in changed],
        "fingerprint": digits(prints[:-1]), "edited_fingerprint": digits(other),
        "near_edited": likeness(prints[:-1], other), "near_next": likeness(prints[:-1], prints[1:]),
    }


RESULT = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def with_neighbours(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each row's fingerprint, compared with its edited text's and the next row's.

    Rows stand in order of descending doc_id, after the last comes the first. Rows without doc_id
    stand last; rows of one doc_id in order of their texts' hashes. A table of one row is its own
    next. Null texts are empty; texts without words have fingerprint zero. An empty table gives no
    rows. Other columns are not read.

    Range partitions hold neighbours; the first and the last text of each partition are joined
    in a second step, two rows for each partition.
    """
    spark = prepare(docs.sparkSession)
    id_type = docs.schema[doc_id].dataType.simpleString()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    order = [F.col("doc_id").desc_nulls_last(), F.col("tie")]
    schema = f"doc_id {id_type}, {RESULT}, part int, last boolean, text string"
    kind = docs.select(F.col(doc_id).alias("doc_id"))

    def result(columns, part, last, text):
        n = len(columns["doc_id"])
        ids = pa.array(columns.pop("doc_id"), id_kind)
        return table(doc_id=ids, **columns, part=pa.array([part] * n, pa.int32()), last=pa.array([last] * n, pa.bool_()),
                     text=pa.array([text] * n, pa.string()))

    from pyspark.sql.pandas.types import to_arrow_type

    id_kind = to_arrow_type(kind.schema["doc_id"].dataType)
    edge = {"n_chars": [0], "edited_sha256": [""], "fingerprint": [""], "edited_fingerprint": [""], "near_edited": [0.0], "near_next": [0.0]}

    def run(batches):
        part = TaskContext.get().partitionId()
        held_ids, held, prints, first = [], [], None, None
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            if first is None and texts:
                first = (ids[0], texts[0])
            at = 0
            while at < len(texts):
                stop, size = at, 0
                while stop < len(texts) and (stop == at or size + len(texts[stop]) <= CHUNK_BYTES):
                    size += len(texts[stop])
                    stop += 1
                held_ids, held = held_ids[-1:] + ids[at:stop], held[-1:] + texts[at:stop]
                new = simhash(texts[at:stop])
                prints = new if prints is None else np.concatenate([prints[-1:], new])
                if len(held) > 1:
                    yield result(compared(held_ids, held, prints), part, None, None)
                at = stop
        if first is not None:  # the edges of the partition
            yield result({"doc_id": [first[0]], **edge}, part, False, first[1])
            yield result({"doc_id": [held_ids[-1]], **edge}, part, True, held[-1])

    path = shared_folder(spark, "neighbours")
    rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(run, schema).write.parquet(path)
    found = spark.read.parquet(path)
    edges = found.where("last is not null").select("doc_id", "part", "last", "text")
    used = sorted(r.part for r in edges.where("last").select("part").collect())  # a number per partition
    following = spark.createDataFrame(list(zip(used, used[1:] + used[:1])), "part int, next int")
    heads = edges.where("not last").select(F.col("part").alias("next"), F.col("text").alias("next_text"))
    ends = edges.where("last").join(following, "part").join(heads, "next").select("doc_id", "text", "next_text")

    def close(batches):
        for batch in batches:
            ids, texts, nexts = (batch.column(c).to_pylist() for c in ("doc_id", "text", "next_text"))
            for d, a, b in zip(ids, texts, nexts):
                yield result(compared([d, None], [a, b], simhash([a, b])), 0, None, None)

    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    return found.where("last is null").select(*names).unionByName(ends.mapInArrow(close, schema).select(*names))


def pairs_within(prints: DataFrame, radius: int, blocks: int) -> DataFrame:
    """(a, b, distance): all pairs of different fingerprints (hexadecimal) at most `radius` bits apart.

    The bits are cut into `blocks` blocks, more than `radius`. Errors touch at most `radius` of
    them, so two such fingerprints agree on `blocks - radius` others; there is one table for each
    choice of these blocks, keyed by them, and pairs that meet in a table are verified.
    """
    if blocks <= radius:
        raise ValueError("more blocks than errors are needed")
    width = BITS // 4
    cuts = [width * i // blocks for i in range(blocks + 1)]
    part = [F.substring("fp", cuts[i] + 1, cuts[i + 1] - cuts[i]) for i in range(blocks)]
    keys = [F.concat(F.lit(f"{n}:"), *[part[i] for i in kept])
            for n, kept in enumerate(itertools.combinations(range(blocks), blocks - radius))]
    half = lambda side, at: F.conv(F.substring(f"{side}.fp", at, 16), 16, -10).cast("long")
    distance = sum(F.bit_count(half("l", at).bitwiseXOR(half("r", at))) for at in (1, 17))
    tables = prints.select("fp").distinct().withColumn("key", F.explode(F.array(*keys)))
    met = tables.alias("l").join(tables.alias("r"), (F.col("l.key") == F.col("r.key")) & (F.col("l.fp") < F.col("r.fp")) & (distance <= radius))
    return met.select(F.col("l.fp").alias("a"), F.col("r.fp").alias("b"), distance.alias("distance")).distinct()


def _spread(fp: np.ndarray) -> np.ndarray:
    """Component label of each of some (n, 2) fingerprints: breadth-first, each row compared once."""
    label = np.full(len(fp), -1)
    for seed in range(len(fp)):
        if label[seed] >= 0:
            continue
        label[seed], front = seed, np.array([seed])
        while len(front):
            rest = np.flatnonzero(label < 0)
            near = np.zeros(len(rest), bool)
            for at in front:
                near |= np.bitwise_count(fp[rest] ^ fp[at]).sum(1, dtype=np.int64) <= RADIUS
            front = rest[near]
            label[front] = seed
    return label


def near_links(prints: DataFrame) -> DataFrame:
    """(a, b): links that connect exactly the components of different fingerprints (node, fp) at
    most `RADIUS` bits apart.

    Each of four tables is keyed by one block of 32 bits; three errors leave one block equal. A key
    of more than `CROWDED` fingerprints is split by quarters of the other 96 bits, one of which is
    equal again in each linked pair.
    """
    prepare(prints.sparkSession)
    blocks = RADIUS + 1
    width = BITS // 4 // blocks
    part = lambda x, i, size: F.substring(x, i * size + 1, size)
    half = lambda at: F.conv(F.substring("fp", at, 16), 16, -10).cast("long")
    rest = lambda i: F.concat(F.substring("fp", 1, i * width), F.substring("fp", (i + 1) * width + 1, BITS))
    tables = prints.select("node", "fp", F.explode(F.array(*[F.lit(i) for i in range(blocks)])).alias("block"))
    key = F.xxhash64("block", F.substr("fp", F.col("block") * width + 1, F.lit(width)))
    tables = tables.select("node", half(1).alias("left"), half(17).alias("right"), key.alias("key"), "block", "fp")
    crowded = tables.groupBy("key").agg(F.count("*").alias("members")).where(F.col("members") > CROWDED).select("key")
    rows = tables.select("key", "node", "left", "right")
    if not crowded.isEmpty():
        others = F.when(F.col("block") == 0, rest(0))
        for i in range(1, blocks):
            others = others.when(F.col("block") == i, rest(i))
        size = width * (blocks - 1) // blocks
        split = tables.join(crowded, "key").withColumn("others", others)
        split = split.select(F.explode(F.array(*[F.xxhash64("key", F.lit(i), part("others", i, size)) for i in range(blocks)])).alias("key"), "node", "left", "right")
        rows = rows.join(crowded, "key", "left_anti").unionByName(split)

    def compare(batches):
        held, have = [], 0

        def links(rows):
            key = rows[:, 0]
            cuts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            ends = np.r_[cuts[1:], len(key)]
            found = []
            for a, b in zip(cuts[ends - cuts > 1].tolist(), ends[ends - cuts > 1].tolist()):
                label = _spread(rows[a:b, 2:].view(U64))
                linked = np.flatnonzero(label != np.arange(b - a))
                found.append(np.c_[rows[a:b, 1][linked], rows[a:b, 1][label[linked]]])
            found = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)
            return table(a=pa.array(found[:, 0]), b=pa.array(found[:, 1]))

        for batch in batches:
            held.append(np.stack([np.asarray(batch.column(c)) for c in ("key", "node", "left", "right")], axis=1))
            have += batch.num_rows
            if have >= 200_000:
                rows_ = np.concatenate(held)
                done = int(np.searchsorted(rows_[:, 0], rows_[-1, 0]))  # the last key may go on
                held, have = [rows_[done:]], len(rows_) - done
                if done:
                    yield links(rows_[:done])
        if have:
            yield links(np.concatenate(held))

    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(compare, "a long, b long").distinct()


def with_classes(found: DataFrame) -> DataFrame:
    """`found` (doc_id, fingerprint, ...) with near_class: the smallest doc_id among the rows whose
    fingerprints can be reached in steps of at most `RADIUS` bits; null if none of them has one."""
    spark = found.sparkSession
    path = shared_folder(spark, "prints")
    prints = found.groupBy(F.col("fingerprint").alias("fp")).agg(F.min("doc_id").alias("first"))
    prints.withColumn("node", F.monotonically_increasing_id()).write.parquet(path)
    prints = spark.read.parquet(path)
    roots = connected(near_links(prints.select("node", "fp")))
    prints = prints.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = prints.groupBy("root").agg(F.min("first").alias("near_class"))
    return found.join(prints.join(least, "root").select(F.col("fp").alias("fingerprint"), "near_class"), "fingerprint").select(
        *found.columns, "near_class")
