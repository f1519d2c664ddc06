"""Near-duplicate documents: SimHash with Golay keys, checked and completed by the Jaccard similarity of word shingles.

Two texts are linked if their sets of shingles (five words; a text with fewer is one shingle) have
a Jaccard similarity of at least 0.8; components of links are groups. Links come in two steps.

First, each different set gets a 64-bit SimHash, and Golay keys find the fingerprints that differ in
at most four bits (`simhash_dedup`); every pair found is verified by its sets. This finds close
copies. Pairs of similarity 0.8 lie up to some fifteen bits apart, where no such key reaches.

So what is not connected by then is looked for by MinHash: `BANDS` keys of `ROWS` minima each. A
pair of similarity 0.8 shares no key with a probability of (1 - 0.8**4)**32, or 5 in 10**8, and less
above. Every candidate pair is verified by its sets.

Equal sets are merged before fingerprints and keys are made. Pairs are not listed for whole groups:
a set is compared with one of its fingerprint, fingerprints with one of their key, and each member
of a MinHash key with one of its members. What shares a key and is not connected by then is compared
in a way that finds every similar pair and few others: shingles are ordered from rare to frequent,
similar sets share one of their first shingles, and the places of a shared one bound the similarity.
Comparing what is connected already could not change a component, so all similar pairs that share a
key are in one group.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriframe.llm.arrays import U64, chunks, mix, pair_hash, prepare, table
from veriframe.llm.scratch import drop, kept
from veriframe.llm.simhash_dedup import connected, fingerprint_links, majority, shingle_hashes

BANDS, ROWS = 32, 4
_random = np.random.default_rng(20240611)
FLIPS = _random.integers(0, 2**64, BANDS * ROWS, dtype=U64)
FACTORS = _random.integers(0, 2**63, BANDS * ROWS, dtype=U64) * U64(2) + U64(1)


def shingle_sets(chunk, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Different shingle hashes of each document in order, and where each document's end."""
    hashes, owner = shingle_hashes(chunk, width)
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    if len(hashes):
        new = np.r_[True, (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])]
        hashes, owner = hashes[new], owner[new]
    return hashes, np.searchsorted(owner, np.arange(len(chunk.ends)), "right")


def band_keys(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """(n, BANDS) keys of the sets that start at `starts`; none is empty."""
    keys = np.zeros((len(starts), BANDS), U64)
    for band in range(BANDS):
        key = np.full(len(starts), band, U64)
        for i in range(band * ROWS, (band + 1) * ROWS):
            key = pair_hash(key, np.minimum.reduceat(mix(hashes ^ FLIPS[i]) * FACTORS[i], starts))
        keys[:, band] = key
    return keys


def _sketches(numbered: DataFrame, width: int, text: str) -> DataFrame:
    """(_row, n, digest, fp, keys): size, digest, SimHash and MinHash keys of each row's set."""

    def run(batches):
        for batch in batches:
            for rows, chunk in chunks(batch):
                hashes, ends = shingle_sets(chunk, width)
                sizes = np.diff(ends, prepend=0)
                fp = majority(hashes, np.repeat(np.arange(len(ends)), sizes), len(ends))
                raw = hashes.tobytes()
                digests = [hashlib.blake2b(raw[8 * (b - n):8 * b], digest_size=16).hexdigest() for b, n in zip(ends.tolist(), sizes.tolist())]
                keys: list = [[]] * len(ends)
                full = np.flatnonzero(sizes)
                if len(full):
                    for i, k in zip(full.tolist(), band_keys(hashes, (ends - sizes)[full]).view(np.int64)):
                        keys[i] = k
                yield table(_row=rows.column("_row"), n=pa.array(sizes), digest=pa.array(digests, pa.string()), fp=pa.array(fp.view(np.int64)),
                            keys=pa.array(keys, pa.list_(pa.int64())))

    return numbered.select("_row", F.col(text).alias("text")).mapInArrow(run, "_row long, n long, digest string, fp long, keys array<long>")


def _sets(rows: DataFrame, width: int) -> DataFrame:
    """(node, shingles) of (node, text)."""

    def run(batches):
        for batch in batches:
            for part, chunk in chunks(batch):
                hashes, ends = shingle_sets(chunk, width)
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), pa.array(hashes.view(np.int64)))
                yield table(node=part.column("node"), shingles=lists)

    return rows.mapInArrow(run, "node long, shingles array<long>")


def prefix_pairs(open_: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, an, b, bn): pairs of (node, n, root) with different roots, all similar ones among them.

    The order of shingles is the same for all nodes. Two similar sets of sizes x and y share
    m >= (x + y) * percent / (100 + percent) shingles; the first shared one has at least m in each
    set from its place on.
    """
    each = kept(sets.join(open_, "node").select("node", "n", "root", F.explode("shingles").alias("shingle")), "shingles")
    often = each.groupBy("shingle").agg(F.count("*").alias("times")).where("times > 1")
    shared = each.join(often, "shingle").groupBy("node", "n", "root").agg(
        F.sort_array(F.collect_list(F.struct("times", "shingle"))).alias("shared"))
    # Shingles of one node alone come first in the order and meet nothing.
    rows = shared.select("node", "n", "root", F.size("shared").alias("size"), F.posexplode("shared").alias("i", "s")).select(
        "node", "n", "root", (F.col("size") - F.col("i")).alias("rest"), F.col("s.shingle").alias("shingle"))
    rows = kept(rows.where(F.col("rest") * 100 >= F.col("n") * percent), "prefixes")
    drop(each)
    # The largest root of a shingle is one side only: its nodes are connected with each other.
    sizes = rows.groupBy("shingle", "root").agg(F.count("*").alias("times"))
    large = sizes.groupBy("shingle").agg(F.max(F.struct("times", "root")).alias("large"), F.count("*").alias("roots")).where("roots > 1")
    rows = kept(rows.join(large.select("shingle", F.col("large.root").alias("large")), "shingle"), "meeting")
    left = rows.where("root <> large").select("shingle", F.col("node").alias("a"), F.col("n").alias("an"), F.col("root").alias("a_root"), F.col("rest").alias("a_rest"))
    right = rows.select("shingle", F.col("node").alias("b"), F.col("n").alias("bn"), F.col("root").alias("b_root"), F.col("rest").alias("b_rest"), "large")
    enough = F.least("a_rest", "b_rest") * (100 + percent) >= (F.col("an") + F.col("bn")) * percent
    return left.join(right, "shingle").where("a_root <> b_root and (a < b or b_root = large)").where(enough).select("a", "an", "b", "bn")


def extended(roots: DataFrame, links: DataFrame) -> DataFrame:
    """(node, root) after more links (a, b): only the roots that these connect are connected anew."""
    named = roots.select(F.col("node").alias("a"), F.col("root").alias("a_root"))
    ends = links.join(named, "a", "left").join(named.withColumnsRenamed({"a": "b", "a_root": "b_root"}), "b", "left")
    more = connected(ends.select(F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b")).distinct())
    tops = more.select(F.col("node").alias("root"), F.col("root").alias("top"))
    moved = roots.join(tops, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    return kept(moved.unionByName(more.join(roots, "node", "left_anti")), "roots")


def fingerprint_pairs(nodes: DataFrame) -> DataFrame:
    """(a, an, b, bn): pairs of (node, n, fp) that connect fingerprints of at most four different bits.

    A node meets the first one of its fingerprint, and first ones meet as Golay keys link their fingerprints.
    """
    first = kept(nodes.groupBy("fp").agg(F.min(F.struct("node", "n")).alias("first")), "fingerprints")
    equal = nodes.join(first, "fp").where("node <> first.node").select(
        F.col("node").alias("a"), F.col("n").alias("an"), F.col("first.node").alias("b"), F.col("first.n").alias("bn"))
    ends = [first.select(F.col("fp").alias(c), F.col("first.node").alias(f"{c}_node"), F.col("first.n").alias(f"{c}n")) for c in "ab"]
    near = fingerprint_links(first.select("fp")).join(ends[0], "a").join(ends[1], "b")
    return equal.unionByName(near.select(F.col("a_node").alias("a"), "an", F.col("b_node").alias("b"), "bn"))


def similar_links(keyed: DataFrame, sets: DataFrame, percent: int, close: DataFrame) -> DataFrame:
    """(node, root) of all nodes with links: those of `close` and of (key, node, n) with a common key that have similar sets.

    `close` has pairs (a, an, b, bn); they are compared first.
    """

    def similar(pairs: DataFrame) -> DataFrame:
        """Those of the pairs (a, an, b, bn) whose sets are similar; sizes tell most others."""
        pairs = pairs.where(F.least("an", "bn") * 100 >= F.greatest("an", "bn") * percent)
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        both = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("left")), "a")
        both = both.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("right")), "b")
        shared, sizes = F.size(F.array_intersect("left", "right")), F.size("left") + F.size("right")
        return both.where(shared * (100 + percent) >= sizes * percent).select("a", "b")

    roots = connected(kept(similar(close), "links"))
    for seeded in (True, False):
        open_ = keyed.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        mixed = open_.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key")
        open_ = kept(open_.join(mixed, "key", "left_semi"), "open")
        if seeded:
            seeds = open_.groupBy("key").agg(F.min(F.struct("node", "n", "root")).alias("seed"))
            seeds = seeds.select("key", F.col("seed.node").alias("b"), F.col("seed.n").alias("bn"), F.col("seed.root").alias("b_root"))
            pairs = open_.withColumnsRenamed({"node": "a", "n": "an"}).join(seeds, "key").where("root <> b_root")
            pairs = pairs.select("a", "an", "b", "bn")
        else:
            pairs = prefix_pairs(open_.select("node", "n", "root").distinct(), sets, percent)
        found = kept(similar(pairs), "links")
        if not found.isEmpty():
            roots = extended(roots, found)
    return roots


def first_rows(docs: DataFrame, width: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs` that have the smallest doc_id of their group of near duplicates, one of each.

    Texts that differ only in blanks, in letters A-Z and a-z or in repeated shingles are equal, also
    those without words; null texts are empty. A row without doc_id stays only if no other of its
    group has one. An empty table gives no rows.
    """
    spark = prepare(docs.sparkSession)
    numbered = kept(docs.withColumn("_row", F.monotonically_increasing_id()), "numbered")
    rows = kept(_sketches(numbered, width, text), "sketches")
    first = F.min(F.struct(F.col(doc_id).isNull(), F.col(doc_id), F.col("_row"))).alias("first")
    reps = rows.select("_row", "digest").join(numbered.select("_row", doc_id), "_row").groupBy("digest").agg(first)
    reps = kept(reps.select("first", F.col("first._row").alias("node")), "different")
    keyed = rows.join(reps.select(F.col("node").alias("_row")), "_row", "left_semi").select(
        F.explode("keys").alias("key"), F.col("_row").alias("node"), "n")
    shared = keyed.groupBy("key").agg(F.count("*").alias("members")).where("members > 1").select("key")
    keyed = kept(keyed.join(shared, "key", "left_semi"), "keyed")
    nodes = rows.join(reps.select(F.col("node").alias("_row")), "_row", "left_semi").select(F.col("_row").alias("node"), "n", "fp")
    close = kept(fingerprint_pairs(nodes), "close")
    compared = keyed.select("node").unionByName(close.select(F.explode(F.array("a", "b")).alias("node"))).distinct()
    texts = numbered.select(F.col("_row").alias("node"), F.col(text).alias("text")).join(compared, "node", "left_semi")
    roots = similar_links(keyed, kept(_sets(texts, width), "sets"), percent, close)
    groups = reps.join(roots, "node", "left").groupBy(F.coalesce("root", "node")).agg(F.min("first").alias("first"))
    return numbered.join(groups.select("first._row"), "_row", "left_semi").select(*docs.columns)
