"""Alignment of two tokenizers' tokens over the same bytes, by interval coalescing.

A text's tokens by tokenizer A and by B are two rows of byte intervals. All are sorted by start; a
group ends where a start reaches the running maximum of all ends before it, that is where A and B
tokens both end. Inside a group every A token is linked to the B tokens whose bytes overlap its own.

Texts are cut into units, a run of white space and what follows it, at places that no token of
either tokenizer can cross; a unit's tokens are then the text's tokens there, and every different
unit is encoded and aligned once by a worker, all new ones of a chunk together. Which white space may
begin a unit is read from the vocabulary; texts with rarer white space, and all texts of tokenizers
of another kind, are one unit each. What a worker remembers is bounded by `REMEMBERED_BYTES` and never changes
a result.

How often a pair of ids is linked in the corpus is counted in Spark and stored as sorted arrays in
the shared folder, one for each range of B ids, which workers map into memory. It has a row for each
pair that occurs, at most the product of the two vocabularies.
"""

from __future__ import annotations

import json
import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veriframe.llm.arrays import U64, Rolling, add_up, find, memory, prepare, read_array, table, write_array
from veriframe.llm.wordpiece_ids import _byte_characters, gather
from veriframe.session import shared_folder

CHUNK_BYTES = 1 << 20
REMEMBERED_BYTES = 160 << 20
LONG = 4096  # characters; longer units are encoded alone
HELD_PAIRS = 1 << 18
BUCKETS = 64  # ranges of B ids; a file of pairs each
WHITE = b" \t\n\x0b\x0c\r"
RARE_WHITE = re.compile(r"[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
RARE_OR_WHITE = frozenset(WHITE.decode() + "".join(map(chr, (*range(0x1c, 0x20), 0x85, 0xa0, 0x1680, *range(0x2000, 0x200b), 0x2028, 0x2029, 0x202f, 0x205f, 0x3000))))


class Tokenizers:
    """Both tokenizers, the bytes of their tokens, and where texts may be cut."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        letters = {c: b for b, c in _byte_characters().items()}
        vocabulary = self.a.get_vocab(with_added_tokens=True)
        self.bytes_a = [b""] * (max(vocabulary.values(), default=-1) + 1)
        for token, i in vocabulary.items():
            self.bytes_a[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.mark = self.b.piece_to_id("▁")
        with open(path_a, encoding="utf-8") as f:
            spec = json.load(f)
        before = spec.get("pre_tokenizer") or {}
        usual = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not spec.get("normalizer")
        # white space that no piece of B has behind another character; the blank's mark may follow itself
        free = [w for w in WHITE if not any(self._inside(p, chr(w)) for i, p in enumerate(pieces) if not self.b.is_byte(i))]
        self.length_a, self.length_b = (np.array([len(x) for x in names], np.int64) for names in (self.bytes_a, self.bytes_b))
        self.begins = np.zeros(256, bool)
        self.begins[free if usual and 0x20 in free and self.mark != self.b.unk_id() else []] = True
        self.cuts = bool(self.begins.any())
        self.white = np.zeros(256, bool)
        self.white[list(WHITE)] = True

    @staticmethod
    def _inside(piece: str, white: str) -> bool:
        if white == " ":
            return any(c == "▁" and piece[i] != "▁" for i, c in enumerate(piece[1:]))
        return white in piece[1:]

    def encode(self, units: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """(ids by A, by B), (tokens of each unit by A, by B), all units in a row.

        The blank that B puts before a text stands for the unit's own first one.
        """
        b = self.b.encode([u[1:] if u[:1] == " " else u for u in units], num_threads=1)
        for i in [i for i, u in enumerate(units) if u[:1] != " " or len(u) == 1]:
            if len(units[i]) == 1 and units[i] == " ":
                b[i] = [self.mark]  # B gives nothing for nothing
            else:
                # begins with other white space, which never joins the blank before it
                b[i] = b[i][1:] if b[i][:1] == [self.mark] else [self.b.unk_id()]
        ids_a, sizes_a = self._encode_a(units)
        sizes_b = np.fromiter(map(len, b), np.int64, len(b))
        return [ids_a, np.fromiter(chain.from_iterable(b), np.int64, int(sizes_b.sum()))], [sizes_a, sizes_b]

    def _encode_a(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Units that begin with white space and end with another character have the same tokens in a row as alone."""
        n = len(units)
        plain = [len(u) < LONG and self.cuts and ord(u[0]) < 256 and self.begins[ord(u[0])] and u[-1] not in RARE_OR_WHITE
                 and (u.isascii() or not RARE_WHITE.search(u)) for u in units]
        at = np.flatnonzero(plain)
        alone = np.flatnonzero(~np.array(plain, bool))
        row = [u for u, x in zip(units, plain) if x]
        ids = np.array(self.a.encode_batch_fast(["".join(row)], add_special_tokens=False)[0].ids if row else [], np.int64)
        ends = np.cumsum([len(u) if u.isascii() else len(u.encode()) for u in row], dtype=np.int64)
        stops = np.searchsorted(np.cumsum(self.length_a[ids]), ends, "right")  # tokens up to the end of each unit
        others = [np.array(e.ids, np.int64) for e in self.a.encode_batch_fast([units[i] for i in alone], add_special_tokens=False)]
        sizes = np.zeros(n, np.int64)
        sizes[at] = np.diff(stops, prepend=0)
        sizes[alone] = [len(x) for x in others]
        if not len(alone):
            return ids, sizes
        flat = np.zeros(int(sizes.sum()), np.int64)
        own = np.zeros(n, bool)
        own[at] = True
        of_row = np.repeat(own, sizes)
        flat[of_row] = ids[:int(of_row.sum())]
        flat[~of_row] = np.concatenate(others)
        return flat, sizes


class Units:
    """Alignments of different units, found by the hash of their bytes, in flat arrays."""

    def __init__(self, tokenizers: Tokenizers):
        self.tokenizers = tokenizers
        self.forget()

    def forget(self) -> None:
        self.hashes = np.zeros(0, U64)
        self.place = np.zeros(0, np.int64)  # of the unit of each hash in the arrays below
        self.numbers = np.zeros((0, 5), np.int64)  # n_a, n_b, groups, links, and whether the bytes are right
        self.groups = np.zeros(0, object)
        self.first = np.zeros(0, np.int64)
        self.pairs = np.zeros(0, U64)  # B id << 32 | A id of all links
        self.scores: tuple[object, np.ndarray] = (None, np.zeros((0, 2), np.int64))
        self.used = 0

    def learn(self, hashes: np.ndarray, units: list[bytes]) -> None:
        t = self.tokenizers
        ids, counts = t.encode([u.decode() for u in units])
        lengths = [t.length_a[ids[0]], t.length_b[ids[1]]]
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        right = np.ones(len(units), bool)
        for names, i, n, length in zip((t.bytes_a, t.bytes_b), ids, counts, lengths):
            # as long as its tokens, and then, if not all bytes of all units are right, byte by byte
            right &= np.bincount(np.repeat(np.arange(len(units)), n), weights=length, minlength=len(units)) == sizes
            texts = [names[k] for k in i.tolist()]
            if not right.all() or b"".join(texts) != b"".join(units):
                cuts = np.cumsum(n).tolist()
                right &= np.array([b"".join(texts[x:y]) == u for x, y, u in zip([0, *cuts], cuts, units)], bool)
        good = np.flatnonzero(right)
        if len(good) < len(units):
            keep = [np.repeat(right, n) for n in counts]
            ids, lengths = [i[k] for i, k in zip(ids, keep)], [x[k] for x, k in zip(lengths, keep)]
        a = align(ids, lengths, [n[good] for n in counts])
        numbers = np.zeros((len(units), 5), np.int64)
        numbers[:, 4] = right
        numbers[good, :4] = a["numbers"]
        groups = np.full(len(units), "", object)
        groups[good] = a["groups"]
        order = np.argsort(hashes)
        at = np.searchsorted(self.hashes, hashes[order])
        self.hashes = np.insert(self.hashes, at, hashes[order])
        self.place = np.insert(self.place, at, order + len(self.numbers))
        first = np.cumsum(numbers[:, 3]) - numbers[:, 3] + len(self.pairs)
        self.first = np.r_[self.first, first]
        self.numbers = np.concatenate([self.numbers, numbers])
        self.groups = np.concatenate([self.groups, groups])
        self.pairs = np.concatenate([self.pairs, a["pairs"]])
        self.used += int(a["bytes"] + 8 * len(a["pairs"]) + 200 * len(units))

    def of(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Numbers of the units data[start:end]."""
        if self.used > REMEMBERED_BYTES:
            self.forget()
        different, first, inverse = np.unique(Rolling(data).of(starts, ends), return_index=True, return_inverse=True)
        _, known = find(self.hashes, different)
        if not known.all():
            new = first[~known]
            raw = data.tobytes()
            self.learn(different[~known], [raw[a:b] for a, b in zip(starts[new].tolist(), ends[new].tolist())])
        at, _ = find(self.hashes, different)
        return self.place[at][inverse]

    def scored(self, counts: Counts) -> np.ndarray:
        """(links whose count is their B id's highest, sum of counts) of every unit."""
        owner, have = self.scores
        if owner is not counts:
            have = np.zeros((0, 2), np.int64)
        if len(have) < len(self.numbers):
            links = self.numbers[len(have):, 3]
            pairs = gather(self.pairs, self.first[len(have):], links)
            count, best = counts.of(pairs)
            unit = np.repeat(np.arange(len(links)), links)
            new = np.stack([np.bincount(unit, weights=x, minlength=len(links)).astype(np.int64) for x in (best, count)], 1)
            have = np.concatenate([have, new])
            self.scores = (counts, have)
        return have


def align(flat: list[np.ndarray], length: list[np.ndarray], counts: list[np.ndarray]) -> dict:
    """Groups and links of units, all in a row: ids of A and B, their bytes, and how many each unit has.

    A unit's tokens of both kinds cover its bytes.
    """
    n = len(counts[0])
    if not n:
        return {"numbers": np.zeros((0, 4), np.int64), "groups": np.zeros(0, object), "pairs": np.zeros(0, U64), "bytes": 0}
    end = [np.cumsum(x) for x in length]
    start = [e - x for e, x in zip(end, length)]
    # all intervals by start, of both kinds; a group breaks where a start reaches the running maximum of ends
    starts, ends = np.concatenate(start), np.concatenate(end)
    kind = np.repeat([0, 1], [len(start[0]), len(start[1])])
    order = np.lexsort((kind, starts))
    reach = np.maximum.accumulate(ends[order])
    breaks = np.r_[True, starts[order][1:] >= reach[:-1]]
    group = np.empty(len(starts), np.int64)
    group[order] = np.cumsum(breaks) - 1
    of_a, of_b = group[:len(start[0])], group[len(start[0]):]
    # links: the B tokens that overlap each A token
    low = np.searchsorted(end[1], start[0], "right")
    links = np.searchsorted(start[1], end[0], "left") - low
    b_of_link = gather(np.arange(len(flat[1])), low, links)
    pairs = flat[1][b_of_link].astype(U64) << U64(32) | np.repeat(flat[0], links).astype(U64)
    unit_a = np.repeat(np.arange(n), counts[0])
    unit_of_group = unit_a[np.flatnonzero(np.r_[True, of_a[1:] != of_a[:-1]])]
    numbers = np.stack([counts[0], counts[1], np.bincount(unit_of_group, minlength=n),
                        np.bincount(unit_a, weights=links, minlength=n).astype(np.int64)], 1)
    # every id with the sign behind it, A's before B's in each group
    last = [np.r_[of[1:] != of[:-1], True] for of in (of_a, of_b)]
    signs = np.concatenate([np.where(last[0], 1, 0), np.where(last[1], 2, 0)])
    ids = np.concatenate(flat)
    placed = np.lexsort((kind, group))  # stable: ids stay in order
    distinct, number = np.unique(ids * 3 + signs, return_inverse=True)
    words = np.array([f"{x // 3}{',|;'[x % 3]}" for x in distinct.tolist()], object)
    sizes = np.array([len(w) for w in words], np.int64)[number]
    text = "".join(words[number[placed]].tolist())
    unit = np.concatenate([unit_a, np.repeat(np.arange(n), counts[1])])
    cuts = np.cumsum(np.bincount(unit, weights=sizes, minlength=n).astype(np.int64)).tolist()
    groups = np.empty(n, object)
    groups[:] = [text[i:j - 1] for i, j in zip([0, *cuts], cuts)]
    return {"numbers": numbers, "groups": groups, "pairs": pairs, "bytes": len(text)}


class Counts:
    """The corpus' count of each pair of ids, from sorted arrays in the shared folder."""

    def __init__(self, folder: str):
        self.files = {}
        for i in range(BUCKETS):
            self.files[i] = tuple(read_array(f"{folder}/{i}.{kind}", dtype) for kind, dtype in (("pairs", U64), ("counts", np.int64), ("best", np.uint8)))

    def of(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        count, best = np.zeros(len(pairs), np.int64), np.zeros(len(pairs), np.int64)
        bucket = (pairs >> U64(32)).astype(np.int64) % BUCKETS
        order = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[order], np.arange(BUCKETS + 1))
        for i in range(BUCKETS):
            own = order[cuts[i]:cuts[i + 1]]
            if len(own):
                keys, counts, top = self.files[i]
                at, found = find(keys, pairs[own])
                count[own], best[own] = np.where(found, counts[at], 0), np.where(found, top[at], 0)
        return count, best


def _chunks(batch: pa.RecordBatch):
    """(rows, bytes, unit starts, unit ends, row of each unit) of texts, each with a blank before it."""
    texts = pc.fill_null(batch.column("text"), "")
    sizes = np.asarray(pc.binary_length(texts), np.int64) + 1
    total, start = np.cumsum(sizes), 0
    while start < batch.num_rows:
        before = total[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(total, before + CHUNK_BYTES, "right")))
        yield batch.slice(start, stop - start), texts.slice(start, stop - start), sizes[start:stop]
        start = stop


def _units(texts: pa.Array, sizes: np.ndarray, units: Units):
    """(bytes, starts, ends, row of each unit); empty texts have none."""
    listed = texts.to_pylist()
    data = np.frombuffer("".join([f" {x}" for x in listed]).encode(), np.uint8)
    first = np.cumsum(sizes) - sizes
    t = units.tokenizers
    cut = t.begins[data]
    cut[1:] &= ~t.white[data[:-1]]
    for i, x in enumerate(listed):
        if RARE_WHITE.search(x):
            cut[first[i]:first[i] + sizes[i]] = False
    cut[first] = True
    starts = np.flatnonzero(cut)
    ends = np.r_[starts[1:], len(data)]
    row = np.searchsorted(first, starts, "right") - 1
    some = sizes[row] > 1
    return data, starts[some], ends[some], row[some]


def _aligned(batch: pa.RecordBatch, paths: tuple[str, str]):
    """(rows, units, number of each unit, its row), without the texts whose bytes the tokens do not give back."""
    own = memory("alignment")
    if paths not in own:
        own[paths] = Units(Tokenizers(*paths))
    units = own[paths]
    for rows, texts, sizes in _chunks(batch):
        data, starts, ends, row = _units(texts, sizes, units)
        number = units.of(data, starts, ends)
        wrong = np.bincount(row, weights=1 - units.numbers[number, 4], minlength=rows.num_rows) > 0
        keep = ~wrong[row]
        yield rows, units, number[keep], row[keep]


def pair_counts(docs: DataFrame, tokenizer_a: str, tokenizer_b: str, text: str = "text") -> DataFrame:
    """(a, b, count, best): the number of links of every pair of ids, and whether it is the highest of its B id, ties included."""
    prepare(docs.sparkSession)

    def run(batches):
        pairs, counts = [], []
        for batch in batches:
            for _, units, number, _ in _aligned(batch, (tokenizer_a, tokenizer_b)):
                different, times = np.unique(number, return_counts=True)
                links = units.numbers[different, 3]
                k, c = add_up([gather(units.pairs, units.first[different], links)], [np.repeat(times, links)])
                pairs.append(k)
                counts.append(c)
                if sum(map(len, pairs)) > HELD_PAIRS:
                    k, c = add_up(pairs, counts)
                    pairs, counts = [k], [c]
                    if len(k) > HELD_PAIRS // 2:
                        yield table(pair=k.astype(np.int64), n=c)
                        pairs, counts = [], []
        k, c = add_up(pairs, counts)
        yield table(pair=k.astype(np.int64), n=c)

    found = docs.select(F.col(text).alias("text")).mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("count"))
    split = found.select(F.col("pair").bitwiseAND(0xFFFFFFFF).alias("a"), F.shiftright("pair", 32).alias("b"), "count")
    # a window holds the partners of one B id, at most the vocabulary of A
    highest = F.max("count").over(Window.partitionBy("b"))
    return split.withColumn("best", F.col("count") == highest)


def store(counts: DataFrame) -> str:
    """Folder of sorted arrays of `pair_counts`; a bucket holds the pairs of every BUCKETS-th B id."""
    spark = prepare(counts.sparkSession)
    folder = shared_folder(spark, "pairs")

    def write(key, batch):
        bucket = int(key[0].as_py())
        pair = np.asarray(batch.column("pair")).astype(U64)
        order = np.argsort(pair)
        write_array(f"{folder}/{bucket}.pairs", pair[order])
        write_array(f"{folder}/{bucket}.counts", np.asarray(batch.column("count"))[order])
        write_array(f"{folder}/{bucket}.best", np.asarray(batch.column("best"), np.uint8)[order])
        return pa.table({"bucket": [bucket], "n": [int((pair > 0).sum())]}, schema=pa.schema([("bucket", pa.int64()), ("n", pa.int64())]))

    # every bucket gets a row that no lookup finds, so that all files are there
    rows = counts.select(
        (F.col("b") % BUCKETS).alias("bucket"), F.expr("shiftleft(b, 32) | a").alias("pair"), "count", F.col("best").cast("int").alias("best"))
    empty = spark.range(BUCKETS).select(F.col("id").alias("bucket"), F.lit(-1).cast("long").alias("pair"), F.lit(0).cast("long").alias("count"), F.lit(0).alias("best"))
    rows.unionByName(empty).groupBy("bucket").applyInArrow(write, "bucket long, n long").agg(F.sum("n")).collect()
    return folder


def aligned(docs: DataFrame, tokenizer_a: str, tokenizer_b: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of `docs`: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups.

    A encodes a blank and the text, B the text, to which it adds the blank itself; special tokens in
    texts are plain text. `groups` lists the ids of each group, `a1,a2|b1;a3|b2,b3`. n_best counts links
    whose pair is the most frequent of its B id in all of `docs`, ties included; count_sum adds up the
    counts of all links. Null and empty texts and those whose bytes the tokens do not give back
    have zeros and an empty list. Repeated rows count each for itself, also without doc_id. An empty
    table gives no rows. Other columns are not read. Memory is bounded by the longest text.
    """
    folder = store(pair_counts(docs, tokenizer_a, tokenizer_b, text))
    id_type = docs.schema[doc_id].dataType.simpleString()

    def run(batches):
        own = memory("alignment")
        if own.get("folder") != folder:
            own["folder"], own["counts"] = folder, Counts(folder)
        for batch in batches:
            for rows, units, number, row in _aligned(batch, (tokenizer_a, tokenizer_b)):
                n = rows.num_rows
                numbers = units.numbers[number, :4]
                sums = [np.bincount(row, weights=x, minlength=n).astype(np.int64) for x in (*numbers.T, *units.scored(own["counts"])[number].T)]
                cuts = np.searchsorted(row, np.arange(n + 1)).tolist()
                groups = units.groups[number].tolist()
                yield table(
                    doc_id=rows.column("doc_id"), **dict(zip(("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"), sums)),
                    groups=pa.array([";".join(groups[i:j]) for i, j in zip(cuts[:-1], cuts[1:])], pa.string()))

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        run, f"doc_id {id_type}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string")
