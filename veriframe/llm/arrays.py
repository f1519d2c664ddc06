"""Texts of an Arrow batch as flat byte arrays, and word arrays over them.

Everything is vectorised over a chunk of whole documents. A chunk holds documents up to
`CHUNK_BYTES`, or one longer document, so memory is bounded by the longest text and not by the
number of rows. White space is the bytes 0x20 and 0x09-0x0D, which never occur inside a
multi-byte UTF-8 character; lower-casing concerns A-Z only.
"""

from __future__ import annotations

import os
import urllib.parse
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

CHUNK_BYTES = 1 << 20

U64 = np.uint64
_random = np.random.default_rng(20240607)
BYTE_VALUE = _random.integers(0, 2**64, 256, dtype=U64)  # a fixed random value for each byte
BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
INVERSE = pow(BASE, -1, 2**64)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 ... base**(n-1) modulo 2**64, kept for the next call."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, CHUNK_BYTES + (CHUNK_BYTES >> 2)), base, U64)
        have[0] = 1
        _powers[base] = have = np.multiply.accumulate(have)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values; a bijection."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * U64(0xD6E8FEB86659FD93) + mix(b))


class Rolling:
    """Hashes of any slices of one byte array, each in constant time."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.prefix = np.zeros(n + 1, U64)
        np.cumsum(BYTE_VALUE[data] * powers(BASE, n), out=self.prefix[1:])
        self.inverse = powers(INVERSE, n + 1)

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit hashes of data[start:end]."""
        raw = (self.prefix[ends] - self.prefix[starts]) * self.inverse[starts]
        return mix(raw + (ends - starts).astype(U64))


    def grams(self, size: int) -> np.ndarray:
        """Hashes of all slices of one size, in order of their starts; not to be mixed with `of`."""
        n = len(self.prefix) - size
        return (self.prefix[size:] - self.prefix[:n]) * self.inverse[:n]


class Chunk:
    """Documents joined by line feeds: `data`, and where each document starts and ends."""

    def __init__(self, texts: pa.Array):
        self.texts = texts.to_pylist()
        sizes = np.asarray(pc.binary_length(texts), np.int64)
        self.data = np.frombuffer(("\n".join(self.texts) + "\n").encode(), np.uint8)
        self.ends = np.cumsum(sizes + 1) - 1
        self.starts = self.ends - sizes

    def words(self, separator: np.ndarray = SPACE, lower: bool = True):
        """(bytes, start, end, document) of all words; words never cross documents."""
        data = LOWER[self.data] if lower else self.data
        inside = ~separator[self.data]
        inside[self.ends] = False
        step = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0))
        starts, ends = step[::2], step[1::2]
        return data, starts, ends, np.searchsorted(self.ends, starts).astype(np.int64)


def counts_by(owner: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(owner, minlength=n).astype(np.int64)


def sums_by(owner: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(owner, weights=values, minlength=n)


_remembered: dict[str, dict] = {}


def memory(owner: str | None) -> dict:
    """What this worker remembers between tasks for one operator; others' memory is given up."""
    for name in [n for n in _remembered if n != owner]:
        del _remembered[name]
    return _remembered.setdefault(owner, {}) if owner else {}


def chunks(batch: pa.RecordBatch, column: str = "text", owner: str | None = None) -> Iterator[tuple[pa.RecordBatch, Chunk]]:
    """Slices of a batch with at most CHUNK_BYTES of text, or one document; null texts are empty."""
    memory(owner)
    texts = pc.fill_null(batch.column(column), "")
    sizes = np.asarray(pc.binary_length(texts), np.int64) + 1
    total, start = np.cumsum(sizes), 0
    while start < batch.num_rows:
        before = total[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(total, before + CHUNK_BYTES, "right")))
        yield batch.slice(start, stop - start), Chunk(texts.slice(start, stop - start))
        start = stop


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package, and keep Arrow batches small."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (root, env.get("PYTHONPATH", "")) if x)
    env["ARROW_DEFAULT_MEMORY_POOL"] = "system"  # freed memory goes back to the system
    env["MALLOC_ARENA_MAX"], env["MALLOC_TRIM_THRESHOLD_"] = "1", "1000000"
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return spark


def _place(uri: str):
    """(file system, path) of a shared folder; None stands for a mounted path."""
    parts = urllib.parse.urlparse(uri)
    if parts.scheme in ("", "file"):
        return None, urllib.parse.unquote(parts.path)
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_array(uri: str, values: np.ndarray) -> None:
    """Write a raw array under a shared folder; a repeated task replaces it by the same bytes."""
    files, path = _place(uri)
    if files is None:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        part = f"{path}.{uuid.uuid4().hex}"
        values.tofile(part)
        os.replace(part, path)
    else:
        files.create_dir(os.path.dirname(path), recursive=True)
        with files.open_output_stream(path) as out:
            out.write(values.tobytes())


def read_array(uri: str, dtype) -> np.ndarray:
    """A raw array of a shared folder, memory-mapped where the folder is mounted."""
    files, path = _place(uri)
    if files is None:
        if os.path.getsize(path) == 0:
            return np.zeros(0, dtype)
        return np.memmap(path, dtype, "r")
    with files.open_input_file(path) as stream:
        return np.frombuffer(stream.read(), dtype)


def find(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position, found) of each key in a sorted array."""
    if not len(sorted_keys):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.searchsorted(sorted_keys, keys)
    at[at == len(sorted_keys)] = 0
    return at, sorted_keys[at] == keys


def add_up(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sum of their counts."""
    if not keys:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    if not len(k):
        return k, c
    first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
    return k[first], np.add.reduceat(c, first)


def table(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(columns)


def binary_rows(values: np.ndarray, cuts: np.ndarray) -> list[bytes]:
    """The raw bytes of values[cuts[i]:cuts[i+1]]."""
    return [values[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])]
