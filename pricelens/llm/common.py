"""Helpers shared by the operators: shared folders, staged tables, word arrays.

Words are maximal runs of bytes other than space and 0x09-0x0D.  They are
found and hashed with numpy over Arrow buffers, a bounded slice of text at a
time, so a batch costs a fixed multiple of its slice and no Python object per
word.
"""

from __future__ import annotations

import ctypes
import hashlib
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Text bytes handled at once inside a task.
SLICE_BYTES = 4 << 20
_CHUNK = 1 << 20


# ------------------------------------------------------------- shared folders

def shared_root(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only where it is unset and the master is local (tests) a scratch folder is
    made and set; on a cluster each machine would write its own, so it must be set.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="llm-shared-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back (cuts the lineage)."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(name: str, *taken: list[str]) -> str:
    """A helper column's name that none of the columns in ``taken`` has."""
    have = {c.lower() for cols in taken for c in cols}
    while name.lower() in have:
        name = f"{name}_"
    return name


def release() -> None:
    """Give memory that a task has freed back to the system: workers live on."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


# ---------------------------------------------------------------- word arrays

_U = np.uint64


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=_U)
    out[0] = 1
    return np.multiply.accumulate(out)


_BASE = 0x9E3779B97F4A7C15 | 1
_rng = np.random.Generator(np.random.PCG64(20260701))
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.int64).astype(_U) * _U(2) + _rng.integers(0, 2, 256).astype(_U)
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[65:91] = _BYTE[97:123]
_POW = _powers(_BASE, _CHUNK + 1)
_INV = _powers(pow(_BASE, -1, 1 << 64), _CHUNK + 1)
_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (bijective)."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


@dataclass
class Words:
    """Words of several texts: byte spans, 64-bit hashes, words per text."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    counts: np.ndarray
    hashes: np.ndarray | None = None

    def firsts(self) -> np.ndarray:
        """Index of each text's first word, and the total at the end."""
        return np.concatenate(([0], np.cumsum(self.counts)))

    def left(self) -> np.ndarray:
        """For each word, how many words its text has from it on."""
        ends = np.cumsum(self.counts)
        return np.repeat(ends, self.counts) - np.arange(len(self.starts))


def text_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string array; nulls count as empty."""
    if col.null_count:
        col = pc.fill_null(col, "" if not pa.types.is_binary(col.type) else b"")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, dtype=np.int64 if wide else np.int32)[col.offset:col.offset + len(col) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    return data, offsets.astype(np.int64)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds at most ``most`` bytes of text, or one row."""
    for b in batches:
        if not b.num_rows:
            continue
        _, off = text_buffers(b.column(b.schema.get_field_index(column)))
        i = 0
        while i < b.num_rows:
            j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
            yield b.slice(i, j - i)
            i = j


def words_of(col: pa.Array, hashed: bool = True, lower: bool = False, word_bytes: np.ndarray = _IS_WORD) -> Words:
    """Words of a string array; ``word_bytes`` tells the bytes that words are made of."""
    data, off = text_buffers(col)
    if len(off) < 2 or off[-1] == off[0]:
        none = np.empty(0, np.int64)
        return Words(data, none, none, np.zeros(len(off) - 1, np.int64), np.empty(0, _U))
    lo, hi = int(off[0]), int(off[-1])
    body = data[lo:hi]
    inside = word_bytes[body]
    edge = np.zeros(len(body) + 1, dtype=bool)
    edge[off - lo] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:-1]
    starts = np.flatnonzero(first)
    ends = np.flatnonzero(last) + 1
    counts = np.diff(np.searchsorted(starts, off - lo))
    w = Words(body, starts, ends, counts)
    if hashed:
        w.hashes = _hash_spans(body, starts, ends, _BYTE_LOWER if lower else _BYTE)
    return w


def _hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray) -> np.ndarray:
    out = np.empty(len(starts), dtype=_U)
    i, n = 0, len(starts)
    while i < n:
        base = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, base + _CHUNK, "right")))
        seg = data[base:int(ends[j - 1])]
        if len(seg) > _CHUNK:  # one word longer than a chunk
            out[i] = int.from_bytes(hashlib.blake2b(table[seg].tobytes(), digest_size=8).digest(), "little")
        else:
            sums = np.zeros(len(seg) + 1, dtype=_U)
            np.cumsum(table[seg] * _POW[:len(seg)], out=sums[1:])
            s = starts[i:j] - base
            out[i:j] = (sums[ends[i:j] - base] - sums[s]) * _INV[s]
        i = j
    return mix(out)


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the ``k`` values from each position on (length ``len(h) - k + 1``)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, dtype=_U)
    acc = np.full(n, k, dtype=_U)
    m = _U(0xD6E8FEB86659FD93)
    for j in range(k):
        acc *= m
        acc += h[j:j + n]
    return mix(acc)


def doc_shingles(w: Words, k: int = 5) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's ``k``-word shingles.

    A text with fewer words has its whole word sequence as its one shingle, a
    text without words has none.
    """
    h, first = w.hashes, w.firsts()
    win = window_hashes(h, k)
    out = []
    for a, n in zip(first[:-1].tolist(), w.counts.tolist()):
        if n >= k:
            s = np.sort(win[a:a + n - k + 1])
            keep = np.empty(len(s), dtype=bool)
            keep[0] = True
            np.not_equal(s[1:], s[:-1], out=keep[1:])
            out.append(s[keep])
        elif n:
            out.append(window_hashes(h[a:a + n], n))
        else:
            out.append(np.empty(0, dtype=_U))
    return out
