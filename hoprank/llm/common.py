"""Shared pieces: table access, written intermediate tables, and vectorised text scanning.

Text goes to Python as UTF-8 bytes.  ``slices`` cuts an Arrow batch at document
boundaries into pieces of a few MB, so that the NumPy work space stays bounded
by one slice (or by the longest single document).  A word is a maximal run of
bytes other than 0x20 and 0x09-0x0D; these never occur inside a UTF-8 sequence.
"""

from __future__ import annotations

import contextlib
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, ship_package

#: A word in SQL patterns.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that are worked on at once in a task.
SLICE_BYTES = 2_000_000
#: Bytes of an Arrow batch that goes to a worker.
BATCH_CONF, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder beside the checkpoints, on the storage that all executors share."""
    return os.path.join(ensure_checkpoint_dir(spark), "llm", f"{name}-{uuid.uuid4().hex[:12]}")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet on shared storage and read it back: a short lineage that survives lost executors."""
    spark = df.sparkSession
    ship_package(spark)
    path = scratch_path(spark, name)
    with small_batches(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def small_batches(spark: SparkSession):
    """Bound the Arrow batches of the jobs run inside: both the JVM and the worker hold a batch outside the heap."""
    before = spark.conf.get(BATCH_CONF)
    spark.conf.set(BATCH_CONF, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.set(BATCH_CONF, before)


def body(col: Column) -> Column:
    """A text column as UTF-8 bytes; null counts as empty."""
    return F.coalesce(col, F.lit("")).cast("binary")


def text_key(col: Column) -> Column:
    """With doc_id, tells rows apart; rows that share both are the same row twice and get the same result."""
    return F.xxhash64(col)


# ---------------------------------------------------------------- byte tables

def _bytes(pattern: bytes) -> np.ndarray:
    t = np.zeros(256, dtype=bool)
    t[list(pattern)] = True
    return t


SPACE = _bytes(b" \t\n\x0b\x0c\r")
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32
#: Bytes that start a code point.
POINT = (np.arange(256) & 0xC0) != 0x80

_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_GRAM = np.uint64(0xD6E8FEB86659FD93)
_PLACE = _rng.integers(0, 2**64, 1 << 16, dtype=np.uint64)
_powers = np.ones(1, dtype=np.uint64)


def _pow(n: int) -> np.ndarray:
    """Powers of _STEP modulo 2**64, at least n of them."""
    global _powers
    if len(_powers) < n:
        p = np.full(max(n, 2 * len(_powers)), _STEP, dtype=np.uint64)
        p[0] = 1
        with np.errstate(over="ignore"):
            _powers = np.cumprod(p, dtype=np.uint64)
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    """Spread a 64-bit hash over all bits (a bijection)."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return h ^ (h >> np.uint64(33))


# ---------------------------------------------------------------- slices of a batch

@dataclass
class Slice:
    """Some consecutive rows of a batch: rows lo..hi, their bytes, and where each row begins in them."""
    lo: int
    hi: int
    buf: np.ndarray
    offs: np.ndarray

    def rows(self) -> int:
        return self.hi - self.lo


def binary_parts(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a binary column without nulls."""
    kind = np.int64 if pa.types.is_large_binary(col.type) else np.int32
    bufs = col.buffers()
    if not len(col):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    offs = np.frombuffer(bufs[1], dtype=kind)[col.offset:col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], dtype=np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    return offs, data


def slices(col: pa.Array, size: int = SLICE_BYTES) -> Iterator[Slice]:
    offs, data = binary_parts(col)
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + size, side="right")) - 1)
        yield Slice(lo, hi, data[offs[lo]:offs[hi]], offs[lo:hi + 1] - offs[lo])
        lo = hi


def runs(inside: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of True that don't cross a row's begin."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.zeros(n + 1, dtype=bool)
    edge[offs] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | edge[1:n]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | edge[1:n]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def hash_runs(buf: np.ndarray, inside: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each run (``starts`` from ``runs``)."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    first = starts[0]
    seg = np.diff(np.append(starts, len(buf)))
    at = np.arange(first, len(buf), dtype=np.int64) - np.repeat(starts, seg)
    part = placed(_BYTE[buf[first:]], at)
    part[~inside[first:]] = 0
    with np.errstate(over="ignore"):
        return mix(np.add.reduceat(part, starts - first))


def placed(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Hash each value together with its place in a run, so that a sum over the run stands for the sequence.

    Value and place are mixed, not multiplied: a polynomial in the place modulo 2**64 has
    the same sum for some structured sequences (such as a Thue-Morse word and its complement).
    """
    with np.errstate(over="ignore"):
        part = _PLACE[at & (len(_PLACE) - 1)] + values
        if len(at) and at.max() >= len(_PLACE):
            part += mix((at // len(_PLACE)).astype(np.uint64))
        part ^= part >> np.uint64(29)
        part *= np.uint64(0xBF58476D1CE4E5B9)
        part ^= part >> np.uint64(32)
        part *= np.uint64(0x94D049BB133111EB)
        part ^= part >> np.uint64(29)
        return part


@dataclass
class Words:
    hash: np.ndarray      # of each word
    starts: np.ndarray    # byte where it starts
    ends: np.ndarray
    offs: np.ndarray      # first word of each row, and the number of words


def words(s: Slice, buf: np.ndarray | None = None, space: np.ndarray = SPACE) -> Words:
    buf = s.buf if buf is None else buf
    inside = ~space[buf]
    starts, ends = runs(inside, s.offs)
    return Words(hash_runs(buf, inside, starts), starts, ends, np.searchsorted(starts, s.offs))


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each position on (positions near the end are left out)."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        g = h[:m].copy()
        for k in range(1, n):
            g *= _GRAM
            g += h[k:k + m]
    return mix(g)


def gram_rows(offs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions at which n words of one row start, and the rows of these positions."""
    count = np.maximum(np.diff(offs) - n + 1, 0)
    row = np.repeat(np.arange(len(count)), count)
    first = np.cumsum(count) - count
    return np.arange(len(row)) - first[row] + offs[:-1][row], row


def sums(flags: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Sum of flags in each row."""
    return np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[offs])


def binary_array(pieces: list[bytes]) -> pa.Array:
    return pa.array(pieces, type=pa.binary())


def int64s(a: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(a).view(np.int64) if a.dtype == np.uint64 else a.astype(np.int64), type=pa.int64())


def lists(values: pa.Array, offs: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offs.astype(np.int32)), values)
