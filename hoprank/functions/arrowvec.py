"""Arrow-batch helpers for the few NumPy paths (vectors as matrices, query blocks).

A ``QueryBlock`` is the set of query vectors shipped to every task as a
broadcast variable.  Its size is checked before it is built (queries x dim x
8 bytes); callers split larger query sets into several blocks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_BLOCK_BYTES = 128 << 20


def matrix(arr, d: int) -> np.ndarray:
    """(rows x d) float64 matrix from an Arrow list<float|double> column, or from packed
    float32 bytes (``pack``), without a Python loop."""
    if isinstance(arr, pa.ChunkedArray):
        arr = pa.concat_arrays(arr.chunks) if arr.num_chunks != 1 else arr.chunk(0)
    if len(arr) == 0:
        return np.zeros((0, d))
    if pa.types.is_binary(arr.type):
        offs = np.frombuffer(arr.buffers()[1], dtype=np.int32)[arr.offset:arr.offset + len(arr) + 1]
        raw = np.frombuffer(arr.buffers()[2], dtype=np.uint8)[offs[0]:offs[-1]]
        return raw.view(np.float32).astype(np.float64).reshape(len(arr), d)
    if arr.null_count:
        rows = [np.zeros(d) if v is None else np.asarray(v, dtype=np.float64) for v in arr.to_pylist()]
        return np.stack(rows)
    flat = arr.flatten().to_numpy(zero_copy_only=False)
    return np.asarray(flat, dtype=np.float64).reshape(len(arr), d)


def positions(col, keys_array: pa.Array) -> np.ndarray:
    """Position of every value of ``col`` in ``keys_array`` (vectorised; -1 when absent)."""
    import pyarrow.compute as pc
    idx = pc.index_in(col, value_set=keys_array)
    return np.asarray(idx.fill_null(-1).to_numpy(zero_copy_only=False), dtype=np.int64)


def unit_rows(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def pack(m: np.ndarray) -> pa.BinaryArray:
    """Rows of a matrix as packed float32 bytes: Spark moves a binary value between the JVM
    and Python with one copy, an array<float> element by element."""
    n, d = m.shape
    data = np.ascontiguousarray(m, dtype=np.float32).tobytes()
    offsets = pa.py_buffer(np.arange(0, (n + 1) * d * 4, d * 4, dtype=np.int32).tobytes())
    return pa.Array.from_buffers(pa.binary(), n, [None, offsets, pa.py_buffer(data)])


def unpack(b: bytes) -> np.ndarray:
    return np.frombuffer(b, dtype=np.float32).astype(np.float64)


def list_array(m: np.ndarray) -> pa.ListArray:
    """Arrow list<double> column from a (rows x d) matrix."""
    n, d = m.shape
    offsets = pa.array(np.arange(0, (n + 1) * d, d, dtype=np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(m.ravel(), type=pa.float64()))


def query_blocks(queries: DataFrame, vec: str = "embedding", key: str = "query_id", per_query: int = 1,
                 max_bytes: int | None = None) -> list[DataFrame]:
    """The queries in blocks, each small enough for one QueryBlock with ``per_query`` vectors a query.

    One block takes the queries as they are; several are dealt by a hash of the key, at half the
    bound on average, since hashing is uneven.
    """
    row = queries.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(vec)).alias("d")).first()
    size = row["n"] * max(row["d"] or 1, 1) * 8 * per_query
    limit = max_bytes or MAX_BLOCK_BYTES
    if size <= limit:
        return [queries]
    n = -(-2 * size // limit)
    return [queries.filter(F.pmod(F.xxhash64(key), F.lit(n)) == b) for b in range(n)]


@dataclass
class QueryBlock:
    ids: np.ndarray          # query ids (object or int)
    unit: np.ndarray         # (queries x d) unit vectors
    pos: dict                # id -> row
    raw: np.ndarray          # (queries x d) vectors as given

    @classmethod
    def collect(cls, queries: DataFrame, vec: str = "embedding", key: str = "query_id") -> "QueryBlock":
        """At most MAX_BLOCK_BYTES of query vectors reach the driver: the read itself is limited."""
        d_row = queries.selectExpr(f"size({vec}) AS d").first()
        d = int(d_row["d"]) if d_row else 0
        cap = MAX_BLOCK_BYTES // (max(d, 1) * 8)
        tbl = queries.select(key, vec).limit(cap + 1).toArrow()
        n = tbl.num_rows
        if n > cap:
            raise ValueError(f"more than {cap} query vectors of width {d}: above one broadcast block; split the queries")
        ids = np.asarray(tbl.column(key).to_pylist(), dtype=object)
        m = matrix(tbl.column(vec), d) if n else np.zeros((0, d))
        return cls(ids=ids, unit=unit_rows(m), pos={q: i for i, q in enumerate(ids)}, raw=m)

    def key_array(self) -> pa.Array:
        return pa.array(list(self.ids))


def cosine_to_queries(rows: DataFrame, qb: QueryBlock, key: str = "query_id", vec: str = "embedding",
                      keep=("id", "name")) -> DataFrame:
    """Cosine of each (query, row) pair to its query's vector; rows never leave their task."""
    spark = rows.sparkSession
    bc = spark.sparkContext.broadcast(qb)
    keep = list(keep)
    d = qb.unit.shape[1]
    fields = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in [key] + keep)

    def run(batches):
        block = bc.value
        keys = block.key_array()
        for b in batches:
            if b.num_rows == 0:
                continue
            x = matrix(b.column(vec), d)
            qv = block.unit[positions(b.column(key), keys)]
            n = np.linalg.norm(x, axis=1)
            sim = np.where(n > 0, (x * qv).sum(axis=1) / np.where(n > 0, n, 1), 0.0)
            yield pa.RecordBatch.from_arrays([b.column(c) for c in [key] + keep] + [pa.array(sim)],
                                             names=[key] + keep + ["similarity"])

    return rows.select(key, *keep, vec).mapInArrow(run, f"{fields}, similarity double")
