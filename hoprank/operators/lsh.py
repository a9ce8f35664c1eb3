"""Random-hyperplane LSH as DataFrame operators.

* hyperplanes: L tables x k planes x d, drawn on the driver from a seed (small);
* signature: per table a k-bit key packed into a LONG (bit b = dot(v, w_b) > 0,
  first plane = most significant bit);
* index: long table (table_id, bucket, id) - written ``partitionBy(table_id)``
  when persisted, appended batch by batch (L3);
* query: equi-join of the queries' (table_id, bucket) with the index, then
  ``distinct`` (query_id, id) - the union over tables with set semantics (L4).

Signatures come from one NumPy matmul per Arrow batch (planes shipped once as a broadcast
variable); an expression form (array functions, planes as literals) serves as a check.
The stored index that queries read in part is in ``lsh_store``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..functions.arrowvec import QueryBlock, cosine_to_queries, query_blocks
from ..functions.vectors import dot, cosine
from ..plans.sizing import broadcast_if_small
from ..session import write_once


def make_hyperplanes(d: int, k: int, L: int, seed: int = 7) -> np.ndarray:
    """L1: Gaussian planes, shape (L, k, d)."""
    if k > 62:
        raise ValueError("k must be <= 62 to pack a key into a LONG")
    return np.random.default_rng(seed).standard_normal((L, k, d))


def hyperplanes_table(spark: SparkSession, planes: np.ndarray) -> DataFrame:
    """L1 as a small table (table_id, bit, w) for storage next to the index."""
    L, k, _ = planes.shape
    rows = [(t, b, [float(x) for x in planes[t, b]]) for t in range(L) for b in range(k)]
    return spark.createDataFrame(rows, "table_id int, bit int, w array<double>")


def signature_expr(vec: Column, planes: np.ndarray) -> Column:
    """Expression form: array of L bucket keys."""
    L, k, _ = planes.shape
    keys = []
    for t in range(L):
        bits = [F.when(dot(vec, F.array(*[F.lit(float(x)) for x in planes[t, b]])) > 0,
                       F.lit(1 << (k - 1 - b))).otherwise(F.lit(0)).cast("long") for b in range(k)]
        key = bits[0]
        for b in bits[1:]:
            key = key + b
        keys.append(key)
    return F.array(*keys)


def _signature_udf(spark: SparkSession, planes: np.ndarray):
    L, k, d = planes.shape
    bc = spark.sparkContext.broadcast(planes.reshape(L * k, d).T.copy())   # (d, L*k)
    weights = (1 << np.arange(k - 1, -1, -1, dtype=np.int64))

    @pandas_udf("array<long>")
    def sig(vs: pd.Series) -> pd.Series:
        if len(vs) == 0:
            return pd.Series([], dtype=object)
        m = np.stack([np.asarray(v, dtype=np.float64) for v in vs])
        bits = (m @ bc.value > 0).reshape(len(vs), L, k)
        keys = (bits * weights).sum(axis=2)
        return pd.Series(list(keys))

    return sig


def lsh_signature(df: DataFrame, planes: np.ndarray, vec: str = "embedding", out: str = "buckets",
                  method: str = "arrow") -> DataFrame:
    """L2: add the L bucket keys of each row.  Rows and queries must use one method, as the two
    add up products in different orders; ``arrow`` is the way of all plans, ``expr`` is for small checks."""
    if method == "expr":
        return df.withColumn(out, signature_expr(F.col(vec), planes))
    return df.withColumn(out, _signature_udf(df.sparkSession, planes)(F.col(vec)))


def build_index(df: DataFrame, planes: np.ndarray, id_col: str = "id", vec: str = "embedding",
                method: str = "arrow") -> DataFrame:
    """L3: (table_id, bucket, id) for every row and table."""
    sig = lsh_signature(df.select(id_col, vec), planes, vec, method=method)
    return sig.select(F.posexplode("buckets").alias("table_id", "bucket"), F.col(id_col).alias("id"))


def append_index(df: DataFrame, planes: np.ndarray, path: str, id_col: str = "id", vec: str = "embedding") -> None:
    """L3, persisted: append a batch to an index folder partitioned by table."""
    build_index(df, planes, id_col, vec).write.mode("append").partitionBy("table_id").parquet(path)


def query_index(index: DataFrame, queries: DataFrame, planes: np.ndarray, vec: str = "embedding",
                method: str = "arrow") -> DataFrame:
    """L4: candidate ids per query, set semantics over the L tables."""
    q = lsh_signature(queries.select("query_id", vec), planes, vec, method=method)
    qk = q.select("query_id", F.posexplode("buckets").alias("table_id", "bucket"))
    # the query keys are few (queries x L); checked before broadcasting, so the
    # index side is streamed and a hot bucket never lands in one shuffle task
    qk = broadcast_if_small(qk, "query keys")
    return qk.join(index, ["table_id", "bucket"]).select("query_id", "id").distinct()


def fetch_candidates(cands: DataFrame, rows: DataFrame, cols=("id", "name", "embedding")) -> DataFrame:
    """Candidate rows by id (ids are shuffled, vectors are fetched once per pair)."""
    return cands.join(rows.select(*cols), "id")


def bucket_stats(cands: DataFrame, rows: DataFrame) -> DataFrame:
    """Candidates and distinct items per query."""
    return (cands.join(rows.select("id", "name"), "id").groupBy("query_id")
            .agg(F.count(F.lit(1)).alias("n_candidates"), F.countDistinct("name").alias("n_items")))


def bucket_sizes(index: DataFrame) -> DataFrame:
    """Rows per (table, bucket)."""
    return index.groupBy("table_id", "bucket").agg(F.count(F.lit(1)).alias("size"))


def evaluate_lsh(cands: DataFrame, truth: DataFrame) -> DataFrame:
    """Mean recall and precision of the candidate sets against exact neighbours.

    ``truth`` (query_id, id): the exact top-k ids per query.  Per query:
    recall = |C & T| / |T|, precision = |C & T| / |C| (null when C is empty).
    """
    # the exact ids are few; a candidate is looked up in them where it lies
    truth = broadcast_if_small(write_once(truth.select("query_id", "id"), "truth"), "exact ids")
    c_n = cands.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_c"))
    t_n = truth.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_t"))
    both = cands.join(truth, ["query_id", "id"]).groupBy("query_id").agg(F.count(F.lit(1)).alias("hit"))
    per_q = (t_n.join(c_n, "query_id", "left").join(both, "query_id", "left")
             .fillna(0, ["n_c", "hit"]))
    return per_q.agg(
        F.avg(F.col("hit") / F.col("n_t")).alias("mean_recall"),
        F.avg(F.try_divide(F.col("hit").cast("double"), F.col("n_c").cast("double"))).alias("mean_precision"))


def candidate_similarity(cand_rows: DataFrame, queries: DataFrame, vec: str = "embedding",
                         method: str = "arrow", keep=("id", "name")) -> DataFrame:
    """Cosine of each candidate row to its query.

    arrow: the query vectors are one size-checked broadcast block, rows are
    scored in NumPy batches where they are; expr: a join and a JVM expression.
    """
    if method == "arrow":
        out = None
        for block in query_blocks(queries.select("query_id", vec), vec):
            own = cand_rows.join(block.select("query_id"), "query_id", "left_semi")
            part = cosine_to_queries(own, QueryBlock.collect(block, vec), vec=vec, keep=keep)
            out = part if out is None else out.union(part)
        return out
    q = queries.select("query_id", F.col(vec).alias("qvec"))
    return cand_rows.join(q, "query_id").withColumn("similarity", cosine(F.col(vec), F.col("qvec")))


def _meet(row_keys: np.ndarray, keys: np.ndarray, first: np.ndarray, size: np.ndarray, order: np.ndarray):
    """Rows and queries whose keys are equal in one hash table."""
    at = np.minimum(np.searchsorted(keys, row_keys), max(len(keys) - 1, 0))
    hit = np.flatnonzero(keys[at] == row_keys) if len(keys) else np.zeros(0, np.int64)
    many = size[at[hit]] if len(keys) else hit
    start = np.repeat(first[at[hit]], many) if len(keys) else hit
    step = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    return np.repeat(hit, many), order[start + step]


def probe_candidates(rows: DataFrame, queries: DataFrame, planes: np.ndarray, vec: str = "embedding",
                     keep=("id", "name"), with_vectors: bool = False, qb: QueryBlock | None = None) -> DataFrame:
    """L2 + L4 + L5 + cosine in one map-only pass (no index join, no vector shuffle).

    ``with_vectors`` adds the row vector as packed float32 bytes (see ``arrowvec.pack``)
    for the NumPy steps that follow (k-means); ``arrowvec.matrix`` reads both forms.

    The queries' bucket keys and unit vectors are one size-checked broadcast
    block.  Every row is hashed in its task; a row is a candidate of a query
    when any of the L keys match (set semantics: once per query).  Emits
    (query_id, keep..., similarity[, embedding]).  Results equal
    ``query_index`` + ``fetch_candidates`` + ``candidate_similarity``.
    """
    import pyarrow as pa
    from ..functions.arrowvec import matrix, pack

    spark = rows.sparkSession
    qb = qb or QueryBlock.collect(queries.select("query_id", vec), vec)
    L, k, d = planes.shape
    flat = planes.reshape(L * k, d).T.copy()
    weights = (1 << np.arange(k - 1, -1, -1, dtype=np.int64))
    qkeys = ((qb.raw @ flat > 0).reshape(len(qb.ids), L, k) * weights).sum(axis=2) if len(qb.ids) else np.zeros((0, L), np.int64)
    # per table: the distinct keys in order, and the queries of each key one after the other
    lookup = []
    for t in range(L):
        order = np.argsort(qkeys[:, t], kind="stable")
        keys, first, size = np.unique(qkeys[order, t], return_index=True, return_counts=True)
        lookup.append((keys, first, size, order))
    bc = spark.sparkContext.broadcast((flat, weights, lookup, qb))
    keep = list(keep)
    qtype = queries.schema["query_id"].dataType.simpleString()
    fields = ", ".join([f"query_id {qtype}"] + [f"{c} {rows.schema[c].dataType.simpleString()}" for c in keep])
    schema = fields + ", similarity double" + (f", {vec} binary" if with_vectors else "")
    pa_qtype = pa.string() if qtype == "string" else pa.int64()

    def run(batches):
        w, wts, tables, block = bc.value
        for b in batches:
            if b.num_rows == 0:
                continue
            x = matrix(b.column(vec), d)
            keys = ((x @ w > 0).reshape(len(x), L, k) * wts).sum(axis=2)
            pairs = [_meet(keys[:, t], *tables[t]) for t in range(L)]
            code = np.unique(np.concatenate([r * len(block.ids) + q for r, q in pairs]))      # once per query and row
            if not len(code):
                continue
            ri, qi = np.divmod(code, max(len(block.ids), 1))
            xs = x[ri]
            n = np.linalg.norm(xs, axis=1)
            sim = np.where(n > 0, (xs * block.unit[qi]).sum(axis=1) / np.where(n > 0, n, 1), 0.0)
            take = pa.array(ri)
            cols = [pa.array([block.ids[q] for q in qi], type=pa_qtype)] + [b.column(c).take(take) for c in keep]
            cols.append(pa.array(sim))
            names = ["query_id"] + keep + ["similarity"]
            if with_vectors:
                cols.append(pack(xs))
                names.append(vec)
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return rows.select(*keep, vec).mapInArrow(run, schema)
