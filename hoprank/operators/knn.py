"""Exact cosine search (V7) and per-item mean similarity (V8).

Scoring every row (or item) for every query is a dense product.  It runs as
``mapInArrow``-style batches: the rows are streamed partition by partition,
the queries are a size-checked broadcast block (several blocks when there are
many), each partition keeps only its local top-n per query, and a final
window keeps the global top-n.  Nothing is collected except the query block.

The mean cosine of a query to an item's rows equals the dot product of the
unit query with the mean of the item's unit row vectors, so plan C first
reduces rows to one profile per item (a partial aggregate), then scores items.
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import elementwise_avg, vector_dim, with_unit

MAX_QUERY_BLOCK = 4096          # queries per broadcast block
MAX_BLOCK_BYTES = 64 << 20      # and at most this many bytes of query vectors


def item_profiles(rows: DataFrame, vec: str = "embedding", item: str = "name", dim: int | None = None) -> DataFrame:
    """Mean of the unit row vectors per item (zero rows count, as zero vectors)."""
    dim = dim or vector_dim(rows, vec)
    unit = with_unit(rows.select(item, vec), vec, "u")
    return unit.groupBy(item).agg(elementwise_avg("u", dim).alias("profile"), F.count(F.lit(1)).alias("n_rows"))


def pair_profiles(rows: DataFrame, attach, vec: str = "embedding", item: str = "name", key: str = "vec_id", dim: int | None = None) -> DataFrame:
    """``item_profiles`` of rows that name their vector by ``key``; ``attach`` joins the vectors to (item, key) rows.

    The rows are counted by (item, key) first, a hot item's where they lie, and the counts are laid out by item:
    numbers are shuffled, and vectors that are few enough to go to the rows never are.
    """
    pairs = rows.groupBy(item, key).agg(F.count(F.lit(1)).alias("_m")).repartition(item)
    unit = with_unit(attach(pairs).select(item, "_m", vec), vec, "u")
    dim = dim or vector_dim(unit, "u")
    held = F.sum(F.when(F.col("u").isNotNull(), F.col("_m")))
    sums = unit.groupBy(item).agg(*[F.sum(F.col("u").getItem(i) * F.col("_m")).alias(f"_s{i}") for i in range(dim)],
                                  held.alias("_h"), F.sum("_m").alias("n_rows"))
    return sums.select(item, F.array(*[F.col(f"_s{i}") / F.col("_h") for i in range(dim)]).alias("profile"), "n_rows")


def _query_blocks(queries: DataFrame, vec: str, dim: int):
    """Split the queries into blocks small enough to broadcast (ids collected block by block)."""
    per_block = max(1, min(MAX_QUERY_BLOCK, MAX_BLOCK_BYTES // max(8 * dim, 1)))
    n = queries.count()
    n_blocks = max(1, -(-n // per_block))
    if n_blocks == 1:
        yield queries
        return
    keyed = queries.withColumn("_blk", F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)))
    for b in range(n_blocks):
        yield keyed.filter(F.col("_blk") == b).drop("_blk")


def top_by_dot(rows: DataFrame, queries: DataFrame, n: int | None, key: str, vec: str, qvec: str = "embedding",
               score: str = "score", normalize_rows: bool = True, tiebreak_digits: int = 9) -> DataFrame:
    """For each query, the ``n`` rows with the largest cosine (ties by ``key``); all rows when n is None.

    rows: (key, vec); queries: (query_id, qvec).  Returns (query_id, key, score, rank).
    """
    spark = rows.sparkSession
    dim = vector_dim(queries, qvec)
    out = None
    for block in _query_blocks(queries.select("query_id", qvec), qvec, dim):
        pdf = block.toPandas()
        qids = pdf["query_id"].to_numpy()
        qm = np.stack([np.asarray(v, dtype=np.float64) for v in pdf[qvec]]) if len(pdf) else np.zeros((0, dim))
        qn = np.linalg.norm(qm, axis=1, keepdims=True)
        qm = np.divide(qm, qn, out=np.zeros_like(qm), where=qn > 0)
        bc = spark.sparkContext.broadcast((qids, qm))
        key_type = rows.schema[key].dataType.simpleString()
        qid_type = queries.schema["query_id"].dataType.simpleString()
        schema = f"query_id {qid_type}, {key} {key_type}, {score} double"

        def score_part(it: Iterator[pd.DataFrame], _bc=bc, _n=n) -> Iterator[pd.DataFrame]:
            ids, qmat = _bc.value
            for pdf_rows in it:
                if len(pdf_rows) == 0 or len(ids) == 0:
                    continue
                m = np.stack([np.asarray(v, dtype=np.float64) for v in pdf_rows[vec]])
                if normalize_rows:
                    rn = np.linalg.norm(m, axis=1, keepdims=True)
                    m = np.divide(m, rn, out=np.zeros_like(m), where=rn > 0)
                s = qmat @ m.T                     # (queries, rows)
                keys = pdf_rows[key].to_numpy()
                if _n is None or _n >= s.shape[1]:
                    qi, ri = np.meshgrid(np.arange(len(ids)), np.arange(s.shape[1]), indexing="ij")
                    yield pd.DataFrame({"query_id": ids[qi.ravel()], key: keys[ri.ravel()], score: s.ravel()})
                    continue
                # local top-n per query, ties resolved like the global order (rounded score desc, key asc)
                r = np.round(s, tiebreak_digits)
                kth = -np.partition(-r, _n - 1, axis=1)[:, _n - 1:_n]
                parts = []
                for qi in range(len(ids)):
                    cand = np.nonzero(r[qi] >= kth[qi, 0])[0]
                    order = np.lexsort((keys[cand], -r[qi, cand]))[:_n]
                    sel = cand[order]
                    parts.append(pd.DataFrame({"query_id": ids[qi], key: keys[sel], score: s[qi, sel]}))
                yield pd.concat(parts, ignore_index=True)

        part = rows.select(key, vec).mapInPandas(score_part, schema)
        out = part if out is None else out.unionByName(part)
    w = Window.partitionBy("query_id").orderBy(F.round(score, tiebreak_digits).desc(), F.col(key))
    ranked = out.withColumn("rank", F.row_number().over(w).cast("long"))
    return ranked if n is None else ranked.filter(F.col("rank") <= n)


def knn_exact(rows: DataFrame, queries: DataFrame, n: int, key: str = "id", vec: str = "embedding") -> DataFrame:
    """V7: the n most similar rows per query by cosine."""
    return top_by_dot(rows, queries, n, key, vec, score="similarity")


def score_items(rows: DataFrame, queries: DataFrame, n: int | None = 20, item: str = "name",
                vec: str = "embedding", profiles: DataFrame | None = None) -> DataFrame:
    """Plan C core: mean cosine of the query to every item's rows, top n items; ``profiles`` are those of ``rows``, if built before."""
    prof = profiles if profiles is not None else item_profiles(rows, vec, item)
    return top_by_dot(prof, queries, n, item, "profile", score="cosine_score", normalize_rows=False)


def item_similarity(sims: DataFrame, item: str = "name") -> DataFrame:
    """V8: mean similarity per (query, item) over candidate rows."""
    return sims.groupBy("query_id", item).agg(F.avg("similarity").alias("lsh_score"))
