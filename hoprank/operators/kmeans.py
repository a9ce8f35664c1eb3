"""k-means inside every query's candidate set, all queries at once (K1-K3).

The distributed pattern is the one Spark's own k-means uses: the centres -
k x d per query, a bounded, size-checked block - go to every task as a
broadcast; each task assigns its points with NumPy over Arrow batches and
emits only partial sums per (query, cluster); a small aggregate adds them.
Points never move; a hot query's points are spread over many tasks.  The
points are persisted for the rounds (recomputed from lineage if an executor
is lost); the driver holds the centres only.

Initialisation is deterministic: the first k distinct vectors of a query in
seeded hash order (k' = min(k, distinct points)).  Each query stops by itself: in
the round in which its centres move by no more than its own limit (``tol`` times its own
mean variance), it takes the new centres and is frozen.  Frozen queries are not assigned
any more, and once half of the rows belong to frozen queries the others are written
apart, so the rounds of a slow query don't pay for the rest.  A query's clusters are
therefore the same alone and in any batch.  An empty cluster keeps its centre.

Rows that share a vector may be one point with a ``weight`` (their number) and an ``order`` (their least hash): the
rounds then read the vectors, not the rows.
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrowvec import MAX_BLOCK_BYTES, QueryBlock, list_array, matrix, positions, unpack
from ..functions.vectors import elementwise_sum, sq_dist, vector_dim
from ..session import cut_lineage


def seeded_hash(seed: int, col: str = "id"):
    return F.md5(F.concat(F.lit(f"{seed}|"), F.col(col).cast("string")))


def init_centres(points: DataFrame, k: int, seed: int = 7, key: str = "query_id", vec: str = "embedding", order: str | None = None) -> DataFrame:
    """(key, cid, c): first k distinct vectors per key in seeded hash order, or that of ``order`` (expression form, for checks)."""
    distinct = points.groupBy(key, vec).agg(F.min(F.col(order) if order else seeded_hash(seed)).alias("_h"))
    w = Window.partitionBy(key).orderBy("_h")
    c = F.col(vec) if dict(points.dtypes)[vec] == "binary" else F.col(vec).cast("array<double>")
    return (distinct.withColumn("cid", (F.row_number().over(w) - 1).cast("int")).filter(F.col("cid") < k)
            .select(key, "cid", c.alias("c")))


def init_rows(points: DataFrame, k: int, seed: int = 7, key: str = "query_id", vec: str = "embedding",
              first: int = 8, cap: int = 4096, order: str | None = None) -> list:
    """Same result as ``init_centres`` without grouping on vectors: the first m rows of each key
    in hash order (a window that Spark pre-limits per partition) hold the first k distinct
    vectors unless a key repeats vectors a lot; m doubles for those keys only.  The driver
    receives at most keys x m vectors."""
    h = points.select(key, vec, (F.col(order) if order else seeded_hash(seed)).alias("_h"))
    w = Window.partitionBy(key).orderBy("_h")
    out, todo, m = [], None, max(first, k)
    sizes = {r[key]: r["n"] for r in points.groupBy(key).agg(F.count(F.lit(1)).alias("n")).collect()}
    while True:
        ktype = points.schema[key].dataType.simpleString()
        src = h if todo is None else h.join(points.sparkSession.createDataFrame([(t,) for t in todo], f"{key} {ktype}"), key, "left_semi")
        rows = src.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= m).collect()
        by: dict = {}
        for r in sorted(rows, key=lambda r: (str(r[key]), r["_r"])):
            v = r[vec]
            by.setdefault(r[key], []).append(bytes(v) if isinstance(v, (bytes, bytearray)) else tuple(v))
        short = []
        for q, vs in by.items():
            seen = []
            for v in vs:
                if v not in seen:
                    seen.append(v)
                if len(seen) == k:
                    break
            if len(seen) < k and len(vs) < sizes[q]:
                short.append(q)
            else:
                out.extend({key: q, "cid": i, "c": unpack(v) if isinstance(v, bytes) else np.asarray(v, dtype=np.float64)}
                           for i, v in enumerate(seen))
        if not short:
            return out
        todo, m = short, m * 2
        if m > cap:
            # keys that repeat vectors heavily: distinct vectors by a distributed group-by,
            # only for those keys (the driver receives k rows per key)
            ktype = points.schema[key].dataType.simpleString()
            rest = points.join(points.sparkSession.createDataFrame([(t,) for t in todo], f"{key} {ktype}"), key, "left_semi")
            for r in init_centres(rest, k, seed, key, vec, order).collect():
                c = r["c"]
                out.append({key: r[key], "cid": r["cid"],
                            "c": unpack(bytes(c)) if isinstance(c, (bytes, bytearray)) else np.asarray(c, dtype=np.float64)})
            return out


class Centres:
    """Dense (queries x k x d) centre tensor with a validity mask, kept on the driver."""

    def __init__(self, keys, k: int, d: int):
        self.keys = list(keys)
        self.pos = {q: i for i, q in enumerate(self.keys)}
        self.c = np.zeros((len(self.keys), k, d))
        self.valid = np.zeros((len(self.keys), k), dtype=bool)
        self.active = np.ones(len(self.keys), dtype=bool)

    @classmethod
    def from_rows(cls, rows, k: int, d: int, key: str = "query_id"):
        rows = list(rows)
        keys = sorted({r[key] for r in rows}, key=str)
        if len(keys) * k * d * 8 > MAX_BLOCK_BYTES:
            raise ValueError("centres exceed one broadcast block; split the queries")
        out = cls(keys, k, d)
        for r in rows:
            i = out.pos[r[key]]
            out.c[i, r["cid"]] = r["c"]
            out.valid[i, r["cid"]] = True
        return out


def _assign(x: np.ndarray, qi: np.ndarray, cen: np.ndarray, valid: np.ndarray) -> np.ndarray:
    c = cen[qi]                                         # (n, k, d)
    dist = ((x[:, None, :] - c) ** 2).sum(axis=2)
    dist[~valid[qi]] = np.inf
    return dist.argmin(axis=1)                          # ties -> smaller cluster id


def _partial_sums(key: str, vec: str, d: int, k: int, bc, key_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cen = bc.value
        keys = pa.array(cen.keys)
        sums = np.zeros_like(cen.c)
        sq = np.zeros(cen.valid.shape)
        cnt = np.zeros(cen.valid.shape)
        for b in batches:
            if b.num_rows == 0:
                continue
            qi = positions(b.column(key), keys)
            live = np.flatnonzero((qi >= 0) & cen.active[qi])
            if len(live) == 0:
                continue
            qi, x, w = qi[live], matrix(b.column(vec), d)[live], b.column("_w").to_numpy()[live]
            lab = _assign(x, qi, cen.c, cen.valid)
            flat = qi * k + lab
            size = sums.shape[0] * k
            for j in range(d):
                sums[..., j] += np.bincount(flat, weights=x[:, j] * w, minlength=size).reshape(-1, k)
            cnt += np.bincount(flat, weights=w, minlength=size).reshape(-1, k)
            sq += np.bincount(flat, weights=(x * x).sum(axis=1) * w, minlength=size).reshape(-1, k)
        qs, cs = np.nonzero(cnt)
        if len(qs):
            yield pa.RecordBatch.from_arrays(
                [pa.array([cen.keys[i] for i in qs], type=key_type), pa.array(cs.astype(np.int32)),
                 list_array(sums[qs, cs]), pa.array(np.rint(cnt[qs, cs]).astype(np.int64)), pa.array(sq[qs, cs])],
                names=[key, "cluster", "s", "n", "ss"])
    return run


def keyed_kmeans(points: DataFrame, k: int = 5, iters: int = 300, seed: int = 7, key: str = "query_id",
                 vec: str = "embedding", dim: int | None = None, tol: float = 1e-4, weight: str | None = None,
                 order: str | None = None) -> "KeyedKMeans":
    """K1: fit one k-means per key; returns the fitted centres (labels via ``KeyedKMeans.label``).

    ``weight``: the rows (a whole number) that a point stands for; ``order``: their least seeded hash.
    """
    spark = points.sparkSession
    if dim is None:
        if dict(points.dtypes)[vec] == "binary":
            row = points.select(F.length(vec).alias("n")).first()
            dim = int(row["n"]) // 4 if row else 0
        else:
            dim = vector_dim(points, vec)
    pts = points.select(key, vec, (F.col(weight) if weight else F.lit(1)).cast("double").alias("_w"),
                        (F.col(order) if order else seeded_hash(seed)).alias("_h")).persist()
    cen = Centres.from_rows(init_rows(pts, k, seed, key, vec, order="_h"), k, dim, key)
    held = pts.select(key, vec, "_w")
    limit = n_k = None   # sklearn-style stop: squared centre shift <= tol x mean per-dimension variance
    key_type = pa.string() if points.schema[key].dataType.simpleString() == "string" else pa.int64()
    schema = f"{key} {points.schema[key].dataType.simpleString()}, cluster int, s array<double>, n long, ss double"
    for _ in range(iters):
        if not cen.active.any():
            break
        bc = spark.sparkContext.broadcast(cen)
        part = held.mapInArrow(_partial_sums(key, vec, dim, k, bc, key_type), schema)
        tot = part.groupBy(key, "cluster").agg(elementwise_sum("s", dim).alias("s"), F.sum("n").alias("n"),
                                               F.sum("ss").alias("ss")).collect()
        new = cen.c.copy()
        if limit is None:     # the first round also gives each key's variance (sums over all its points)
            n_k, s_k, ss_k = np.zeros(len(cen.keys)), np.zeros((len(cen.keys), dim)), np.zeros(len(cen.keys))
        for r in tot:
            i = cen.pos[r[key]]
            new[i, r["cluster"]] = np.asarray(r["s"]) / r["n"]
            if limit is None:
                n_k[i] += r["n"]; s_k[i] += np.asarray(r["s"]); ss_k[i] += r["ss"]
        if limit is None:
            mean = s_k / np.maximum(n_k, 1)[:, None]
            limit = tol * np.maximum(ss_k / np.maximum(n_k, 1) - (mean * mean).sum(axis=1), 0.0) / dim
            rows_held = n_k.sum()
        shift = ((new - cen.c) ** 2).sum(axis=(1, 2))
        cen.c = new
        cen.active = cen.active & (shift > limit)
        bc.unpersist()
        left = n_k[cen.active].sum()
        if 0 < left <= rows_held / 2:
            live = [cen.keys[i] for i in np.flatnonzero(cen.active)]
            some = F.broadcast(spark.createDataFrame([(q,) for q in live], pts.select(key).schema))
            held, rows_held = cut_lineage(held.join(some, key, "left_semi")), left
    pts.unpersist()
    return KeyedKMeans(cen, key, vec, dim)


class KeyedKMeans:
    def __init__(self, centres: Centres, key: str, vec: str, dim: int):
        self.centres, self.key, self.vec, self.dim = centres, key, vec, dim

    def centres_df(self, spark) -> DataFrame:
        rows = [(q, int(j), [float(v) for v in self.centres.c[i, j]])
                for q, i in self.centres.pos.items() for j in range(self.centres.c.shape[1]) if self.centres.valid[i, j]]
        return spark.createDataFrame(rows, f"{self.key} string, cid int, c array<double>")

    def labels(self, points: DataFrame) -> DataFrame:
        """Points with their ``cluster`` (one Arrow pass, centres broadcast)."""
        spark = points.sparkSession
        bc = spark.sparkContext.broadcast(self.centres)
        key, vec, d = self.key, self.vec, self.dim
        other = [c for c in points.columns if c != vec]
        fields = ", ".join(f"{c} {points.schema[c].dataType.simpleString()}" for c in other)

        def run(batches):
            cen = bc.value
            keys = pa.array(cen.keys)
            for b in batches:
                if b.num_rows == 0:
                    continue
                qi = positions(b.column(key), keys)
                lab = _assign(matrix(b.column(vec), d), qi, cen.c, cen.valid)
                yield pa.RecordBatch.from_arrays([b.column(c) for c in other] + [b.column(vec), pa.array(lab.astype(np.int32))],
                                                 names=other + [vec, "cluster"])

        return points.mapInArrow(run, f"{fields}, {vec} {points.schema[vec].dataType.simpleString()}, cluster int")

    def query_clusters(self, qb: QueryBlock) -> dict:
        """K2: nearest centre of each query vector (raw query vector, as the model sees it)."""
        out = {}
        for q, i in self.centres.pos.items():
            j = qb.pos.get(q)
            if j is None:
                continue
            x = qb.raw[j][None, :]
            out[q] = int(_assign(x, np.array([i]), self.centres.c, self.centres.valid)[0])
        return out

    def same_cluster_similarity(self, rows: DataFrame, qb: QueryBlock, keep=("name",)) -> DataFrame:
        """K3 + cosine: candidates in the query's cluster, with their cosine to the query."""
        spark = rows.sparkSession
        bc = spark.sparkContext.broadcast((self.centres, self.query_clusters(qb), qb))
        key, vec, d = self.key, self.vec, self.dim
        keep = list(keep)
        fields = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in [key] + keep)

        def run(batches):
            cen, qcl, block = bc.value
            keys = pa.array(cen.keys)
            want = np.array([qcl.get(q, -1) for q in cen.keys], dtype=np.int64)       # by position, as the next
            where = np.array([block.pos.get(q, -1) for q in cen.keys], dtype=np.int64)
            for b in batches:
                if b.num_rows == 0:
                    continue
                qi = positions(b.column(key), keys)
                x = matrix(b.column(vec), d)
                lab = _assign(x, qi, cen.c, cen.valid)
                sel = np.nonzero(lab == want[qi])[0]
                if len(sel) == 0:
                    continue
                xs = x[sel]
                n = np.linalg.norm(xs, axis=1)
                qv = block.unit[where[qi[sel]]]
                sim = np.where(n > 0, (xs * qv).sum(axis=1) / np.where(n > 0, n, 1), 0.0)
                cols = [b.column(key).take(pa.array(sel))] + [b.column(c).take(pa.array(sel)) for c in keep]
                yield pa.RecordBatch.from_arrays(cols + [pa.array(sim)], names=[key] + keep + ["similarity"])

        return rows.select(key, *keep, vec).mapInArrow(run, f"{fields}, similarity double")


def nearest(vec_col, centres_col="centres"):
    """Expression form of the nearest-centre rule (for small checks and SQL parity)."""
    v = F.col(vec_col) if isinstance(vec_col, str) else vec_col
    return F.array_min(F.transform(F.col(centres_col), lambda s: F.struct(sq_dist(v, s["c"]).alias("d"), s["cid"].alias("cid"))))["cid"]
