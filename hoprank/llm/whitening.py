"""Embedding whitening: blockwise QR of centred rows, bidiagonal form, dqds, twisted factorisations.

The vectors become integers (floor of SCALE times an entry), and each distinct one
counts once in the fit.  Their sums are exact, so a row is centred exactly before
anything is multiplied.  Every task folds its rows block by block into a triangle R
(QR of the triangle so far and the next block); triangles are merged in groups of a
bounded number, round by round, until one is left.  No product of the rows with
themselves is ever formed, so small singular values keep their digits.

The last triangle is as large as the dimension squared, whatever the number of rows.
Householder reflections bring it to upper bidiagonal form B.  dqds (differential
quotient-difference with shifts) finds the squares of B's singular values without
subtracting anything from a matrix entry but a shift that keeps all quotients
positive.  A twisted factorisation of B'B less such a value, split where its middle
pivot is smallest, gives the singular vector without iteration.

Defined results: rows whose vector is null, or holds a null, NaN or infinite entry, are
left out, and so are vectors whose length isn't the most frequent one (of equally
frequent ones the greatest), as entries are missing there.  Entries beyond 64 bits
after scaling count as the nearest 64-bit number.  Repeated vectors, repeated rows and
null ids get a result each.  Components without variance (a singular value below
NOISE of the largest) have no direction to scale and are left out, so equal vectors or
a single one give no rows, as does an empty table.  Equal eigenvalues: any orthogonal
directions of their space, the same ones for all rows.  ``deviation`` is null where it
does not fit 64 bits.  Other columns are not looked at.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from . import common as C

SCALE = 256
#: Directions that the query returns.
COMPONENTS = 4
#: Rows that are folded into a triangle at once, as a multiple of the dimension.
FOLD = 16
#: Bytes of triangles that one merge holds; at least two are merged.
MERGE_BYTES = 64 << 20
#: Singular values below this share of the largest are rounding, not variance.
NOISE = 1e-12

EPS = np.finfo(float).eps
R_SCHEMA = "part long, r binary"
DIRECTIONS = "component int, eigenvalue double, explained double, direction array<double>"


# ---------------------------------------------------------------- small matrices

def fold(r: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The triangle of the rows so far and of some more."""
    return np.linalg.qr(np.vstack([r, rows]), mode="r")


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Householder: diagonal and superdiagonal of U'RV, and V."""
    a = np.array(r, dtype=float)
    d = a.shape[1]
    v = np.eye(d)

    def reflector(x):
        """u and scale of I - scale u u', which maps x onto its first axis."""
        u = x.copy()
        norm = float(np.linalg.norm(x))
        if norm == 0 or not x[1:].any():
            return u, 0.0
        u[0] += math.copysign(norm, x[0])
        return u, 2.0 / float(u @ u)

    for k in range(d):
        u, s = reflector(a[k:, k])
        if s:
            a[k:, k:] -= np.outer(s * u, u @ a[k:, k:])
        if k < d - 2:
            u, s = reflector(a[k, k + 1:])
            if s:
                a[k:, k + 1:] -= np.outer(a[k:, k + 1:] @ u, s * u)
                v[:, k + 1:] -= np.outer(v[:, k + 1:] @ u, s * u)
    return np.diag(a).copy(), np.diag(a, 1).copy(), v


def _dqds_step(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], float] | None:
    """One transform, or None if the shift is above the smallest value."""
    n = len(q)
    new_q, new_e = [0.0] * n, [0.0] * (n - 1)
    d = low = q[0] - shift
    for k in range(n - 1):
        if d < 0:
            return None
        s = d + e[k]
        new_q[k] = s
        ratio = q[k + 1] / s if s else 0.0
        new_e[k] = e[k] * ratio
        d = d * ratio - shift if s else q[k + 1] - shift
        low = min(low, d)
    if d < 0:
        return None
    new_q[-1] = d
    return new_q, new_e, low


def dqds(diagonal: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Squares of the singular values of an upper bidiagonal matrix, falling, each to high relative accuracy."""
    found: list[float] = []
    todo = [([float(x) ** 2 for x in diagonal], [float(x) ** 2 for x in above], 0.0)]
    while todo:
        q, e, done = todo.pop()                     # done: what has been shifted away
        while q:
            if len(q) == 1:
                found.append(done + q[0])
                break
            small = next((k for k in range(len(e) - 1, -1, -1)
                          if e[k] <= EPS * EPS * (done + q[k + 1]) or e[k] <= EPS * EPS * min(q[k], q[k + 1])), None)
            if small is not None:
                todo.append((q[:small + 1], e[:small], done))
                q, e = q[small + 1:], e[small + 1:]
                continue
            if 1.5 * q[0] < q[-1]:                  # small values are found at the end
                q, e = q[::-1], e[::-1]
            # the smaller eigenvalue of the last two by two block is near the smallest of all
            t = 0.5 * (q[-2] + e[-1] + q[-1])
            gap = math.sqrt(max(t * t - q[-2] * q[-1], 0.0))
            shift = q[-2] * q[-1] / (t + gap) if t + gap else 0.0
            step = None
            for _ in range(6):
                step = _dqds_step(q, e, shift) if shift > EPS * done else None
                if step is not None:
                    break
                shift *= 0.25
            if step is None:
                shift = 0.0
                step = _dqds_step(q, e, 0.0)
            done += shift
            q, e = step[0], step[1]
    return np.array(sorted(found, reverse=True))


def _twisted(a: np.ndarray, b: np.ndarray, value: float) -> np.ndarray:
    """The vector of B'B to an eigenvalue, B with diagonal a and superdiagonal b, by a twisted factorisation."""
    n = len(a)
    if n == 1:
        return np.ones(1)
    tiny = EPS * EPS * max(value, float(np.max(a * a)), 1e-290)
    d = np.where(a * a > tiny, a * a, tiny)
    low = a * np.append(b, 0.0) / d                  # unit lower factor of B'B = L D L'
    down, up = np.zeros(n), np.zeros(n)              # factors of the stationary and progressive transforms
    s, p = np.zeros(n), np.zeros(n)
    s[0] = -value
    for k in range(n - 1):
        pivot = s[k] + d[k]
        pivot = pivot if abs(pivot) > tiny else tiny
        down[k] = d[k] * low[k] / pivot
        s[k + 1] = down[k] * low[k] * s[k] - value
    p[-1] = d[-1] - value
    for k in range(n - 2, -1, -1):
        pivot = d[k] * low[k] * low[k] + p[k + 1]
        pivot = pivot if abs(pivot) > tiny else tiny
        up[k] = d[k] * low[k] / pivot
        p[k] = p[k + 1] * d[k] / pivot - value
    middle = int(np.argmin(np.abs(s + p + value)))
    z = np.zeros(n)
    z[middle] = 1.0
    for k in range(middle - 1, -1, -1):
        z[k] = -down[k] * z[k + 1]
    for k in range(middle, n - 1):
        z[k + 1] = -up[k] * z[k]
    return z / np.linalg.norm(z)


def right_vectors(r: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest squared singular values of a triangle, and their right singular vectors as columns."""
    a, b, v = bidiagonal(r)
    size = float(np.max(np.abs(np.concatenate([a, b])), initial=0.0))
    cut = np.flatnonzero(np.abs(b) <= EPS * size)             # independent blocks
    edges = [0, *(cut + 1), len(a)]
    pairs = [(x, lo, hi) for lo, hi in zip(edges, edges[1:]) for x in dqds(a[lo:hi], b[lo:hi - 1])]
    pairs = sorted(pairs, key=lambda p: (-p[0], p[1]))[:k]
    out = np.zeros((len(a), len(pairs)))
    for j, (value, lo, hi) in enumerate(pairs):
        z = _twisted(a[lo:hi], b[lo:hi - 1], value)
        near = [i for i, other in enumerate(pairs[:j]) if other[1] == lo and other[0] - value <= 1e-6 * other[0]]
        if near:                                     # a cluster: inverse iteration, kept orthogonal to those found
            others = out[lo:hi, near]
            full = np.diag(a[lo:hi]) + np.diag(b[lo:hi - 1], 1)
            shifted = full.T @ full - value * (1 + 1e-10) * np.eye(hi - lo)
            t = z - others @ (others.T @ z)
            z = t if np.linalg.norm(t) > 0.5 else np.cos(np.arange(hi - lo) * (j + 1.0))
            for _ in range(4):
                z = np.linalg.solve(shifted, z)
                for _ in range(2):
                    z = z - others @ (others.T @ z)
                z /= np.linalg.norm(z)
        out[lo:hi, j] = z
    return np.array([p[0] for p in pairs]), v @ out


# ---------------------------------------------------------------- rows

def integer_rows(embeddings: DataFrame) -> DataFrame:
    """vec_id and the integer vector of every row that takes part, written once."""
    e = F.col("embedding")
    bad = F.exists(e, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), e).filter(e.isNotNull() & ~bad)
    sizes = rows.groupBy(F.size(e).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    dim = sizes[0]["d"] if sizes else 0
    x = F.transform(e, lambda c: F.floor(F.lit(float(SCALE)) * c.cast("double")) + F.lit(0).cast("long"))
    return C.written(rows.filter(F.size(e) == dim).select("vec_id", x.alias("x")), "vectors")


def _matrix(col: pa.Array) -> np.ndarray:
    """An array column of equally long vectors without nulls as a matrix."""
    flat = col.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(col), -1)


def _sum_batches(batches):
    """Exact sums per dimension and the number of rows."""
    total, n = None, 0
    for rb in batches:
        x = _matrix(rb.column("x"))
        if not len(x):
            continue
        fits = float(np.abs(x.astype(float)).max(initial=0)) * len(x) < 2.0 ** 62
        part = (x if fits else x.astype(object)).sum(axis=0)
        part = [int(v) for v in part]
        total = part if total is None else [a + b for a, b in zip(total, part)]
        n += len(x)
    if n:
        yield pa.RecordBatch.from_arrays([
            pa.array(range(len(total)), pa.int32()), pa.array([str(v) for v in total]), pa.array([n] * len(total), pa.int64())],
            names=["dim", "s", "n"])


def fit_sums(fit: DataFrame) -> tuple[int, list[int]]:
    """Number of vectors and the exact sum of each dimension (as many values as the dimension)."""
    got = (fit.mapInArrow(_sum_batches, "dim int, s string, n long").groupBy("dim")
           .agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.sum("n").alias("n")).orderBy("dim").collect())
    return (got[0]["n"], [int(r["s"]) for r in got]) if got else (0, [])


def centred(x: np.ndarray, n: int, sums: list[int]) -> tuple[np.ndarray, np.ndarray | list]:
    """x less the mean, from exact integers, and the exact sums of squares of n*x - S (None beyond 64 bits)."""
    most = max(float(np.abs(x.astype(float)).max(initial=0)) * n, float(max(map(abs, sums), default=0))) * 2
    if most * most * max(len(sums), 1) < 2.0 ** 62:
        t = x * np.int64(n) - np.array(sums, dtype=np.int64)
        return t / n, (t * t).sum(axis=1)
    t = x.astype(object) * n - np.array(sums, dtype=object)
    square = [sum(v * v for v in row) for row in t]
    return (t / n).astype(float), [v if v < 2 ** 63 else None for v in square]


def _triangles(n: int, sums: list[int]):
    d = len(sums)

    def run(batches):
        r, seen = np.zeros((0, d)), False
        for rb in batches:
            x = _matrix(rb.column("x"))
            for lo in range(0, len(x), FOLD * d):
                r, seen = fold(r, centred(x[lo:lo + FOLD * d], n, sums)[0]), True
        if seen:
            yield pa.RecordBatch.from_arrays([C.binary_array([r.tobytes()])], names=["r"])
    return run


def _merge(d: int):
    def run(table: pa.Table) -> pa.Table:
        r = np.zeros((0, d))
        for one in table.column("r").to_pylist():
            r = fold(r, np.frombuffer(one).reshape(-1, d))
        return pa.table([pa.array([table.column("g")[0].as_py()], pa.int64()), C.binary_array([r.tobytes()])], names=["part", "r"])
    return run


def triangle(fit: DataFrame, n: int, sums: list[int]) -> DataFrame:
    """One row: the triangle of all centred rows, merged in rounds of bounded groups."""
    d = len(sums)
    together = max(2, MERGE_BYTES // (8 * d * d))
    parts = C.written(fit.mapInArrow(_triangles(n, sums), "r binary")
                      .select(F.spark_partition_id().cast("long").alias("part"), "r"), "triangles")
    top = parts.agg(F.max("part")).collect()[0][0]
    while top > 0:
        grouped = parts.withColumn("g", F.expr(f"part div {together}")).groupBy("g")
        parts = C.written(grouped.applyInArrow(_merge(d), R_SCHEMA), "triangles")
        top //= together
    return parts


def _solve(d: int, n: int, k: int):
    def run(batches):
        for rb in batches:
            for one in rb.column("r").to_pylist():
                r = np.frombuffer(one).reshape(-1, d)
                r = np.vstack([r, np.zeros((d - len(r), d))]) if len(r) < d else r
                size = float(np.abs(r).max(initial=0.0)) or 1.0          # keeps squares in range
                values, v = right_vectors(r / size, k)
                keep = values > NOISE ** 2 * max(values[0], 0.0) if len(values) else values > 0
                keep &= values > 0
                trace = float(((r / size) ** 2).sum())
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.arange(1, len(values) + 1)[keep].astype(np.int32)), pa.array(values[keep] * (size * size / n)),
                    pa.array((values / trace if trace else values)[keep]),
                    pa.array([list(v[:, j]) for j in np.flatnonzero(keep)], pa.list_(pa.float64()))],
                    names=["component", "eigenvalue", "explained", "direction"])
    return run


def directions(fit: DataFrame, n: int, sums: list[int], k: int) -> DataFrame:
    """component, eigenvalue of the covariance (divisor n), explained share, unit direction: the k largest, written."""
    return C.written(triangle(fit, n, sums).select("r").mapInArrow(_solve(len(sums), n, k), DIRECTIONS), "directions")


def _project(n: int, sums: list[int], matrix: np.ndarray, keep: tuple[str, ...]):
    def run(batches):
        for rb in batches:
            if not rb.num_rows:
                continue
            c, square = centred(_matrix(rb.column("x")), n, sums)
            w = c @ matrix
            yield pa.RecordBatch.from_arrays(
                [rb.column(name) for name in keep] + [pa.array(square, pa.int64())]
                + [pa.array(np.ascontiguousarray(w[:, j])) for j in range(w.shape[1])],
                names=[*keep, "deviation", *(f"w{j + 1}" for j in range(w.shape[1]))])
    return run


def whiten(embeddings: DataFrame, k: int = COMPONENTS) -> tuple[DataFrame, DataFrame, int]:
    """vec_id, deviation, w1 .. wk of every row that takes part; the directions; and the number of distinct vectors.

    The directions (at most k vectors) and the sums go to the tasks; both are as large as the dimension.
    """
    ship_package(embeddings.sparkSession)
    rows = integer_rows(embeddings)
    fit = C.written(rows.groupBy("x").agg(F.count(F.lit(1)).alias("copies")), "fit")
    n, sums = fit_sums(fit)
    if not sums:
        empty = embeddings.sparkSession.createDataFrame([], DIRECTIONS + ", identity_error double")
        return rows.select("vec_id", F.lit(None).cast("long").alias("deviation")), empty, n
    found = directions(fit, n, sums, k)
    got = found.orderBy("component").collect()
    matrix = (np.array([r["direction"] for r in got]) / np.sqrt([[r["eigenvalue"]] for r in got])).T if got else np.zeros((len(sums), 0))
    columns = "".join(f", w{j + 1} double" for j in range(len(got)))
    white = rows.mapInArrow(_project(n, sums, matrix, ("vec_id",)), f"vec_id long, deviation long{columns}")
    flat = fit.mapInArrow(_project(n, sums, matrix, ()), f"deviation long{columns}")
    pairs = [(i, j) for i in range(1, len(got) + 1) for j in range(i, len(got) + 1)]
    off = [F.abs(F.covar_pop(f"w{i}", f"w{j}") - F.lit(1.0 if i == j else 0.0)) for i, j in pairs]
    error = flat.agg(F.greatest(*off, F.lit(0.0)).alias("identity_error")).collect()[0][0] if off else 0.0
    return white, found.withColumn("identity_error", F.lit(error)), n


def whitening_query(spark, sf_dir: str) -> DataFrame:
    white, found, n = whiten(C.table(spark, sf_dir, "embeddings"))
    got = found.select("component", "explained", "identity_error").collect()        # COMPONENTS rows at most
    cell = [F.struct(F.lit(r["component"]).cast("int").alias("component"), F.col(f"w{r['component']}").alias("whitened"),
                     F.lit(r["explained"]).alias("explained"), F.lit(r["identity_error"]).alias("identity_error"))
            for r in got]
    if not cell:
        return white.limit(0).selectExpr("vec_id", "cast(null as int) component", "cast(null as long) n", "deviation",
                                         "cast(null as double) whitened", "cast(null as double) explained",
                                         "cast(null as double) identity_error")
    return (white.select("vec_id", F.lit(n).cast("long").alias("n"), "deviation", F.explode(F.array(*cell)).alias("c"))
            .select("vec_id", "c.component", "n", "deviation", "c.whitened", "c.explained", "c.identity_error"))
