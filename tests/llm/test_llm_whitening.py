"""Whitening against dense linear algebra; dqds against exact Sturm counts; awkward vectors."""
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hoprank.llm import whitening as W

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
                       T.StructField("label", T.IntegerType())])
CLASH = ("x", "n", "w1", "part", "r", "g", "component", "dim", "copies")


def below(a, b, t):
    """How many squared singular values of the bidiagonal matrix are below t, counted with exact fractions."""
    t, a, b = Fraction(t), [Fraction(float(v)) for v in a], [Fraction(float(v)) for v in b]
    count, pivot = 0, None
    for k in range(len(a)):
        diag = a[k] ** 2 + (b[k - 1] ** 2 if k else 0) - t
        pivot = diag - ((a[k - 1] * b[k - 1]) ** 2 / pivot if k else 0)
        count += pivot < 0
    return count


@pytest.mark.parametrize("grade", [0.0, -1.5, 2.0])
def test_dqds_gives_each_value_to_high_relative_accuracy(grade):
    rng = np.random.default_rng(5)
    n = 12
    a = rng.uniform(0.5, 2, n) * 10.0 ** (grade * np.arange(n))
    b = rng.uniform(0.1, 1, n - 1) * 10.0 ** (grade * np.arange(n - 1))
    got = W.dqds(a, b)
    for k, value in enumerate(got):                  # falling: n - 1 - k values are smaller
        assert below(a, b, value * (1 - 1e-12)) <= n - 1 - k < below(a, b, value * (1 + 1e-12)), (k, value)


def test_right_vectors_of_hard_triangles():
    rng = np.random.default_rng(1)
    equal = np.eye(6) * 3.0
    pairs = np.diag([5.0, 5, 5, 2, 2, 1]) @ np.linalg.qr(rng.normal(size=(6, 6)))[0]
    low_rank = np.linalg.qr(rng.normal(size=(40, 3)) @ rng.normal(size=(3, 8)), mode="r")
    wilkinson = np.linalg.cholesky(np.diag(np.abs(np.arange(-10, 11.0)) + 2) + np.diag(np.ones(20), 1) + np.diag(np.ones(20), -1)).T
    for r in (equal, pairs, low_rank, wilkinson, np.zeros((4, 4)), np.array([[2.0]]), np.linalg.qr(rng.normal(size=(300, 64)), mode="r")):
        values, v = W.right_vectors(r, 5)
        want = np.linalg.svd(r)[1][:len(values)] ** 2
        assert np.allclose(values, want, rtol=1e-12, atol=1e-13 * max(want[0], 1e-300))
        real = values > 1e-20 * max(values[0], 1e-300)
        v, values = v[:, real], values[real]
        assert np.allclose(v.T @ v, np.eye(v.shape[1]), atol=1e-9)
        assert np.allclose(r.T @ (r @ v), v * values, atol=1e-10 * max(want[0], 1e-300))


def brute(rows):
    kept = [(i, np.array([int(np.floor(256.0 * float(np.float32(c)))) for c in e], dtype=object)) for i, e in rows
            if e is not None and all(c is not None and np.isfinite(c) for c in e)]
    fit = np.array(sorted({tuple(x) for _, x in kept}), dtype=object)
    n, s = len(fit), fit.sum(axis=0)
    c = ((fit * n - s) / n).astype(float)
    e, v = np.linalg.eigh(c.T @ c / n)
    e, v = e[::-1], v[:, ::-1]
    out = {}
    for i, x in kept:
        t = x * n - s
        for k in range(min(4, len(e))):
            if e[k] > 1e-10 * e[0]:
                out.setdefault((i, k + 1), []).append((n, int((t * t).sum()), abs(float((t / n).astype(float) @ v[:, k]) / e[k] ** 0.5), e[k] / e.sum()))
    return out


def run(spark, rows, tmp_path, clash=True):
    df = spark.createDataFrame([(i, e, 1) for i, e in rows], SCHEMA).repartition(5)
    if clash:
        df = df.withColumns({c: F.lit("x") for c in CLASH})
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    got, signs = {}, {}
    for r in W.whitening_query(spark, str(tmp_path)).collect():
        got.setdefault((r["vec_id"], r["component"]), []).append(
            (r["n"], r["deviation"], abs(r["whitened"]), r["explained"]))
        assert r["identity_error"] < 1e-9
        signs.setdefault(r["component"], []).append((r["vec_id"], r["whitened"]))
    return got, signs


def same(got, want):
    assert got.keys() == want.keys()
    for k, rows in want.items():
        a, b = sorted(got[k]), sorted(rows)
        assert [x[:2] for x in a] == [x[:2] for x in b]
        assert np.allclose([x[2:] for x in a], [x[2:] for x in b], rtol=1e-8, atol=1e-9)


def test_whitening_against_dense_algebra(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(W, "MERGE_BYTES", 1)                 # triangles are merged two by two
    rng = np.random.default_rng(0)
    mix = rng.normal(size=(9, 9))
    rows = [(i, [float(c) for c in rng.normal(size=9) @ mix]) for i in range(400)]
    rows += [(1000 + i, rows[3][1]) for i in range(200)] + [(5, rows[5][1]), (None, rows[6][1])]      # copies, repeated rows, null id
    rows += [(2000, None), (2001, [None] * 9), (2002, [float("nan")] + [0.0] * 8), (2003, [float("-inf")] + [0.0] * 8),
             (2004, [1.0, 2.0]), (2005, [])]
    got, _ = run(spark, rows, tmp_path)
    same(got, brute([r for r in rows if r[0] not in (2004, 2005)]))


def test_whitening_of_a_table(spark, tmp_path):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    got, signs = run(spark, rows, tmp_path, clash=False)
    same(got, brute(rows))
    for k, cells in signs.items():                           # one sign for all rows
        w = np.array([v for _, v in cells])
        assert abs(w.mean()) < 1e-9 and w.min() < 0 < w.max()


@pytest.mark.parametrize("rows", [
    [], [(1, None)], [(1, [])], [(1, [0.5, 2.0])], [(i, [0.5, 2.0]) for i in range(5)]])
def test_no_variance_gives_no_rows(spark, tmp_path, rows):
    assert run(spark, rows, tmp_path)[0] == {}


def test_few_dimensions_and_huge_entries(spark, tmp_path):
    rows = [(1, [1e30, 1.0]), (2, [-1e30, 2.0]), (3, [3.0, 4.0])]
    got, _ = run(spark, rows, tmp_path)
    assert {k for k in got} == {(i, 1) for i in (1, 2, 3)}   # the second direction is rounding beside the first
    assert [got[i, 1][0][1] is None for i in (1, 2, 3)] == [True, True, False]
    rows = [(i, [float(i), float(i % 3)]) for i in range(30)]
    got, _ = run(spark, rows, tmp_path / "two")
    same(got, brute(rows))
