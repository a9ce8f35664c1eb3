"""Penalty shapes (H3), beta (F15), population standardisation (K5), TF-IDF idf (K4)."""
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from hoprank.functions import scoring as S
from hoprank.operators import cluster as K


def test_penalty_shapes_at_9_vs_6(spark):
    df = spark.createDataFrame([(9.0, 6.0)], "abv double, want double")
    a = 0.02
    want = {"square": a * 9, "linear": a * 3, "log": a * math.log(4), "log_scaled": a * math.log(1.5),
            "linear_scaled": a * 0.5, "scaled_square": a * 9 / (6 ** 1.5 + 1)}
    for kind, v in want.items():
        got = df.select(S.abv_penalty("abv", "want", kind=kind, alpha=a)).first()[0]
        assert got == pytest.approx(-v)


def test_beta_log(spark):
    df = spark.createDataFrame([(0,), (1,), (2,), (100,)], "n int")
    got = [r[0] for r in df.select(S.beta_log("n")).collect()]
    assert got[0] == pytest.approx(0.55) and got[1] == pytest.approx(1.0)
    assert got[2] == pytest.approx(0.55 + 0.45 / (1 + math.log(2)))
    assert all(0.55 < b <= 1 for b in got[1:])


def test_standardizer_uses_population_sigma(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (6.0,)], "abv double")
    out = [r.abv_scaled for r in K.fit_standardizer(df).transform(df).collect()]
    x = np.array([1.0, 2.0, 6.0])
    assert np.allclose(out, (x - x.mean()) / x.std())


def test_tfidf_idf_has_plus_one(spark):
    df = spark.createDataFrame([("aa bb",), ("aa cc",), ("aa bb",)], "review_text string")
    m = K.fit_tfidf(df, max_features=10)
    vocab = m.stages[1].vocabulary
    scale = dict(zip(vocab, m.stages[2].getScalingVec().toArray()))
    n = 3
    assert scale["aa"] == pytest.approx(math.log((1 + n) / (1 + 3)) + 1)     # in every document: 1, not 0
    assert scale["bb"] == pytest.approx(math.log((1 + n) / (1 + 2)) + 1)
    rows = m.transform(df).collect()
    assert all(abs(np.linalg.norm(r.tfidf.toArray()) - 1) < 1e-9 for r in rows)


def own_view(x, dims=2):
    """Centred points on the first principal axes, the largest entry of an axis positive."""
    x = x - x.mean(axis=0)
    axes = np.linalg.svd(x, full_matrices=False)[2][:dims]
    axes *= np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(axis=1)])[:, None]
    return x @ axes.T


def test_each_bucket_is_projected_on_its_own_axes(spark, monkeypatch):
    from hoprank.functions import arrowvec
    rng = np.random.default_rng(3)
    buckets = {q: rng.normal(size=(n, 6)) * rng.permutation([9.0, 4, 2, 1, 0.5, 0.1]) + 50 * rng.normal(size=6)
               for q, n in ((1, 300), (2, 12), (3, 40), (4, 1))}
    points = spark.createDataFrame([(q, i, i % 3, x.tolist()) for q, m in buckets.items() for i, x in enumerate(m)],
                                   "query_id long, id long, cluster int, embedding array<double>").repartition(5)
    queries = spark.createDataFrame([(q, m[0].tolist()) for q, m in buckets.items()] + [(5, [0.0] * 6)],
                                    "query_id long, embedding array<double>")
    for limit in (128 << 20, 1200):                         # one block of queries, and several
        monkeypatch.setattr(arrowvec, "MAX_BLOCK_BYTES", limit)
        got = K.project_buckets(points, queries).collect()
        assert len(got) == 353 and all(r["cluster"] == r["id"] % 3 for r in got)
        for q, m in buckets.items():
            xy = np.array([r["xy"] for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["id"])])
            want = own_view(m) if len(m) > 1 else np.zeros((1, 2))
            assert np.allclose(xy, want, atol=1e-6)


def test_bucket_projection_query_has_one_view_per_query(spark, ws):
    import collections

    from hoprank.plans.catalog import q_bucket_projection
    vecs = {r["id"]: np.array(r["embedding"], dtype=float) for r in ws.train.select("id", "embedding").collect()}
    rows = collections.defaultdict(list)
    for r in q_bucket_projection(spark, ws.sf_dir).collect():
        rows[r["query_id"]].append((vecs[r["id"]], r["xy"]))
    assert len(rows) > 1
    for points in rows.values():
        x, xy = (np.array(v) for v in zip(*points))
        cov = np.atleast_2d(xy.T @ xy / len(xy))
        spread = np.linalg.eigvalsh(np.cov(x.T, bias=True))[::-1][:2] if len(x) > 1 else np.zeros(2)
        assert np.allclose(xy.mean(axis=0), 0, atol=1e-6) and np.allclose(cov, np.diag(spread), atol=1e-6)
