"""NumPy brute force for the vector paths: signatures, probe vs index join, kNN, keyed k-means."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from hoprank.operators import kmeans as KM
from hoprank.operators import lsh as LSH
from hoprank.operators.knn import knn_exact


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(43)
    x = rng.standard_normal((200, 16))
    rows = spark.createDataFrame([(f"r{i}", f"item{i % 23}", [float(v) for v in x[i]]) for i in range(200)],
                                 "id string, name string, embedding array<double>")
    q = spark.createDataFrame([(f"q{i}", [float(v) for v in x[i]]) for i in range(0, 200, 20)],
                              "query_id string, embedding array<double>")
    return x, rows, q


def test_signature_paths_agree_with_numpy(spark, data):
    x, rows, _ = data
    planes = LSH.make_hyperplanes(16, 7, 3, seed=42)
    want = ((np.einsum("nd,lkd->nlk", x, planes) > 0) * (1 << np.arange(6, -1, -1))).sum(axis=2)
    for method in ("expr", "arrow"):
        got = {r.id: r.buckets for r in LSH.lsh_signature(rows, planes, method=method).collect()}
        assert all(list(want[i]) == got[f"r{i}"] for i in range(200))


def test_probe_equals_index_join_and_finds_itself(spark, data):
    _, rows, q = data
    planes = LSH.make_hyperplanes(16, 6, 4, seed=1)
    joined = LSH.candidate_similarity(LSH.fetch_candidates(LSH.query_index(LSH.build_index(rows, planes), q, planes), rows), q)
    probed = LSH.probe_candidates(rows, q, planes)
    a = sorted((r.query_id, r.id, round(r.similarity, 9)) for r in joined.collect())
    b = sorted((r.query_id, r.id, round(r.similarity, 9)) for r in probed.collect())
    assert a == b
    assert {(f"q{i}", f"r{i}") for i in range(0, 200, 20)} <= {(t[0], t[1]) for t in a}


def test_more_tables_more_candidates_more_bits_fewer(spark, data):
    _, rows, q = data
    base = LSH.make_hyperplanes(16, 8, 6, seed=3)
    def n(planes):
        return LSH.probe_candidates(rows, q, planes).count()
    assert n(base[:3]) <= n(base)                 # fewer tables: subset
    assert n(base[:, :8]) <= n(base[:, :4])       # more bits: subset


def test_knn_exact(spark, data):
    x, rows, q = data
    got = knn_exact(rows, q, 5).collect()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for qi in range(0, 200, 20):
        want = [f"r{j}" for j in np.lexsort((np.array([f"r{j}" for j in range(200)]), -np.round(u @ u[qi], 9)))[:5]]
        assert [r.id for r in sorted((r for r in got if r.query_id == f"q{qi}"), key=lambda r: r.rank)] == want


def test_keyed_kmeans_matches_numpy_lloyd(spark, data):
    x, rows, _ = data
    pts = rows.withColumn("query_id", F.concat(F.lit("g"), (F.substring("id", 2, 3).cast("int") % 2).cast("string")))
    fit = KM.keyed_kmeans(pts, k=3, iters=50, seed=7)
    init = {(r.query_id, r.cid): np.array(r.c) for r in KM.init_centres(pts, 3, 7).collect()}
    for g in ("g0", "g1"):
        idx = [i for i in range(200) if i % 2 == int(g[1])]
        c = np.stack([init[(g, j)] for j in range(3)])
        for _ in range(50):
            lab = ((x[idx][:, None, :] - c) ** 2).sum(2).argmin(1)
            c = np.stack([x[idx][lab == j].mean(0) if (lab == j).any() else c[j] for j in range(3)])
        got = fit.centres.c[fit.centres.pos[g]]
        assert np.allclose(got, c, atol=1e-9)


def test_init_with_repeated_vectors_uses_distributed_path(spark):
    rows = [(f"r{i}", "hot", [1.0, 0.0]) for i in range(300)] + [("x1", "hot", [0.0, 1.0]), ("x2", "hot", [1.0, 1.0])]
    pts = spark.createDataFrame(rows, "id string, query_id string, embedding array<double>")
    got = KM.init_rows(pts, 3, 7, first=2, cap=8)
    assert sorted(tuple(r["c"]) for r in got) == [(0.0, 1.0), (1.0, 0.0), (1.0, 1.0)]


def lloyd(x, k, seed, ids, tol=1e-4):
    """One query by itself, in NumPy."""
    import hashlib
    order = sorted(range(len(x)), key=lambda i: hashlib.md5(f"{seed}|{ids[i]}".encode()).hexdigest())
    c, seen = [], set()
    for i in order:
        if x[i].tobytes() not in seen:
            seen.add(x[i].tobytes())
            c.append(x[i].astype(float))
        if len(c) == k:
            break
    c, x = np.array(c), x.astype(float)
    limit = tol * x.var(axis=0).mean()
    for _ in range(300):
        lab = ((x[:, None] - c) ** 2).sum(axis=2).argmin(axis=1)
        new = np.array([x[lab == j].mean(axis=0) if (lab == j).any() else c[j] for j in range(len(c))])
        moved, c = ((new - c) ** 2).sum(), new
        if moved <= limit:
            break
    return ((x[:, None] - c) ** 2).sum(axis=2).argmin(axis=1)


def test_a_query_gets_the_same_clusters_alone_and_in_any_batch(spark):
    """Queries that need few rounds beside ones that need many: each is frozen by its own limit."""
    rng = np.random.default_rng(12)
    rows, data = [], {}
    for q in range(8):
        n = (1200, 900, 40, 12, 3, 700, 60, 500)[q]
        x = rng.normal(size=(n, 6)).astype(np.float32)
        if q % 2:
            x[: n // 2] += 25.0                       # far groups: few rounds
        data[f"q{q}"] = x
        rows += [(f"q{q}", f"{q}-{i}", [float(v) for v in r]) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "query_id string, id string, embedding array<float>").repartition(5)
    both = {r["id"]: r["cluster"] for r in KM.keyed_kmeans(df, k=5).labels(df).select("id", "cluster").collect()}
    for q, x in data.items():
        ids = [f"{q[1:]}-{i}" for i in range(len(x))]
        assert [both[i] for i in ids] == lloyd(x, 5, 7, ids).tolist(), q
    one = df.filter("query_id = 'q0'").repartition(3)
    alone = {r["id"]: r["cluster"] for r in KM.keyed_kmeans(one, k=5).labels(one).select("id", "cluster").collect()}
    assert alone == {i: both[i] for i in alone}
