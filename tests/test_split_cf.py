"""Split invariants, hot-group masking, sparse CF vs dense NumPy."""
import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from hoprank.operators import cf as CF
from hoprank.operators import split


def test_train_test_partition_the_rows(ws):
    n_all = ws.reviews.count()
    ids_train = set(r.id for r in ws.train.select("id").collect())
    ids_test = set(r.id for r in ws.test.select("id").collect())
    assert not ids_train & ids_test
    assert len(ids_train) + len(ids_test) == n_all
    assert ws.test.filter(F.col("rating") <= 3.5).count() == 0


def test_mask_with_hash_ranges_equals_plain_window(spark):
    # one hot reviewer with most rows, a few small ones
    rows = [(f"id{i}", "hot" if i % 10 else f"u{i % 7}") for i in range(5000)]
    df = spark.createDataFrame(rows, "id string, reviewer string")
    got = set(r.id for r in split.mask_per_group(df, 0.1, 7).collect())
    h = df.withColumn("h", split.row_hash(7))
    w = Window.partitionBy("reviewer").orderBy("h")
    plain = (h.withColumn("rk", F.row_number().over(w)).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("reviewer")))
             .filter(F.col("rk") <= F.greatest(F.floor(F.col("n") * 0.1), F.lit(1))))
    assert got == set(r.id for r in plain.collect())


def test_sparse_cf_equals_dense(ws):
    cells = CF.utility(ws.train, "midpoint")
    pdf = cells.toPandas()
    m = pdf.pivot_table(index="reviewer", columns="name", values="x", fill_value=0.0)
    x = m.to_numpy()
    nrm = np.linalg.norm(x, axis=1, keepdims=True)
    u = np.divide(x, nrm, out=np.zeros_like(x), where=nrm > 0)
    sim = u @ u.T
    pred = sim @ x / (np.abs(sim).sum(axis=1)[:, None] + 1e-8)
    users = ws.test.select("reviewer").distinct()
    got = CF.predict(cells, CF.user_similarity(cells, "cosine", users)).toPandas()
    rows = {r: i for i, r in enumerate(m.index)}
    cols = {c: j for j, c in enumerate(m.columns)}
    for r in got.itertuples():
        assert abs(pred[rows[r.reviewer], cols[r.name]] - r.pred) < 1e-9
    # every non-zero dense prediction of a target user is present
    targets = set(got.reviewer)
    nz = sum(int((np.abs(pred[rows[t]]) > 1e-12).sum()) for t in targets if t in rows)
    assert nz == len(got)


def test_hot_items_and_users_are_cut_into_blocks(spark, monkeypatch):
    """One item that everybody rated and one user who rated everything: the same results in blocks of three rows."""
    import random
    rng = random.Random(6)
    rows = [(f"u{u}", "hot", 1.0 + rng.randrange(9) / 2) for u in range(40)] + [("u0", f"i{i}", 1.0 + rng.randrange(9) / 2) for i in range(30)]
    rows += [(f"u{u}", f"i{i}", 1.0 + rng.randrange(9) / 2) for u in range(1, 40) for i in rng.sample(range(30), 3)]
    train = spark.createDataFrame(rows, "reviewer string, name string, rating double")
    users = spark.createDataFrame([("u0",), ("u5",), ("u9",)], "reviewer string")

    def results():
        cells = CF.utility(train, "midpoint")
        sim = CF.user_similarity(cells, "cosine", users)
        out = [sim, CF.predict(cells, sim), CF.predict(CF.utility(train, "raw"), sim, mode="mean_added"),
               CF.user_similarity(CF.utility(train, "like"), "jaccard", users)]
        return [sorted((r[0], r[1] or "", round(r[2], 9)) for r in df.collect()) for df in out]
    whole = results()
    monkeypatch.setattr(CF, "BLOCK_ROWS", 3)
    assert results() == whole and all(whole)
    joined = CF.blocked_join(users.withColumn("name", F.lit("hot")), train.withColumnRenamed("reviewer", "v"), "name", "v")
    assert joined.count() == 3 * 40
