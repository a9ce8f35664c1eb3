"""Encoder, pooling, per-item vectors (V2-V4), z-score cells (F4), plain-sum weighting (H7)."""
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hoprank.operators import cf as CF
from hoprank.operators.embed import HashEmbedder, embed_by_item, embed_text, pool_vectors


def test_hash_embedder_is_unit_seeded_and_spelling_aware():
    m = HashEmbedder(64, 7)
    a, b, c = m.encode(["bitter", "bitterness", "vanilla"])
    assert np.isclose(np.linalg.norm(a), 1) and np.allclose(m.encode("bitter"), a)
    assert a @ b > a @ c
    assert not np.allclose(HashEmbedder(64, 8).encode("bitter"), a)


def test_embed_pool_and_item_vectors(spark):
    df = spark.createDataFrame([("i1", "dark coffee"), ("i1", "coffee roast"), ("i2", "lemon"), ("i3", "  ")],
                               "name string, review_text string")
    rows = {r.review_text: np.array(r.embedding) for r in embed_text(df, "review_text").collect()}
    assert np.allclose(rows["lemon"], HashEmbedder().encode("lemon"))
    items = {r.name: np.array(r.embedding) for r in embed_by_item(df).collect()}
    assert set(items) == {"i1", "i2"}                                   # empty texts skipped
    assert np.allclose(items["i1"], (rows["dark coffee"] + rows["coffee roast"]) / 2)
    t = spark.createDataFrame([([[1.0, 2.0], [3.0, 4.0]],)], "tv array<array<double>>")
    assert t.select(pool_vectors("tv", "first")).first()[0] == [1.0, 2.0]
    assert t.select(pool_vectors("tv", "mean", 2)).first()[0] == [2.0, 3.0]


def test_zscore_cells_match_pandas(spark):
    rows = [("u1", "a", 4.0), ("u1", "b", 2.0), ("u1", "b", 3.0), ("u2", "a", 5.0), ("u3", "c", 3.0)]
    df = spark.createDataFrame(rows, "reviewer string, name string, rating double")
    got = {(r.reviewer, r.name): r.x for r in CF.utility(df, "zscore").collect()}
    p = pd.DataFrame(rows, columns=["reviewer", "name", "rating"])
    m, sd = p.groupby("reviewer").rating.mean(), p.groupby("reviewer").rating.std()
    p["z"] = [(r - m[u]) / sd[u] if sd[u] > 0 else 0.0 for u, r in zip(p.reviewer, p.rating)]
    want = p.groupby(["reviewer", "name"]).z.mean().to_dict()
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_plain_sum_weighting(spark):
    from hoprank.operators.lsh import make_hyperplanes
    from hoprank.plans.recommend import Model, hybrid
    train = spark.createDataFrame([("r1", "i1", "u1", 5.0, 5.0, "A", [1.0, 0.0]), ("r2", "i2", "u1", 4.0, 6.0, "B", [0.0, 1.0])],
                                  "id string, name string, reviewer string, rating double, abv double, subgenre string, embedding array<double>")
    items = train.select("name", "abv", "subgenre")
    model = Model(train=train, items=items, planes=make_hyperplanes(2, 2, 1))
    text = spark.createDataFrame([("q", "i1", 0.5), ("q", "i2", 0.25)], "query_id string, name string, lsh_score double")
    q = spark.createDataFrame([("q", [1.0, 0.0], "u1", None, None)],
                              "query_id string, embedding array<double>, reviewer string, abv_desired double, style_desired string")
    out = {r.beer: r for r in hybrid(model, q, text, beta_mode="sum", n=None).collect()}
    for b in ("i1", "i2"):
        assert out[b].score == pytest.approx(out[b].lsh_score + out[b].collab_score)
