"""The planted case worked by hand (3 users, 3 items, 2-d vectors)."""
import math

import pytest
from pyspark.sql import functions as F

from hoprank.functions import scoring as S
from hoprank.operators import cf as CF
from hoprank.operators.lsh import make_hyperplanes
from hoprank.plans.recommend import Model, hybrid


@pytest.fixture(scope="module")
def planted(spark):
    rows = [("r1", "i1", "u1", 5.0, 5.0, "A", [1.0, 0.0]), ("r2", "i1", "u2", 5.0, 5.0, "A", [0.0, 1.0]),
            ("r3", "i2", "u1", 4.0, 7.0, "B", [1.0, 1.0]), ("r4", "i3", "u2", 2.0, 3.0, "C", [-1.0, 0.0]),
            ("r5", "i3", "u3", 3.0, 3.0, "C", [0.0, 1.0]), ("r6", "i3", "u3", 3.0, 3.0, "C", [-2.0, 0.0]),
            ("r7", "i3", "u3", 3.0, 3.0, "C", [0.0, -1.0])]
    df = spark.createDataFrame(rows, "id string, name string, reviewer string, rating double, abv double, "
                                     "subgenre string, embedding array<double>")
    return df


def test_cells_and_similarity(spark, planted):
    cells = CF.utility(planted, "midpoint")
    x = {(r.reviewer, r.name): r.x for r in cells.collect()}
    assert x[("u1", "i1")] == 1.0 and x[("u1", "i2")] == 0.5 and x[("u2", "i3")] == -0.5 and x[("u3", "i3")] == 0.0
    sim = {(r.u, r.v): r.sim for r in CF.user_similarity(cells).collect()}
    assert sim[("u1", "u2")] == pytest.approx(0.8)
    assert ("u3", "u1") not in sim and ("u3", "u3") not in sim      # zero user: similarity 0, not stored


def test_predictions_and_beta(spark, planted):
    cells = CF.utility(planted, "midpoint")
    pred = {(r.reviewer, r.name): r.pred for r in CF.predict(cells, CF.user_similarity(cells)).collect()}
    assert pred[("u1", "i1")] == pytest.approx(1.0, abs=1e-6)
    assert pred[("u1", "i2")] == pytest.approx(0.277778, abs=1e-6)
    assert pred[("u1", "i3")] == pytest.approx(-0.222222, abs=1e-6)
    assert not any(k[0] == "u3" for k in pred)
    betas = {r.reviewer: r.beta for r in CF.user_betas(cells).collect()}
    assert betas["u1"] == pytest.approx(0.815777, abs=1e-6) and betas["u3"] == pytest.approx(1.0)


def test_scores(spark, planted):
    items = planted.groupBy("name").agg(F.first("abv").alias("abv"), F.first("subgenre").alias("subgenre"))
    model = Model(train=planted, items=items, planes=make_hyperplanes(2, 2, 1))
    text = spark.createDataFrame([("q", "i1", 0.5), ("q", "i2", math.sqrt(0.5)), ("q", "i3", -0.5)],
                                 "query_id string, name string, lsh_score double")
    q = spark.createDataFrame([("q", [1.0, 0.0], "u1", 7.0, "A")],
                              "query_id string, embedding array<double>, reviewer string, abv_desired double, style_desired string")
    out = {r.beer: r for r in hybrid(model, q, text, n=None).collect()}
    assert out["i1"].abv_weight == pytest.approx(-0.010246, abs=1e-6)
    assert out["i3"].abv_weight == pytest.approx(-0.040983, abs=1e-6)
    assert out["i1"].style_bonus == 0.05
    assert out["i1"].score == pytest.approx(0.631866, abs=1e-6)
    assert out["i2"].score == pytest.approx(0.628015, abs=1e-6)
    assert out["i3"].score == pytest.approx(-0.489810, abs=1e-6)
    assert [out[b].rank for b in ("i1", "i2", "i3")] == [1, 2, 3]


def test_zero_alcohol_wish(spark):
    df = spark.createDataFrame([(5.0,), (7.0,), (3.0,)], "abv double")
    got = [r[0] for r in df.select(S.abv_penalty("abv", F.lit(0.0), zero_is_wish=True)).collect()]
    assert got == [-10.0, -14.0, -6.0]
    # the final version tests the wish for truth: 0 means no wish
    assert [r[0] for r in df.select(S.abv_penalty("abv", F.lit(0.0))).collect()] == [0.0, 0.0, 0.0]
