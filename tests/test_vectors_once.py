"""Steps over vectors and texts that many reviews share: each is worked on once, reviews move without them."""

import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

from hoprank.operators import cluster as K
from hoprank.operators import kmeans as KM
from hoprank.operators import themes as TH
from hoprank.plans import catalog
from hoprank.plans import grid as GR
from hoprank.plans.recommend import lsh_candidates
from hoprank.sources import html as H


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def repeated(spark):
    """Rows that repeat vectors, and the same as weighted points with their least hash."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(30, 4)).astype(np.float32).astype(float)
    rows = [(f"q{q}", f"r{i}-{n}", i, x[i].tolist()) for q in range(2) for i in range(q, 30) for n in range(1 + i % 4)]
    rows = spark.createDataFrame(rows, "query_id string, id string, vec long, embedding array<double>")
    points = rows.groupBy("query_id", "vec").agg(F.count(F.lit(1)).alias("w"), F.min(KM.seeded_hash(7)).alias("h"), F.first("embedding").alias("embedding"))
    return rows, points.withColumnRenamed("vec", "id")


def test_weighted_kmeans_equals_repeated_rows(repeated):
    rows, points = repeated
    a = KM.keyed_kmeans(rows, k=3, seed=7).centres
    b = KM.keyed_kmeans(points, k=3, seed=7, weight="w", order="h").centres
    assert a.keys == b.keys and np.array_equal(a.valid, b.valid) and np.allclose(a.c, b.c, atol=1e-9)


def test_weighted_projection_equals_repeated_rows(spark, repeated):
    rows, points = repeated
    queries = spark.createDataFrame([("q0", [0.0] * 4), ("q1", [1.0] * 4)], "query_id string, embedding array<double>")
    key = lambda df, c: {(r["query_id"], r[c]): np.round(r["xy"], 6).tolist() for r in df.collect()}
    assert key(K.project_buckets(points, queries, weight="w"), "id") == key(K.project_buckets(rows, queries), "vec")


def test_candidates_move_no_vectors(ws):
    """The reviews meet the vectors that were found; no vector of a review is read, hashed or moved."""
    text = plan(lsh_candidates(ws.model(), ws.queries()))
    assert "embedding" not in text and "MapInArrow" not in text


def test_tfidf_of_weighted_texts_equals_repeated_rows(spark):
    texts = [("aa bb cc", 3), ("aa dd", 1), ("bb bb ee", 2)]
    once = spark.createDataFrame(texts, "review_text string, w long")
    rows = spark.createDataFrame([(t,) for t, w in texts for _ in range(w)], "review_text string")
    def terms(m):
        return dict(zip(m.stages[1].vocabulary, np.round(m.stages[2].getScalingVec().toArray(), 9)))
    assert terms(K.fit_tfidf(once, max_features=10, weight="w")) == terms(K.fit_tfidf(rows, max_features=10))


def test_cluster_fit_reads_each_text_once(spark):
    texts = spark.createDataFrame([(i, f"{'aa bb' if i % 2 else 'cc dd'} word{i}") for i in range(6)], "doc_key long, review_text string")
    rows = spark.createDataFrame([(f"r{i:02d}", f"item{i % 5}", 5.0, "s", 3.0, i % 6) for i in range(60)],
                                 "id string, name string, abv double, subgenre string, average_rating double, doc_key long")
    got, model = K.cluster_reviews(rows, texts, k=2, max_features=20)
    got = got.select("id", "doc_key", "cluster").collect()
    assert len(got) == 30 and len({r["cluster"] for r in got}) == 2          # 5 items x 6 texts
    by = collections.defaultdict(set)
    for r in got:
        by[r["doc_key"] % 2].add(r["cluster"])
    assert all(len(c) == 1 for c in by.values()) and by[0] != by[1]
    again = K.predict_cluster(model, rows.join(texts, "doc_key").select("id", "abv", "review_text"))
    assert {r["id"]: r["cluster"] for r in again.collect()}.items() >= {r["id"]: r["cluster"] for r in got}.items()


def test_top_terms_move_pairs_only(spark, monkeypatch):
    texts = spark.createDataFrame([(1, "red red blue"), (2, "blue green"), (3, None), (None, "red"), (2, "amber")], "doc_key long, review_text string")
    rows = spark.createDataFrame([("a", 1), ("a", 1), ("a", 2), ("b", 2), ("b", 9), ("c", 3), (None, 1)] + [(f"x{i}", 1 + i % 2) for i in range(50)],
                                 "name string, doc_key long")
    monkeypatch.setattr(TH, "OUT_ROWS", 4)
    top = TH.top_terms_by_text(rows, texts, 2)
    text = plan(top)
    assert "Join" not in text and "Window" not in text
    monkeypatch.setattr(TH, "COUNT_BYTES", 0)
    key = lambda df: sorted(map(str, (tuple(r) for r in df.collect())))
    assert key(top) == key(TH.top_terms_by_text(rows, texts, 2)) and ("a", "red", 4, 1) in {tuple(r) for r in top.collect()}


def test_review_pages_are_laid_out_without_text(spark, monkeypatch):
    texts = spark.createDataFrame([(1, "one & <b>"), (2, None), (3, "three")], "doc_key long, review_text string")
    rows = spark.createDataFrame([(f"{i:03d}", f"item {i % 3}", f"u{i}", "DK", "4.0", "2020-01-01", 1 + i % 4, 250) for i in range(200)],
                                 "id string, name string, reviewer string, location string, rating string, review_date string, doc_key long, total_reviews long")
    pages = H.render_review_pages(rows, texts=texts)
    text = plan(pages)
    below = text[text.index("Exchange hashpartitioning"):] if text.index("BroadcastExchange") > text.index("Exchange hashpartitioning") else text
    assert "BroadcastHashJoin" in text and "review_text" not in below.split("BroadcastExchange")[0]
    want = H.render_review_pages(rows.join(texts, "doc_key"))
    key = lambda df: sorted(map(str, df.collect()))
    assert key(pages) == key(want) and pages.count() > 3
    monkeypatch.setattr(H, "SIDE_BYTES", 0)
    assert key(H.render_review_pages(rows, texts=texts)) == key(want)


def test_languages_are_told_to_the_reviews(spark, ws):
    assert "hashpartitioning" not in plan(catalog.q_review_languages(spark, ws.sf_dir))


def test_grid_lays_pairs_and_cells_out_by_item(spark):
    pairs = spark.createDataFrame([("b", 1, 2, "r1"), ("a", 2, 1, "r3"), ("a", 1, 1, "r2"), ("a", 9, 1, "r0"), (None, 1, 1, "r4")],
                                  "name string, vec_id long, w long, first string")
    cells = spark.createDataFrame([("a", 0, 0.5), ("c", 1, 0.1)], "name string, q long, cf double")
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id long, embedding array<float>")
    laid = GR._laid_out(pairs, cells, vectors, 2)
    assert plan(laid).count("Exchange hashpartitioning") == 1
    got = collections.defaultdict(list)
    for r in laid.collect():
        got[r["name"]].append((r["kind"], r["w"], r["q"], r["cf"]))
    assert got == {"a": [(0, None, 0, 0.5), (1, 1, None, None), (1, 1, None, None)], "b": [(1, 2, None, None)], "c": [(0, None, 1, 0.1)]}
