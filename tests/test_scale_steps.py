"""What is moved: the joins of the review table, the cells that meet target users, item profiles."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from hoprank import fixtures
from hoprank.operators import cf as CF
from hoprank.operators.embed import hashed_vectors
from hoprank.operators.knn import item_profiles, pair_profiles

from conftest import SF_SMALL


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_review_table_reads_lineitem_once_for_the_rows(spark):
    """The planted copies come from the joined rows, not from a second pass of the joins (lineitem: rows and counts)."""
    text = plan(fixtures.reviews_raw(spark, SF_SMALL))
    assert text.count("l_shipdate#") and text.count("Relation [l_orderkey") == 2
    assert "Union" not in text


def test_review_table_with_repeated_and_missing_keys(spark, tmp_path):
    """Joins keep the rows of repeated keys and drop null ones, in whatever order they are made."""
    def put(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    put("lineitem", [(50, 1, 3, 1, 12.0, "1995-01-02"), (50, 1, 3, 1, 12.0, "1995-01-02"), (7, 2, None, 1, 5.0, "1995-01-02"),
                     (None, 1, 3, 1, 5.0, "1995-01-02"), (8, None, 3, 2, 5.0, "1995-01-02")],
        "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_shipdate string")
    put("orders", [(50, 1), (50, 2), (7, 1), (None, 1), (8, 1), (8, None)], "o_orderkey long, o_custkey long")
    put("customer", [(1, 0), (2, 0), (2, None), (None, 0)], "c_custkey long, c_nationkey long")
    put("nation", [(0, "A"), (None, "B")], "n_nationkey long, n_name string")
    put("part", [(3, "b", "t", 9), (3, "c", "t", 9)], "p_partkey long, p_brand string, p_type string, p_size int")
    put("documents", [(0, "x"), (1, "y")], "doc_id long, text string")
    put("embeddings", [(0, [1.0])], "vec_id long, embedding array<float>")
    got = sorted((r["id"], r["reviewer"], r["brewery"], r["total_reviews"]) for r in fixtures.reviews_raw(spark, str(tmp_path)).collect())
    pairs = [(u, b) for u in ("user-1", "user-2") for b in "bc"]
    n = 6                                   # four rows of the item, the two of order 50 again
    want = [("50-1-3-1-12" + s, u, b, n) for s in ("", "-dup") for u, b in pairs for _ in range(2)] + [("8-3-2-5", "user-1", b, n) for b in "bc"]
    assert got == sorted(want)


@pytest.mark.parametrize("metric", ["cosine", "jaccard"])
def test_target_similarities_pick_cells_where_they_lie(spark, metric):
    """With target users only the cells of their items are shuffled; the values are those of all users."""
    rows = [(f"u{i % 40}", f"i{(i * 7) % 90}", float(1 + i % 5)) for i in range(600)] + [(None, "i1", 4.0), ("u1", None, 4.0)]
    cells = CF.utility(spark.createDataFrame(rows, "reviewer string, name string, rating double"), "like" if metric == "jaccard" else "midpoint")
    users = spark.createDataFrame([("u1",), ("u2",), (None,)], "reviewer string")
    key = lambda df: {(r.u, r.v): round(r.sim, 9) for r in df.collect()}
    some = CF.user_similarity(cells, metric, users)
    assert "LeftSemi" in plan(some) and key(some) == {k: v for k, v in key(CF.user_similarity(cells, metric)).items() if k[0] in ("u1", "u2")}


def test_pair_profiles_equal_item_profiles(spark):
    """Weighted vectors by key give the mean over the rows; repeated and missing vectors count as rows do."""
    rows = spark.createDataFrame([("a", 1), ("a", 1), ("a", 2), ("b", 3), ("b", 4), ("c", 4), (None, 1), ("d", 9)], "name string, vec_id long")
    vecs = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 2.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, None)], "vec_id long, embedding array<float>")
    attach = lambda df: df.join(F.broadcast(vecs), "vec_id")
    show = lambda df: {r.name: (None if r.profile[0] is None else [round(x, 9) for x in r.profile], r.n_rows) for r in df.collect()}
    got = pair_profiles(rows, attach, dim=2)
    assert show(got) == show(item_profiles(attach(rows), dim=2))
    # one sum per item after the layout by item: no partial sums of vectors are shuffled
    shuffles = pair_profiles(rows, attach, dim=2)._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    assert shuffles == 2


def test_hashed_vectors_sum_by_slot(spark):
    """Sums of a slot instead of one conditional sum per slot and trigram; texts without words have the zero vector."""
    df = spark.createDataFrame([(1, "ab ab cde"), (2, ""), (3, None), (1, "zz"), (None, "q")], "k long, review_text string")
    out = {r.k: np.array(r.embedding) for r in hashed_vectors(df, "k", dim=8).collect()}
    assert set(out) == {1, 2, 3, None} and not out[2].any() and not out[3].any()
    assert abs(np.linalg.norm(out[1]) - 1) < 1e-12 and len(out[1]) == 8
    assert "CASE WHEN (_slot" not in plan(hashed_vectors(df, "k", dim=8))
