"""Mining properties, token rule, evaluation maths, language detection sanity."""
import pytest
from pyspark.sql import functions as F

from hoprank.fixtures import table, with_text
from hoprank.operators import language as LG
from hoprank.operators import mining as MI
from hoprank.operators import themes as TH
from hoprank.plans import evaluate as EV

SF = "/root/testdata/sf0.001"


def test_frequent_pairs_are_pairs_of_frequent_items(spark, ws):
    for s in (0.1, 0.3, 0.5):
        pairs = MI.frequent_pairs(ws.reviews, s, item="brewery")
        b = MI.baskets(ws.reviews, "brewery")
        freq, n = MI.frequent_items(b, s)
        f = set(r.item for r in freq.collect())
        got = pairs.collect()
        assert all(r.a in f and r.b in f and r.a < r.b and r.users > s * n for r in got)
        # brute force over baskets
        bs = {}
        for r in b.collect():
            bs.setdefault(r.user, set()).add(r.item)
        want = {}
        for items in bs.values():
            its = sorted(i for i in items if i in f)
            for i in range(len(its)):
                for j in range(i + 1, len(its)):
                    want[(its[i], its[j])] = want.get((its[i], its[j]), 0) + 1
        assert {(r.a, r.b): r.users for r in got} == {k: v for k, v in want.items() if v > s * n}
    adj = {r.item: r.partners for r in MI.pair_recommender(MI.frequent_pairs(ws.reviews, 0.3, item="brewery")).collect()}
    assert all(a in adj[b] for a, ps in adj.items() for b in ps)       # symmetric


def test_token_rule(spark):
    df = spark.createDataFrame([("Crème brûlée, it's GREAT beer2 ok a b_c",)], "t string")
    assert df.select(TH.tokens("t")).first()[0] == ["it", "great", "ok"]


def test_top_terms_skip_stop_words(spark, ws):
    texts = table(spark, ws.sf_dir, "documents").selectExpr("doc_id doc_key", "text review_text")
    top = TH.top_terms_by_text(ws.reviews, texts, 5)
    plain = TH.top_terms(with_text(spark, ws.sf_dir, ws.reviews), 5)
    assert sorted(map(tuple, top.collect())) == sorted(map(tuple, plain.collect()))
    sw = set(TH.stop_word_list())
    rows = top.collect()
    assert rows and not any(r.term in sw for r in rows) and max(r.term_rank for r in rows) <= 5


def test_hits_precision_recall(spark):
    recs = spark.createDataFrame([("q1", "a", 1), ("q1", "b", 2), ("q2", "c", 1), ("q2", "d", 25)],
                                 "query_id string, beer string, rank long")
    q = spark.createDataFrame([("q1", "b"), ("q2", "d"), ("q3", "x")], "query_id string, true_name string")
    h = {r.query_id: r.hit for r in EV.hits(recs, q, 20).collect()}
    assert h == {"q1": True, "q2": False, "q3": False}
    s = EV.summarize({"B": EV.hits(recs, q, 20)}).first()
    assert (s.hits, s.misses) == (1, 2)
    assert s.precision == pytest.approx(1 / 20) and s.recall == pytest.approx(1 / 3)


def test_language_detection_agrees_with_labels(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    prof = LG.train_language_profile(docs)
    got = LG.detect_language(docs.select("doc_id", "text", "lang"), prof, text="text")
    acc = got.agg(F.avg((F.col("language") == F.col("lang")).cast("double"))).first()[0]
    assert acc > 0.9
    short = spark.createDataFrame([("ab ",), (None,)], "review_text string")
    assert [r.language for r in LG.detect_language(short, prof).collect()] == [None, None]


def test_quantiles_by_refinement_equal_sorting(spark, monkeypatch):
    import numpy as np
    from hoprank.operators import cf as CF
    monkeypatch.setattr(CF, "FEW", 5)                    # so that rounds are needed
    rng = np.random.default_rng(4)
    columns = {"even": rng.uniform(-5, 5, 700), "wide": 10.0 ** rng.uniform(-30, 30, 300), "few": rng.integers(0, 4, 500).astype(float),
               "one": np.full(40, 2.5), "single": np.array([7.0]), "huge": np.array([-1.7e308, 1.7e308, 0.0, 1.0, 2.0, 3.0, 4.0])}
    for name, x in columns.items():
        df = spark.createDataFrame([(float(v),) for v in x] + [(None,), (float("nan"),)], "v double").repartition(3)
        got = CF.quantiles(df, "v", [0.0, 0.25, 0.5, 0.9, 1.0])
        assert np.allclose(got, np.quantile(x, [0.0, 0.25, 0.5, 0.9, 1.0]), rtol=1e-12), name
    assert CF.quantiles(spark.createDataFrame([], "v double"), "v", [0.5]) == [None]


def test_item_pairs_do_not_depend_on_the_buckets(spark):
    import itertools
    import random
    from hoprank.operators import mining as MI
    rng = random.Random(2)
    rows = [(f"u{u}", f"i{i:02d}", 3.0) for u in range(60) for i in rng.sample(range(25), 9)]
    rows += [(f"u{u}", "i00", 3.0) for u in range(0, 60, 2)] + [("u1", "i02", 1.0)]
    df = spark.createDataFrame(rows, "reviewer string, name string, rating double")
    sets = {}
    for u, i, r in rows:
        if r >= 2.5:
            sets.setdefault(u, set()).add(i)
    count = {}
    for s in sets.values():
        for p in itertools.combinations(sorted(s), 2):
            count[p] = count.get(p, 0) + 1
    want = sorted((a, b, n) for (a, b), n in count.items() if n > 0.15 * len(sets))
    for buckets in (1, 7, MI.BUCKETS):
        assert sorted(tuple(r) for r in MI.frequent_pairs(df, 0.15, buckets=buckets).collect()) == want and want


def test_clustering_takes_equal_rows_once(spark):
    from hoprank.operators import cluster as KC
    rows = [("1", "A", 5.0, "same", 3.0, "x"), ("2", "A", 5.0, "same", 3.0, "y"), ("3", "A", 5.0, "other", 3.0, "x"),
            ("4", "B", 5.0, "same", 3.0, "x"), ("5", "A", None, None, None, "x"), ("6", "A", None, "", None, "x")]
    df = spark.createDataFrame(rows, "id string, name string, abv double, review_text string, average_rating double, subgenre string")
    assert sorted(r["id"] for r in KC.distinct_texts(df).collect()) == ["1", "3", "4", "5"]
