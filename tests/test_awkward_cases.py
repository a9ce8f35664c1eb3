"""Cases that small, clean tables don't show: adaptive layouts, long rows, users without predictions, tiny blocks."""
import pytest
from pyspark.sql import functions as F

from hoprank.functions import arrowvec
from hoprank.operators import cf as CF
from hoprank.operators import clean
from hoprank.operators.cluster import TOKEN_PATTERN
from hoprank.plans.recommend import bucket_score, recommend
from hoprank.sources import io as IO
from hoprank.sources import pages as PG


def test_surrogate_key_keeps_all_rows_under_adaptive_coalescing(spark):
    df = spark.range(60_000).withColumn("pad", F.repeat(F.lit("x"), 50)).groupBy("id").agg(F.max("pad").alias("pad"))
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "1m")
    try:
        got = IO.with_surrogate_key(df, "k", start=5).agg(F.count("*"), F.min("k"), F.max("k"), F.countDistinct("k")).first()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    assert tuple(got) == (60_000, 5, 60_004, 60_000)


def test_surrogate_key_follows_a_sorted_table(spark):
    rows = IO.with_surrogate_key(spark.range(500).select(F.format_string("%04d", "id").alias("n")).repartition(7).sort("n"), "k")
    assert all(int(r["n"]) == r["k"] for r in rows.collect())


def test_long_table_row_and_header_names(spark):
    cell = "malt <b>and</b> hops " * 6000
    html = (f"<table><tr><th>Name</th><th class='n'>Count</th></tr><tr><td>{cell}</td><td> 7 </td></tr>"
            "<tr><td>open<td>9<tr><td>short</table>")
    pages = spark.createDataFrame([(1, "u", html), (2, "u", None), (3, "u", "no table")], "page_id long, url string, html string")
    rows = PG.extract_table_rows(pages, {"name": 0, "count": 1}).orderBy("pos").collect()
    assert [(r["count"], len(r["name"]) > 90_000) for r in rows] == [("7", True), ("9", False), (None, False)]
    by_name = PG.extract_table_by_header(pages, {"n": "Count", "x": "Missing"}).orderBy("pos").collect()
    assert [(r["n"], r["x"]) for r in by_name] == [("7", None), ("9", None), (None, None)]


def test_whole_paragraphs(spark):
    html = ('<html lang="en"><title>T</title><body><p>Good <b>malt</b> and hops <a href="z">here</a> end</p>'
            "<p class=x>open<p></p><p>last</div>tail</body>")
    got = PG.page_paragraphs(spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string"))
    assert [r["text"] for r in got.orderBy("pos").collect()] == ["Good  malt  and hops  here  end", "open", "T", "last"]


def test_review_records_with_constants(spark):
    html = ("<h1>Beer</h1><div class=r><i>ann</i><s>4.5</s><p>fine <b>one</b></p></div><div class=r><i>bob</i><p></p></div>")
    got = PG.extract_records(spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string"),
                             r"<div class=r>", r"(?s)</div.*$",
                             {"reviewer": (r"<i>([^<]*)", 1), "rating": (r"<s>([^<]*)", 1), "text": (r"(?s)<p>(.*)</p>", 1)},
                             {"name": (r"<h1>([^<]*)", 1)})
    assert [tuple(r) for r in got.select("name", "reviewer", "rating", "text").orderBy("pos").collect()] == [
        ("Beer", "ann", "4.5", "fine  one"), ("Beer", "bob", None, None)]


def test_fixed_number_of_pages(spark):
    df = spark.createDataFrame([("a",), ("b",)], "name string")
    assert sorted((r[0], r[1]) for r in PG.first_pages(df, 2).collect()) == [("a", 1), ("a", 2), ("b", 1), ("b", 2)]
    assert PG.first_pages(df, 0).count() == 0


@pytest.fixture(scope="module")
def small_cells(spark):
    rows = [("u", "a", 5.0), ("u", "b", 1.0), ("v", "b", 4.0), ("v", "c", 2.0), ("flat", "a", 3.0)]
    return CF.utility(spark.createDataFrame(rows, "reviewer string, name string, rating double"), "midpoint")


def test_zero_share_lists_users_without_predictions(spark, small_cells):
    users = spark.createDataFrame([("u",), ("flat",), ("unknown",)], "reviewer string")
    pred = CF.predict(small_cells, CF.user_similarity(small_cells, "cosine", users))
    got = {r["reviewer"]: r["zero_pct"] for r in CF.zero_share(small_cells, pred, users).collect()}
    assert got["flat"] == 100.0 and "unknown" not in got and got["u"] < 100.0


def test_mean_added_gives_every_asked_cell(spark):
    rows = [("u", "a", 5.0), ("u", "b", 1.0), ("v", "b", 4.0), ("w", "c", 2.0)]
    cells = CF.utility(spark.createDataFrame(rows, "reviewer string, name string, rating double"), "raw")
    users = spark.createDataFrame([("u",), ("v",)], "reviewer string")
    sim = CF.user_similarity(cells, "cosine", users)
    asked = spark.createDataFrame([(u, i) for u in "uv" for i in "abc"], "reviewer string, name string")
    full = {(r["reviewer"], r["name"]): r["pred"] for r in CF.predict(cells, sim, asked, mode="mean_added").collect()}
    assert len(full) == 6
    sparse = {(r["reviewer"], r["name"]): r["pred"] for r in CF.predict(cells, sim, mode="mean_added").collect()}
    for (u, i), p in full.items():
        assert p == pytest.approx(sparse.get((u, i), sparse[(u, None)]))


def test_cf_ranking_fills_with_unpredicted_names(spark):
    rows = [("u", f"i{k:02d}", 1.0 if k < 20 else 5.0) for k in range(21)] + [("v", f"j{k:02d}", 4.0) for k in range(30)]
    train = spark.createDataFrame(rows, "reviewer string, name string, rating double")
    got = CF.recommend_cf(train, spark.createDataFrame([("u",)], "reviewer string"), n=8).orderBy("rank").collect()
    assert [r["name"] for r in got] == ["i20"] + [f"j{k:02d}" for k in range(7)]
    every = CF.recommend_cf(train, spark.createDataFrame([("u",)], "reviewer string"), n=None).orderBy("rank").collect()
    assert [r["rank"] for r in every] == list(range(1, 52)) and every[-1]["collab_score"] < 0


@pytest.mark.parametrize("plan, vectors", [("lsh_cf", 50), ("lsh_kmeans_cf", 250), ("bucket", 50)])
def test_blocks_of_queries_give_the_rows_of_one_block(spark, ws, monkeypatch, plan, vectors):
    model, queries = ws.model(), ws.queries(True)

    def rows():
        out = bucket_score(model, queries, n=5) if plan == "bucket" else recommend(model, queries, plan, n=5, iters=10)
        return sorted((r["query_id"], r["rank"], r["beer"], round(r["score"], 9)) for r in out.collect())
    one = rows()
    monkeypatch.setattr(arrowvec, "MAX_BLOCK_BYTES", 64 * 8 * vectors)
    assert rows() == one and one


def test_tokens_are_unicode_words(spark):
    got = spark.sql("SELECT 1").select(F.regexp_extract_all(F.lit("crème brûlée señor über gut"), F.lit(TOKEN_PATTERN), 0)).first()[0]
    assert got == ["crème", "brûlée", "señor", "über", "gut"]


def test_dedupe_on_whole_texts(spark):
    long = "x" * 5000
    df = spark.createDataFrame([("2", "a", "r", long + "1"), ("1", "a", "r", long + "2"), ("3", "a", "r", long + "1"), ("4", "a", "r", None),
                                ("5", "a", "r", None)], "id string, name string, reviewer string, review_text string")
    assert sorted(r["id"] for r in clean.dedupe_first(df).collect()) == ["1", "2", "4"]
