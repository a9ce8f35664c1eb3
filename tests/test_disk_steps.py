"""What lies on disk: rows without copies stay where they are, vectors and texts are not written once per row."""

import glob
import os
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from hoprank.operators import clean
from hoprank.operators import cluster as K
from hoprank.operators import themes as TH
from hoprank.operators.lsh import build_index, make_hyperplanes
from hoprank.sources import html as H
from hoprank.streaming import streams as ST


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows_of(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


@pytest.fixture(scope="module")
def reviews(spark):
    rows = [(f"{i:04d}", f"item-{i % 50}", f"user-{i % 70}", f"h{i % 9}", str(i % 5), "4.0%") for i in range(3000)]
    rows += [("9998", None, "u", "h", "1", "1%"), ("9999", None, "u", "h", "2", "1%"), ("x", "n", None, None, "3", "-"), ("x", "lone", "u", "h", "3", None)]
    return spark.createDataFrame(rows, "id string, name string, reviewer string, text_hash string, rating string, abv string").repartition(3)


def test_rows_without_copies_are_not_moved(spark, reviews, monkeypatch):
    want = rows_of(clean.dedupe_first(reviews))
    apart = clean.dedupe_first(reviews, apart=True)
    assert rows_of(apart) == want and apart.columns == reviews.columns
    alone, copies = clean.split_copies(reviews, list(clean.DEDUPE_KEYS))
    assert "left_anti" in plan(alone).lower().replace("leftanti", "left_anti") and 0 < alone.filter("name = 'lone'").count()
    assert rows_of(alone.unionByName(copies)) == rows_of(reviews)
    monkeypatch.setattr(clean, "SHARED_KEYS", 0)
    assert rows_of(clean.dedupe_first(reviews, apart=True)) == want
    assert rows_of(clean.preprocess(reviews, apart=True)) == rows_of(clean.preprocess(reviews))


def test_shuffled_bytes_of_few_copies_are_hashes(spark):
    """Rows of 500 bytes, few copies: what is moved is less than a tenth of the rows."""
    df = spark.range(20_000).select(F.format_string("%06d", "id").alias("id"), F.concat(F.lit("n"), F.col("id") % 19_900).alias("name"),
                                    F.sha2(F.col("id").cast("string"), 512).alias("pad"))
    out = clean.dedupe_first(df, keys=("name",), apart=True)
    copies = clean.split_copies(df, ["name"])[1]
    assert out.count() == 19_900 and copies.count() == 200


def test_index_stream_over_named_vectors(spark):
    """The stream's rows name their vectors; the index is that of rows with vectors, and no vector is written."""
    d = tempfile.mkdtemp(prefix="hoprank-test-", dir="/tmp")
    rng = np.random.default_rng(3)
    vectors = spark.createDataFrame([(i, rng.normal(size=4).astype(np.float32).tolist()) for i in range(9)] + [(3, [1.0, 0.0, 0.0, 0.0])],
                                    "vec_id long, embedding array<float>")
    rows = spark.createDataFrame([(f"r{i}", i % 11, str(2000 + i % 3)) for i in range(60)] + [("n", None, "2000")], "id string, vec_id long, year string")
    planes = make_hyperplanes(4, 3, 2, 7)
    rows.write.partitionBy("year").parquet(f"{d}/in")
    schema = spark.read.parquet(f"{d}/in").schema
    ST.stream_index(spark, f"{d}/in", f"{d}/out", schema, planes, name=os.path.basename(d), vectors=vectors).awaitTermination()
    want = build_index(rows.join(vectors, "vec_id"), planes).select("table_id", "bucket", "id")
    assert rows_of(ST.read_index(spark, f"{d}/out")) == rows_of(want)


def test_stream_keys_of_one_batch_are_not_moved(spark, reviews):
    d = tempfile.mkdtemp(prefix="hoprank-test-", dir="/tmp")
    run = ST._write_batch(d)
    run(ST.first_copies(reviews.filter("rating < 3")), 0)
    run(ST.first_copies(reviews), 1)
    assert rows_of(ST.deduped(spark, d)) == rows_of(clean.preprocess(reviews))
    assert rows_of(ST.seen_keys(spark, d)) == rows_of(reviews.select(*clean.DEDUPE_KEYS).distinct())
    assert glob.glob(f"{d}/batch=0/*.zstd.parquet") and "BroadcastHashJoin" in plan(ST.seen_keys(spark, d))


def test_clusters_move_each_text_vector_once(spark, monkeypatch):
    texts = spark.createDataFrame([(i, f"{'aa bb' if i % 2 else 'cc dd'} word{i}") for i in range(6)], "doc_key long, review_text string")
    rows = spark.createDataFrame([(f"r{i:02d}", f"item{i % 5}", 5.0, "s", 3.0, i % 6) for i in range(60)],
                                 "id string, name string, abv double, subgenre string, average_rating double, doc_key long")
    got = K.cluster_reviews(rows, texts, k=2, max_features=20)[0]
    monkeypatch.setattr(K, "SIDE_BYTES", 0)
    moved, model = K.cluster_reviews(rows, texts, k=2, max_features=20)
    # the vectors are moved by text; nothing is moved by id with a vector, and the laid-out rows are not moved again
    assert plan(moved).count("Exchange hashpartitioning(") == 1 and "Exchange hashpartitioning(_text" in plan(moved)
    def groups(df):
        by = {}
        for r in df.collect():
            by.setdefault(r["cluster"], set()).add(r["id"])
        return sorted(map(sorted, by.values()))
    assert groups(moved) == groups(got) and len(groups(got)) == 2


def test_many_texts_are_moved_compressed(spark, monkeypatch):
    """Texts that are too many for a task go to the pages compressed, in as many tasks as can sort them."""
    texts = spark.createDataFrame([(1, 'one & <b> "x" ' * 300), (2, None), (3, "three\n"), (3, "again")], "doc_key long, review_text string")
    rows = spark.createDataFrame([(f"{i:03d}", f"item {i % 3}", f"u{i}" if i % 7 else None, "DK", "4.0", "2020-01-01", 1 + i % 4, 250) for i in range(200)],
                                 "id string, name string, reviewer string, location string, rating string, review_date string, doc_key long, total_reviews long")
    want = H.render_review_pages(rows, texts=texts)
    monkeypatch.setattr(H, "SIDE_BYTES", 0)
    monkeypatch.setattr(H, "SORT_BYTES", 100)
    pages = H.render_review_pages(rows, texts=texts)
    moved = plan(pages)
    moved = moved[moved.index("Exchange hashpartitioning(name"):]
    assert "review_text" not in moved and int(moved.split("page#")[1].split("), REPARTITION")[0].split(", ")[-1]) > 8
    records = lambda p: rows_of(H.review_records(p).drop("page", "pos"))
    assert records(pages) == records(want) and len(records(pages)) > 100


def test_counts_of_many_texts_are_moved_once_per_pair(spark, monkeypatch):
    """A hot item, missing items and texts, ties: the counts of a text are one value, no row per item and term is shuffled."""
    texts = spark.createDataFrame([(i, " ".join(f"w{chr(97 + (i * k) % 26)}x" for k in range(12))) for i in range(40)] + [(99, "unused"), (7, "wax wax"), (8, None)],
                                  "doc_key long, review_text string")
    rows = spark.createDataFrame([(f"x{i % 9}" if i % 3 else "hot", i % 43) for i in range(400)] + [(None, 1), ("none", None)], "name string, doc_key long")
    want = rows_of(TH.top_terms_by_text(rows, texts, 5))
    monkeypatch.setattr(TH, "COUNT_BYTES", 0)
    monkeypatch.setattr(TH, "OUT_ROWS", 3)
    monkeypatch.setattr(TH, "SORT_BYTES", 50)
    top = TH.top_terms_by_text(rows, texts, 5)
    assert rows_of(top) == want and len(want) == 40
    assert "Window" not in plan(top) and "hashpartitioning(name#" in plan(top) and "term#" not in plan(top).split("MapInArrow")[1].split("\n", 1)[1]
