"""Registered queries (Spark) and their DuckDB statements.

Every query reads the driver tables of ``sf_dir`` in full; limits appear only
where ranking is the feature (top 20 per query, the 100-row reviewer sample).
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, StructType

from ..functions import scoring as SC
from ..functions.arrowvec import query_blocks
from ..operators import cf as CF
from ..operators import clean, split
from ..operators import lsh as LSH
from . import oracle_sql as O
from ..fixtures import REVIEWS_RAW_SQL, reviews_raw
from ..operators import mining as MI
from ..operators import themes as TH
from . import evaluate as EV
from . import grid as GR
from ..operators import cluster as KC
from ..operators import embed as EB
from ..operators import kmeans as KM
from ..operators.knn import knn_exact
from ..sources import html as HT
from ..sources import io as IO
from ..sources import pages as PG
from ..operators import language as LG
from ..session import CODEC, table_path, write_once
from ..streaming import streams as ST
import os
from pyspark.sql import Window
from .recommend import FIXED_SEED, MAX_HITS, bucket_score, meet, recommend, weighted_points
from .sizing import broadcast_if_small
from .workspace import SEED, Workspace

QueryFn = Callable[[SparkSession, str], DataFrame]


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column (engines differ in the last bits of sums)."""
    return df.select(*[F.round(F.col(f.name), digits).alias(f.name) if isinstance(f.dataType, (DoubleType, FloatType))
                       else F.col(f.name) for f in df.schema.fields])


# ---------------------------------------------------------------- cleaning / split

def q_stage_counts(spark, sf_dir):
    return clean.stage_counts(_raw(spark, sf_dir))


def q_item_info(spark, sf_dir):
    return rounded(Workspace.load(spark, sf_dir).items)


def q_split_summary(spark, sf_dir):
    ws = Workspace.load(spark, sf_dir)
    return split.split_summary(ws.reviews, ws.train, ws.test, 100)


def q_test_rows(spark, sf_dir):
    ws = Workspace.load(spark, sf_dir)
    return rounded(ws.test.select("id", "reviewer", "name", "rating", "abv", "subgenre"))


# ---------------------------------------------------------------- collaborative filtering

def _cf(ws: Workspace):
    cells = write_once(CF.utility(ws.train, "midpoint"), "cells")
    users = ws.test.select("reviewer").distinct()
    return cells, users


def q_user_similarity(spark, sf_dir):
    ws = Workspace.load(spark, sf_dir)
    cells, users = _cf(ws)
    return rounded(CF.user_similarity(cells, "cosine", users))


def q_cf_predictions(spark, sf_dir):
    ws = Workspace.load(spark, sf_dir)
    cells, users = _cf(ws)
    return rounded(CF.predict(cells, write_once(CF.user_similarity(cells, "cosine", users), "sim")))


def q_user_betas(spark, sf_dir):
    ws = Workspace.load(spark, sf_dir)
    cells, users = _cf(ws)
    return rounded(CF.user_betas(cells.join(users, "reviewer", "left_semi")))


# ---------------------------------------------------------------- recommendation set-ups

def _plan(plan: str, with_info: bool = False, n: int = 20, beta: str = "log", store: bool = False) -> QueryFn:
    def run(spark, sf_dir):
        ws = Workspace.load(spark, sf_dir)
        model = ws.model(store=store)
        out = recommend(model, ws.queries(with_info), plan, n=n, beta=beta)
        return rounded(out)
    run.__name__ = f"q_recommend_{plan}"
    return run


def q_lsh_candidate_stats(spark, sf_dir):
    ws = Workspace.load(spark, sf_dir)
    model = ws.model(store=True)
    found = write_once(model.store.candidates(ws.queries()), "candidates")         # vectors; the reviews name them
    return LSH.bucket_stats(broadcast_if_small(found, "candidates", MAX_HITS), ws.train.select(F.col("vec_id").alias("id"), "name"))


def q_bucket_score(spark, sf_dir):
    ws = Workspace.load(spark, sf_dir)
    return rounded(bucket_score(ws.model(store=True), ws.queries(True), n=20))


def q_cf_neighbours(spark, sf_dir):
    ws = Workspace.load(spark, sf_dir)
    cells, users = _cf(ws)
    return rounded(CF.neighbours(CF.user_similarity(cells, "cosine", users), 5))


def q_cf_jaccard_neighbours(spark, sf_dir):
    ws = Workspace.load(spark, sf_dir)
    cells = write_once(CF.utility(ws.train, "like"), "cells")
    users = ws.test.select("reviewer").distinct()
    return rounded(CF.neighbours(CF.user_similarity(cells, "jaccard", users), 5))


MINING_SUPPORT = 0.3


def q_frequent_pairs(spark, sf_dir):
    ws = Workspace.load(spark, sf_dir)
    return MI.frequent_pairs(ws.reviews, MINING_SUPPORT, item="brewery", user="reviewer", min_rating=2.5)


ITEM_SUPPORT = 0.0012


def q_item_pairs(spark, sf_dir):
    """M3 over all items, at a support that leaves far more pairs to count than to return."""
    ws = Workspace.load(spark, sf_dir)
    return MI.frequent_pairs(ws.reviews, ITEM_SUPPORT, item="name", user="reviewer", min_rating=2.5)


def q_pair_recommender(spark, sf_dir):
    ws = Workspace.load(spark, sf_dir)
    return MI.pair_recommender(MI.frequent_pairs(ws.reviews, MINING_SUPPORT, item="brewery"))


def q_pair_lookup(spark, sf_dir):
    """M5: partners of the breweries of the held-out reviews."""
    ws = Workspace.load(spark, sf_dir)
    adj = MI.pair_recommender(MI.frequent_pairs(ws.reviews, MINING_SUPPORT, item="brewery"))
    return MI.recommend_pairs(adj, ws.test.select(F.col("brewery").alias("item")))


def q_item_top_terms(spark, sf_dir):
    ws = Workspace.load(spark, sf_dir)
    return TH.top_terms_by_text(ws.reviews, _texts(spark, sf_dir), 100).withColumn("term_rank", F.col("term_rank").cast("long"))


def _texts(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc_key"), F.col("text").alias("review_text"))


def _with_text(spark, sf_dir, df):
    from ..fixtures import with_text
    return with_text(spark, sf_dir, df)


def q_recommend_notes(spark, sf_dir):
    ws = Workspace.load(spark, sf_dir)
    model = ws.model()
    q = ws.queries(True)
    recs = recommend(model, q, "fixed_weights", n=10)
    return rounded(TH.with_notes(recs, ws.train.select("name", "doc_key"), q, attach=lambda df: _with_text(spark, sf_dir, df)))


def q_evaluation_summary(spark, sf_dir):
    ws = Workspace.load(spark, sf_dir)
    return rounded(EV.evaluate(ws.model(), {False: ws.queries(False), True: ws.queries(True)}))


def q_cf_user_mean(spark, sf_dir):
    """F3 + F10: mean-centred cells, plain prediction."""
    ws = Workspace.load(spark, sf_dir)
    cells = write_once(CF.utility(ws.train, "user_mean"), "cells")
    users = ws.test.select("reviewer").distinct()
    return rounded(CF.predict(cells, write_once(CF.user_similarity(cells, "cosine", users), "sim")))


def q_cf_mean_added(spark, sf_dir):
    """similarity on raw ratings; user mean plus weighted neighbour deviations."""
    ws = Workspace.load(spark, sf_dir)
    cells = write_once(CF.utility(ws.train, "raw"), "cells")
    users = ws.test.select("reviewer").distinct()
    return rounded(CF.predict(cells, write_once(CF.user_similarity(cells, "cosine", users), "sim"), mode="mean_added"))


def q_cf_zero_share(spark, sf_dir):
    """F16: share of items with prediction exactly 0 per target user, and the linear beta."""
    ws = Workspace.load(spark, sf_dir)
    cells, users = _cf(ws)
    return rounded(CF.zero_share(cells, CF.predict(cells, write_once(CF.user_similarity(cells, "cosine", users), "sim")), users))


def q_rating_describe(spark, sf_dir):
    """F17 over the cleaned ratings."""
    return rounded(CF.describe(Workspace.load(spark, sf_dir).reviews, "rating"))


def q_value_counts(spark, sf_dir):
    """reviews per subgenre."""
    return CF.value_counts(Workspace.load(spark, sf_dir).reviews, "subgenre")


def q_lsh_quality(spark, sf_dir):
    """Mean recall / precision of the LSH candidates against the exact 10 nearest rows."""
    ws = Workspace.load(spark, sf_dir)
    model = ws.model()
    q = ws.queries()
    cands = LSH.query_index(model.index, q, model.planes)
    truth = knn_exact(ws.train.select("id", "embedding"), q, 10).select("query_id", "id")
    return rounded(LSH.evaluate_lsh(cands, truth))


def q_evaluation_bcdf(spark, sf_dir):
    """E1-E4 for the set-ups with a SQL statement (B, C, D, F)."""
    ws = Workspace.load(spark, sf_dir)
    out = EV.evaluate(ws.model(), {False: ws.queries(False), True: ws.queries(True)}, experiments=("B", "C", "D", "F"))
    return rounded(out)


def q_lsh_grid_search(spark, sf_dir):
    ws = Workspace.load(spark, sf_dir)
    return rounded(GR.grid_search(ws.model(), ws.queries(True)))


def _clustered(ws: Workspace):
    rows = ws.train.select("id", "name", "abv", "subgenre", "average_rating", "doc_key")
    return KC.cluster_reviews(rows, _texts(ws.spark, ws.sf_dir), k=25, max_features=300, seed=42)


def q_cluster_distribution(spark, sf_dir):
    ws = Workspace.load(spark, sf_dir)
    cl, _ = _clustered(ws)
    return KC.cluster_distribution(cl)


def q_cluster_top_items(spark, sf_dir):
    """Clusters predicted for the held-out reviews, then each cluster's best items."""
    ws = Workspace.load(spark, sf_dir)
    cl, model = _clustered(ws)
    pred = KC.predict_cluster(model, _with_text(spark, sf_dir, ws.test).select("id", "abv", "review_text"))
    return rounded(KC.top_items_per_cluster(KC.clusters_by_item(cl), ws.items, pred, 10))


def _document_vectors(spark, sf_dir):
    return EB.hashed_vectors(_texts(spark, sf_dir), "doc_key")


def q_embed_reviews(spark, sf_dir):
    """V1-V3: the vectors of all documents (the texts of the reviews), by slot."""
    return rounded(_document_vectors(spark, sf_dir).select("doc_key", F.posexplode("embedding").alias("slot", "value")).filter("value <> 0"))


def q_embed_by_item(spark, sf_dir):
    """V4: the mean vector of each item's reviews, by slot."""
    ws = Workspace.load(spark, sf_dir)
    items = EB.pooled_by_item(_document_vectors(spark, sf_dir), ws.reviews, "doc_key")
    return rounded(items.select("name", F.posexplode("embedding").alias("slot", "value")))


def q_bucket_projection(spark, sf_dir):
    """2-d points of every query's candidate bucket, each on its own axes, with their k-means labels."""
    ws = Workspace.load(spark, sf_dir)
    model = ws.model()
    q = ws.queries()
    labels = None
    for block in query_blocks(q.select("query_id", "embedding"), per_query=5):
        points = weighted_points(model, block, SEED).select("query_id", "id", "w", "h", "embedding")
        part = KM.keyed_kmeans(points, 5, seed=SEED, weight="w", order="h").labels(points).drop("embedding", "h")
        labels = part if labels is None else labels.union(part)
    points = write_once(labels, "labels").join(model.vectors, "id")
    xy = write_once(KC.project_buckets(points, q, "embedding", 2, weight="w").drop("w"), "xy")
    return rounded(meet(model.rows, xy).select("id", "query_id", "cluster", "xy"))


def q_latent_topn(spark, sf_dir):
    """Item vectors (mean of review vectors) in a 10-d latent space; 5 nearest per held-out review."""
    ws = Workspace.load(spark, sf_dir)
    prof = ws.profiles().select("name", F.col("profile").alias("embedding"))
    return rounded(KC.latent_topn(prof, ws.queries(), dims=10, n=5))


# ---------------------------------------------------------------- pages and crawl plans

def _table(spark, sf_dir, name):
    from ..fixtures import table
    return table(spark, sf_dir, name)


def q_page_links(spark, sf_dir):
    return PG.page_links(_table(spark, sf_dir, "pages"))


def q_page_taxonomy(spark, sf_dir):
    return PG.extract_taxonomy(_table(spark, sf_dir, "pages"))


def q_page_paragraphs(spark, sf_dir):
    return PG.page_paragraphs(_table(spark, sf_dir, "pages"))


RECORD, RECORD_END = r"<li>", r"(?s)</li.*$"
RECORD_LINK, RECORD_NAME = r'href="([^"]*)"', r"(?s)<a[^>]*>(.*)$"


def q_page_records(spark, sf_dir):
    """The list entries of every page as records, with the page's title as a constant."""
    return PG.extract_records(_table(spark, sf_dir, "pages"), RECORD, RECORD_END,
                              {"link": (RECORD_LINK, 1), "name": (RECORD_NAME, 1)}, {"title": (PG.TITLE, 1)}, keep=("page_id",))


def q_review_records(spark, sf_dir):
    """The reviews as pages of their items, and the records read back from the pages by structure."""
    pages = HT.render_review_pages(_raw(spark, sf_dir), texts=_texts(spark, sf_dir))
    return HT.review_records(pages).select("name", "reviewer", "location", "rating", "date", F.md5("text").alias("text_md5"))


def q_first_pages(spark, sf_dir):
    """P5: the first three review pages of every item with enough reviews."""
    items = Workspace.load(spark, sf_dir).reviews.groupBy("name").agg(F.max("total_reviews").alias("count"))
    return PG.first_pages(PG.filter_popular(items, "count"), 3)


RESUME_COUNTRY, RESUME_STYLE = "NATION_6", "PROMO"


def _menus(spark, sf_dir):
    countries = _table(spark, sf_dir, "nation").select(
        F.lit("country").alias("menu"), F.col("n_nationkey").cast("int").alias("pos"),
        F.lower("n_name").alias("name"), F.col("n_name").alias("text"))
    types = _table(spark, sf_dir, "part").select(F.col("p_type").alias("text")).distinct()
    styles = types.select(F.lit("style").alias("menu"),
                          F.dense_rank().over(Window.orderBy("text")).cast("int").alias("pos"),
                          F.lower(F.regexp_replace("text", " ", "-")).alias("name"), "text")
    return PG.clean_options(styles), PG.clean_options(countries)


def q_crawl_frontier(spark, sf_dir):
    styles, countries = _menus(spark, sf_dir)
    frontier = PG.crawl_frontier(styles, countries)
    return PG.resume_frontier(frontier, RESUME_COUNTRY, RESUME_STYLE)


def q_review_page_plan(spark, sf_dir):
    ws = Workspace.load(spark, sf_dir)
    items = ws.reviews.groupBy("name").agg(F.max("total_reviews").alias("count"))
    return PG.page_plan(PG.filter_popular(items, "count"), "count")


def q_location_split(spark, sf_dir):
    ws = Workspace.load(spark, sf_dir)
    short, rest = PG.split_location("location")
    return ws.reviews.select("id", "location", short.alias("location_short"), rest.alias("location_rest"))


# ---------------------------------------------------------------- language

def q_language_profile(spark, sf_dir):
    return rounded(LG.train_language_profile(_table(spark, sf_dir, "documents")))


def q_review_languages(spark, sf_dir):
    """C11: language of every cleaned review (profile trained on the documents table); English kept."""
    ws = Workspace.load(spark, sf_dir)
    prof = LG.train_language_profile(_table(spark, sf_dir, "documents"))
    # a document is judged once, whatever the number of its reviews
    used = _texts(spark, sf_dir).join(broadcast_if_small(write_once(ws.reviews.select("doc_key").distinct(), "keys"), "keys"), "doc_key", "left_semi")
    told = write_once(LG.keep_language(LG.detect_language(used, prof)).select("doc_key", "language"), "told")
    return ws.reviews.select("id", "doc_key").join(broadcast_if_small(told, "languages"), "doc_key").select("id", "language")


# ---------------------------------------------------------------- streams

def _stream_input(spark, sf_dir) -> tuple[str, object]:
    """Raw reviews written once as files, one folder per review year (the stream's input)."""
    import hashlib
    base = table_path(spark, "stream-in-" + hashlib.md5(f"{spark.sparkContext.applicationId}|{sf_dir}".encode()).hexdigest()[:12])
    raw = _raw(spark, sf_dir).withColumn("year", F.substring("review_date", 1, 4))
    if not _path_exists(spark, base):
        raw.write.mode("overwrite").option("compression", CODEC).partitionBy("year").parquet(base)
    return base, spark.read.parquet(base).schema


def _path_exists(spark, path):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def _fresh(spark, name):
    import uuid
    return table_path(spark, f"{name}-{uuid.uuid4().hex[:10]}")


def q_stream_clean(spark, sf_dir):
    """The cleaning stream over the raw review files (availableNow) - equals batch C2/C3."""
    src, schema = _stream_input(spark, sf_dir)
    out = _fresh(spark, "stream-clean")
    ST.stream_reviews(spark, src, out, schema, name=os.path.basename(out)).awaitTermination()
    return rounded(spark.read.parquet(out).drop("year"))


def _dedupe_stream(spark, sf_dir) -> str:
    src, schema = _stream_input(spark, sf_dir)
    out = _fresh(spark, "stream-dedupe")
    ST.stream_dedupe(spark, src, out, schema, name=os.path.basename(out)).awaitTermination()
    return out


def q_stream_dedupe(spark, sf_dir):
    """R2 exact: the smallest copy of each key from keyed state over micro-batches, then C2/C3; equals the batch clean-up."""
    return rounded(ST.deduped(spark, _dedupe_stream(spark, sf_dir)).drop("year"))


def q_stream_dedupe_keys(spark, sf_dir):
    """R2: the keys that the stream has taken in, each once."""
    return ST.seen_keys(spark, _dedupe_stream(spark, sf_dir)).withColumn("rows", F.lit(1).cast("long"))


def q_stream_index(spark, sf_dir):
    """Index extended batch by batch; equals the batch-built index of the same rows.  The rows name their vectors."""
    ws = Workspace.load(spark, sf_dir)
    src = _fresh(spark, "stream-rows")
    (ws.plain.select("id", "vec_id", F.substring("review_date", 1, 4).alias("year"))
     .write.option("compression", CODEC).partitionBy("year").parquet(src))
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    schema = spark.read.parquet(src).schema
    out = _fresh(spark, "stream-index")
    ST.stream_index(spark, src, out, schema, ws.model().planes, name=os.path.basename(out), vectors=vectors).awaitTermination()
    return ST.read_index(spark, out)


# ---------------------------------------------------------------- sources, keys and defaults

def _raw(spark, sf_dir):
    """The review table before cleaning; queries that read nothing else don't build the shared tables."""
    return reviews_raw(spark, sf_dir)


def q_csv_roundtrip(spark, sf_dir):
    """The raw reviews written as CSV with a header and read with the fixed schema."""
    path = _fresh(spark, "reviews-csv")
    cols = [f.name for f in IO.REVIEWS_RAW.fields]
    IO.write_reviews_csv(_with_text(spark, sf_dir, _raw(spark, sf_dir)).select(*cols), path)
    back = IO.read_reviews(spark, path, "csv")
    return rounded(back.groupBy("location", "rating").agg(
        F.count(F.lit(1)).alias("reviews"), F.sum(F.round(F.col("average_rating") * 10).cast("long")).alias("tenths"),
        F.min("id").alias("first_id"), F.sum(F.length("review_text")).cast("long").alias("chars"), F.max(F.md5("review_text")).alias("last_text")))


def q_append_labels(spark, sf_dir):
    """Batches appended to a declared table with labels; counts per label."""
    ws, name = Workspace.load(spark, sf_dir), "appended_" + os.path.basename(_fresh(spark, "t")).replace("-", "_")
    schema = StructType([f for f in IO.REVIEWS_RAW.fields if f.name in ("id", "name", "subgenre", "location")])
    IO.ensure_table(spark, name, schema, path=_fresh(spark, "appended"), batches=True)
    for place in ("Here", "There", "There"):         # the last batch comes twice and counts once
        IO.append_reviews(ws.items.select(F.col("name").alias("beer"), "subgenre"), name,
                          {"beer": "name", "subgenre": "subgenre"}, batch_id=place, location=place)
    return spark.table(name).groupBy("location", "subgenre").agg(F.count(F.lit(1)).alias("items"), F.count("id").alias("ids"))


def q_item_keys(spark, sf_dir):
    """Dense numbers of the items in the order of their names."""
    return IO.with_surrogate_key(Workspace.load(spark, sf_dir).items.select("name").sort("name"), "item_id")


def q_content_keys(spark, sf_dir):
    """S8, by content."""
    return IO.content_key(Workspace.load(spark, sf_dir).items.select("name", "subgenre"), ["name", "subgenre"])


def q_embeddings_roundtrip(spark, sf_dir):
    """Vectors written and read back, as their length and sum."""
    path = _fresh(spark, "vectors")
    IO.write_embeddings(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), path)
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return spark.read.parquet(path).select("vec_id", F.size("embedding").cast("long").alias("width"), F.round(total, 4).alias("total"))


def q_strict_abv(spark, sf_dir):
    """Strict percent numbers ('-' is missing), then the default 0."""
    rows = _raw(spark, sf_dir).select("id", clean.percent_number("abv", strict=True).alias("abv"))
    return rounded(clean.fill_defaults(rows, text_cols=()))


def q_distinct_reviews(spark, sf_dir):
    """C7."""
    return clean.distinct_on(_raw(spark, sf_dir), ["name", "reviewer", "rating", "location"])


def q_count_location(spark, sf_dir):
    """The reviews of one nation."""
    return clean.count_equal(_raw(spark, sf_dir), "location", RESUME_COUNTRY)


def q_rating_defaults(spark, sf_dir):
    """A missing value gets the default."""
    missing = F.nullif(F.col("rating"), F.lit("Unknown"))
    return _raw(spark, sf_dir).select("id", PG.coalesce_default(missing, "n/a").alias("rating"))


# ---------------------------------------------------------------- further forms of scores and features

def q_zscore_cells(spark, sf_dir):
    """cells standardised per user."""
    return rounded(CF.utility(Workspace.load(spark, sf_dir).train, "zscore"))


def q_like_similarity(spark, sf_dir):
    """F8: cosine of the binary cells."""
    ws = Workspace.load(spark, sf_dir)
    return rounded(CF.user_similarity(write_once(CF.utility(ws.train, "like"), "cells"), "cosine", ws.test.select("reviewer").distinct()))


PENALTIES = ("scaled_square", "square", "linear", "log", "log_scaled", "linear_scaled")
WISH = 5.0


def q_abv_penalties(spark, sf_dir):
    """H1-H3: every penalty shape for a wish, and the penalty of a wish for none."""
    items = Workspace.load(spark, sf_dir).items
    return rounded(items.select("name", *[SC.abv_penalty("abv", WISH, kind).alias(kind) for kind in PENALTIES],
                                SC.abv_penalty("abv", 0.0, zero_is_wish=True).alias("zero_wish")))


def q_plain_sum(spark, sf_dir):
    """H7: text and CF scores with weights 1 and 1."""
    ws = Workspace.load(spark, sf_dir)
    return rounded(recommend(ws.model(), ws.queries(True), "lsh_cf", n=20, beta="sum").select("query_id", "beer", "score", "rank"))


def q_abv_scaled(spark, sf_dir):
    """K5: abv of the items, standardised with the population deviation."""
    items = Workspace.load(spark, sf_dir).items.select("name", "abv")
    return rounded(KC.fit_standardizer(items).transform(items))


def q_tfidf_terms(spark, sf_dir):
    """K4: the terms of the vocabulary (most frequent in the documents), their counts and idf."""
    return rounded(KC.tfidf_terms(_texts(spark, sf_dir), max_features=100))


def queries() -> dict[str, QueryFn]:
    return {
        "cf_zscore_cells": q_zscore_cells,
        "cf_like_similarity": q_like_similarity,
        "abv_penalties": q_abv_penalties,
        "recommend_plain_sum": q_plain_sum,
        "abv_scaled": q_abv_scaled,
        "tfidf_terms": q_tfidf_terms,
        "csv_roundtrip": q_csv_roundtrip,
        "review_records": q_review_records,
        "append_labels": q_append_labels,
        "item_keys": q_item_keys,
        "content_keys": q_content_keys,
        "embeddings_roundtrip": q_embeddings_roundtrip,
        "strict_abv": q_strict_abv,
        "distinct_reviews": q_distinct_reviews,
        "count_location": q_count_location,
        "rating_defaults": q_rating_defaults,
        "clean_stage_counts": q_stage_counts,
        "item_info": q_item_info,
        "split_summary": q_split_summary,
        "test_rows": q_test_rows,
        "cf_user_similarity": q_user_similarity,
        "cf_predictions": q_cf_predictions,
        "cf_user_betas": q_user_betas,
        "lsh_candidate_stats": q_lsh_candidate_stats,
        "recommend_cosine": _plan("cosine"),
        "recommend_cf": _plan("cf"),
        "recommend_lsh_cf": _plan("lsh_cf", store=True),
        "recommend_lsh_cf_info": _plan("lsh_cf", with_info=True, store=True),
        "recommend_lsh_kmeans_cf": _plan("lsh_kmeans_cf"),
        "recommend_lsh_kmeans_cf_info": _plan("lsh_kmeans_cf", with_info=True),
        "recommend_bucket_score": q_bucket_score,
        "recommend_lsh_cf_linear_beta": _plan("lsh_cf", with_info=True, beta="linear"),
        "recommend_tuning": _plan("tuning", with_info=True),
        "recommend_fixed_weights_notes": q_recommend_notes,
        "cf_neighbours": q_cf_neighbours,
        "cf_jaccard_neighbours": q_cf_jaccard_neighbours,
        "mining_frequent_pairs": q_frequent_pairs,
        "mining_item_pairs": q_item_pairs,
        "mining_pair_recommender": q_pair_recommender,
        "mining_pair_lookup": q_pair_lookup,
        "item_top_terms": q_item_top_terms,
        "evaluation_summary": q_evaluation_summary,
        "evaluation_summary_bcdf": q_evaluation_bcdf,
        "cf_user_mean_predictions": q_cf_user_mean,
        "cf_mean_added_predictions": q_cf_mean_added,
        "cf_zero_share": q_cf_zero_share,
        "rating_describe": q_rating_describe,
        "subgenre_value_counts": q_value_counts,
        "lsh_quality": q_lsh_quality,
        "lsh_grid_search": q_lsh_grid_search,
        "cluster_distribution": q_cluster_distribution,
        "cluster_top_items": q_cluster_top_items,
        "embed_reviews": q_embed_reviews,
        "embed_by_item": q_embed_by_item,
        "bucket_projection": q_bucket_projection,
        "latent_topn": q_latent_topn,
        "page_links": q_page_links,
        "page_taxonomy": q_page_taxonomy,
        "page_paragraphs": q_page_paragraphs,
        "crawl_frontier": q_crawl_frontier,
        "review_page_plan": q_review_page_plan,
        "reviews_location_split": q_location_split,
        "language_profile": q_language_profile,
        "review_languages_en": q_review_languages,
        "stream_clean": q_stream_clean,
        "stream_dedupe": q_stream_dedupe,
        "stream_dedupe_keys": q_stream_dedupe_keys,
        "page_records": q_page_records,
        "review_first_pages": q_first_pages,
        "stream_index": q_stream_index,
    }


# ---------------------------------------------------------------- SQL

def oracle_sql() -> dict[str, str]:
    planes = O.default_planes(64)
    W = O.with_ctes
    split_q = O.SPLIT + (O.queries_sql(False),)
    split_qi = O.SPLIT + (O.queries_sql(True),)
    def field(text, pattern):
        return "nullif(" + _strip_sql(f"regexp_extract({text}, '{pattern}', 1)") + ", '')"
    sql = {
        "stream_dedupe_keys": W(*O.BASE) + "SELECT name, reviewer, text_hash, CAST(1 AS BIGINT) AS rows FROM reviews_dedup",
        "page_records": f"""WITH b AS (SELECT page_id, {field("html", PG.TITLE)} AS title, string_split_regex(html, '{RECORD}') AS p FROM pages),
r AS (SELECT page_id, title, unnest(p[2:]) AS raw, generate_subscripts(p[2:], 1) - 1 AS pos FROM b),
c AS (SELECT page_id, title, CAST(pos AS INTEGER) AS pos, regexp_replace(raw, '{RECORD_END}', '') AS t FROM r)
SELECT page_id, title, pos, {field("t", RECORD_LINK)} AS link, {field("t", RECORD_NAME)} AS name FROM c""",
        "review_first_pages": W(*O.BASE, """
items_n AS (SELECT name, max(total_reviews) AS count FROM reviews GROUP BY name HAVING max(total_reviews) > 10)""")
        + "SELECT name, count, CAST(unnest([1, 2, 3]) AS INTEGER) AS page FROM items_n",
        "cf_zscore_cells": W(*O.SPLIT, """
mom AS (SELECT reviewer, avg(rating) AS m, stddev_samp(rating) AS sd FROM train GROUP BY reviewer)""")
        + """SELECT t.reviewer, t.name, round(avg(rating), 6) AS r,
  round(avg(CASE WHEN sd > 0 THEN (rating - m) / sd ELSE 0 END), 6) AS x FROM train t JOIN mom USING (reviewer) GROUP BY t.reviewer, t.name""",
        "cf_like_similarity": W(*O.SPLIT, """
cl AS (SELECT reviewer, name, avg(CASE WHEN rating >= 3 THEN 1.0 ELSE 0.0 END) AS x FROM train GROUP BY reviewer, name),
nl AS (SELECT reviewer, sqrt(sum(x * x)) AS n FROM cl WHERE x <> 0 GROUP BY reviewer)""")
        + """SELECT a.reviewer AS u, b.reviewer AS v, round(sum(a.x * b.x) / (nu.n * nv.n), 6) AS sim
FROM cl a JOIN cl b ON a.name = b.name JOIN nl nu ON nu.reviewer = a.reviewer JOIN nl nv ON nv.reviewer = b.reviewer
WHERE a.reviewer IN (SELECT reviewer FROM test) AND a.x <> 0 AND b.x <> 0 GROUP BY a.reviewer, b.reviewer, nu.n, nv.n""",
        "abv_penalties": W(*O.BASE) + f"""SELECT name, round(-0.05 * (abv - {WISH}) * (abv - {WISH}) / (pow({WISH}, 1.5) + 1), 6) AS scaled_square,
  round(-0.05 * (abv - {WISH}) * (abv - {WISH}), 6) AS square, round(-0.05 * (abv - {WISH}), 6) AS linear,
  round(-0.05 * ln(1 + abs(abv - {WISH})), 6) AS log, round(-0.05 * ln(1 + abs(abv - {WISH}) / {WISH}), 6) AS log_scaled,
  round(-0.05 * abs(abv - {WISH}) / {WISH}, 6) AS linear_scaled, round(-2.0 * abs(abv), 6) AS zero_wish FROM items""",
        "recommend_plain_sum": W(*split_qi, O.CF_SQL, O.lsh_sql(planes),
                                 "text AS (SELECT query_id, name, avg(similarity) AS lsh_score FROM cand_rows GROUP BY query_id, name)",
                                 O.hybrid_ctes("text"), """
plain AS (SELECT query_id, beer, lsh_score + collab_score + abv_weight + style_bonus AS score FROM parts),
plain_ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, beer) AS rank FROM plain)""")
        + "SELECT query_id, beer, round(score, 6) AS score, CAST(rank AS BIGINT) AS rank FROM plain_ranked WHERE rank <= 20",
        "abv_scaled": W(*O.BASE) + """SELECT name, round(abv, 6) AS abv,
  round((abv - (SELECT avg(abv) FROM items)) / (SELECT stddev_pop(abv) FROM items), 6) AS abv_scaled FROM items""",
        "tfidf_terms": r"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\pL\pM\p{Nd}\p{Pc}]+')) term FROM documents),
c AS (SELECT term, count(*) n, count(DISTINCT doc_id) df FROM t WHERE length(term) >= 2 GROUP BY term),
k AS (SELECT *, row_number() OVER (ORDER BY n DESC, term) r FROM c)
SELECT term, n, df, round(ln((1 + (SELECT count(*) FROM documents)) / CAST(1 + df AS DOUBLE)) + 1, 6) AS idf FROM k WHERE r <= 100""",
        "embed_reviews": W(EMBED_SQL) + "SELECT doc_key, slot, round(value, 6) AS value FROM vectors WHERE value <> 0",
        "embed_by_item": W(*O.BASE, EMBED_SQL) + """SELECT r.name, v.slot, round(sum(v.value) / count(*), 6) AS value
FROM reviews r JOIN vectors v ON v.doc_key = r.doc_key GROUP BY r.name, v.slot""",
        "csv_roundtrip": W(REVIEWS_RAW_SQL) + """SELECT location, rating, count(*) AS reviews,
  CAST(sum(CAST(round(average_rating * 10) AS BIGINT)) AS BIGINT) AS tenths, min(id) AS first_id, CAST(sum(length(text)) AS BIGINT) AS chars, max(md5(text)) AS last_text
FROM reviews_raw JOIN documents ON doc_id = doc_key GROUP BY location, rating""",
        "review_records": W(REVIEWS_RAW_SQL) + """SELECT name, reviewer, location, rating, review_date AS date,
  md5(trim(text, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13)))) AS text_md5
FROM reviews_raw JOIN documents ON doc_id = doc_key""",
        "append_labels": W(*O.BASE) + """SELECT location, subgenre, count(*) AS items, CAST(0 AS BIGINT) AS ids
FROM items, (VALUES ('Here'), ('There')) AS p(location) GROUP BY location, subgenre""",
        "item_keys": W(*O.BASE) + "SELECT name, row_number() OVER (ORDER BY name) - 1 AS item_id FROM items",
        "content_keys": W(*O.BASE) + "SELECT name, subgenre, md5(concat_ws(chr(1), name, subgenre)) AS id FROM items",
        "embeddings_roundtrip": """SELECT vec_id, CAST(len(embedding) AS BIGINT) AS width,
  round(list_reduce(list_prepend(CAST(0 AS DOUBLE), CAST(embedding AS DOUBLE[])), lambda a, x: a + x), 4) AS total FROM embeddings""",
        "strict_abv": W(REVIEWS_RAW_SQL) + """SELECT id, round(coalesce(CAST(regexp_replace(nullif(abv, '-'), '%+$', '') AS DOUBLE), 0), 6) AS abv
FROM reviews_raw""",
        "distinct_reviews": W(REVIEWS_RAW_SQL) + "SELECT DISTINCT name, reviewer, rating, location FROM reviews_raw",
        "count_location": W(REVIEWS_RAW_SQL) + f"SELECT count(*) AS n FROM reviews_raw WHERE location = '{RESUME_COUNTRY}'",
        "rating_defaults": W(REVIEWS_RAW_SQL) + "SELECT id, coalesce(nullif(rating, 'Unknown'), 'n/a') AS rating FROM reviews_raw",
        "clean_stage_counts": W(*O.BASE, """
counts AS (SELECT (SELECT count(*) FROM reviews_raw) AS raw_n, (SELECT count(*) FROM reviews_dedup) AS dedup_n,
  (SELECT count(*) FROM reviews_num WHERE rating_d IS NOT NULL) AS rating_n, (SELECT count(*) FROM reviews) AS abv_n)""")
        + """SELECT * FROM (
  SELECT 0 AS step, 'raw' AS stage, raw_n AS rows FROM counts UNION ALL
  SELECT 1, 'drop_duplicates', dedup_n FROM counts UNION ALL
  SELECT 2, 'drop_rating_na', rating_n FROM counts UNION ALL
  SELECT 3, 'drop_abv_na', abv_n FROM counts)""",
        "item_info": W(*O.BASE) + "SELECT name, round(abv, 6) AS abv, subgenre, round(average_rating, 6) AS average_rating FROM items",
        "split_summary": W(*O.SPLIT) + f"SELECT CAST(100 AS BIGINT) AS reviewers_sampled, (SELECT count(*) FROM train) AS train_rows, (SELECT count(*) FROM test) AS test_rows",
        "test_rows": W(*O.SPLIT) + "SELECT id, reviewer, name, round(rating, 6) AS rating, round(abv, 6) AS abv, subgenre FROM test",
        "cf_user_similarity": W(*O.SPLIT, O.CF_SQL) + "SELECT u, v, round(sim, 6) AS sim FROM sim",
        "cf_predictions": W(*O.SPLIT, O.CF_SQL) + "SELECT reviewer, name, round(pred, 6) AS pred FROM pred",
        "cf_user_betas": W(*O.SPLIT, O.CF_SQL) + """SELECT c.reviewer, CAST(count_if(r > 0) AS BIGINT) AS n_reviews,
  round(max(b.beta), 6) AS beta FROM cells c JOIN betas b USING (reviewer) GROUP BY c.reviewer""",
        "lsh_candidate_stats": W(*split_q, O.lsh_sql(planes)) + """SELECT c.query_id, count(*) AS n_candidates,
  count(DISTINCT t.name) AS n_items FROM cands c JOIN train t ON t.id = c.id GROUP BY c.query_id""",
        "recommend_cosine": W(*split_q, f"""
item_scores AS (
  SELECT q.query_id, t.name, avg({O.cosine_sql('t.embedding', 'q.embedding')}) AS cosine_score
  FROM queries q, train_v t GROUP BY q.query_id, t.name),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(cosine_score, 9) DESC, name) AS rank
  FROM item_scores)""") + """SELECT query_id, name AS beer, round(cosine_score, 6) AS cosine_score, CAST(rank AS BIGINT) AS rank
FROM ranked WHERE rank <= 20""",
        "recommend_cf": W(*split_q, O.CF_SQL, """
known AS (SELECT DISTINCT reviewer FROM cells WHERE reviewer IN (SELECT reviewer FROM targets)),
grid AS (SELECT k.reviewer, i.name FROM known k, (SELECT DISTINCT name FROM cells) i),
dense AS (SELECT g.reviewer, g.name, coalesce(p.pred, 0.0) AS collab_score FROM grid g
  LEFT JOIN pred p ON p.reviewer = g.reviewer AND p.name = g.name),
ranked AS (SELECT *, row_number() OVER (PARTITION BY reviewer ORDER BY round(collab_score, 9) DESC, name) AS rank FROM dense)""")
        + """SELECT q.query_id, r.name AS beer, round(r.collab_score, 6) AS collab_score, CAST(r.rank AS BIGINT) AS rank
FROM queries q JOIN ranked r ON r.reviewer = q.reviewer WHERE r.rank <= 20""",
        "recommend_lsh_cf": W(*split_q, O.CF_SQL, O.lsh_sql(planes),
                              "text AS (SELECT query_id, name, avg(similarity) AS lsh_score FROM cand_rows GROUP BY query_id, name)",
                              O.hybrid_sql("text")),
        "recommend_lsh_cf_info": W(*split_qi, O.CF_SQL, O.lsh_sql(planes),
                                   "text AS (SELECT query_id, name, avg(similarity) AS lsh_score FROM cand_rows GROUP BY query_id, name)",
                                   O.hybrid_sql("text")),
        "recommend_lsh_kmeans_cf": W(*split_q, O.CF_SQL, O.lsh_sql(planes), O.kmeans_sql(), O.hybrid_sql("text")),
        "recommend_lsh_kmeans_cf_info": W(*split_qi, O.CF_SQL, O.lsh_sql(planes), O.kmeans_sql(), O.hybrid_sql("text")),
        "recommend_tuning": W(*split_qi, O.CF_SQL, O.lsh_sql(planes), O.kmeans_sql(15, FIXED_SEED), O.LINEAR_BETAS,
                              O.hybrid_sql("text", betas="betas_l")),
        "lsh_grid_search": W(*split_qi, O.CF_SQL, O.LINEAR_BETAS, O.grid_sql(
            LSH.make_hyperplanes(64, max(GR.KS), max(GR.LS), GR.SEED), GR.KS, GR.LS)),
        "recommend_bucket_score": W(*split_qi, O.CF_SQL, O.lsh_sql(planes),
                                    "text AS (SELECT query_id, name, min_by(similarity, id) AS lsh_score FROM cand_rows GROUP BY query_id, name)",
                                    O.LINEAR_BETAS, O.hybrid_sql("text", betas="betas_l")),
        "recommend_lsh_cf_linear_beta": W(*split_qi, O.CF_SQL, O.lsh_sql(planes),
                                          "text AS (SELECT query_id, name, avg(similarity) AS lsh_score FROM cand_rows GROUP BY query_id, name)",
                                          O.LINEAR_BETAS, O.hybrid_sql("text", betas="betas_l")),
        "cf_neighbours": W(*split_q, O.CF_SQL, """
nb AS (SELECT u, v, sim, row_number() OVER (PARTITION BY u ORDER BY sim DESC NULLS LAST, v) AS rank FROM sim)""")
        + "SELECT u, v, round(sim, 6) AS sim, CAST(rank AS BIGINT) AS rank FROM nb WHERE rank <= 5",
        "cf_jaccard_neighbours": W(*split_q, """
lcells AS (SELECT reviewer, name, CAST(trunc(avg(CASE WHEN rating >= 3 THEN 1.0 ELSE 0.0 END)) AS INTEGER) AS b
           FROM train GROUP BY reviewer, name),
bl AS (SELECT * FROM lcells WHERE b <> 0),
sizes AS (SELECT reviewer, count(*) AS n FROM bl GROUP BY reviewer),
inter AS (SELECT x.reviewer AS u, y.reviewer AS v, sum(x.b * y.b) AS both_, count(*) AS n_both
          FROM bl x JOIN bl y ON x.name = y.name
          WHERE x.reviewer IN (SELECT DISTINCT reviewer FROM test) GROUP BY x.reviewer, y.reviewer),
jac AS (SELECT i.u, i.v, CAST(i.both_ AS DOUBLE) / CAST(su.n + sv.n - i.n_both AS DOUBLE) AS sim
        FROM inter i JOIN sizes su ON su.reviewer = i.u JOIN sizes sv ON sv.reviewer = i.v),
nb AS (SELECT u, v, sim, row_number() OVER (PARTITION BY u ORDER BY sim DESC NULLS LAST, v) AS rank FROM jac)""")
        + "SELECT u, v, round(sim, 6) AS sim, CAST(rank AS BIGINT) AS rank FROM nb WHERE rank <= 5",
        "mining_frequent_pairs": W(*O.BASE, MINING_SQL) + "SELECT a, b, users FROM pairs",
        "mining_item_pairs": W(*O.BASE, MINING_SQL.replace("brewery", "name").replace(str(MINING_SUPPORT), str(ITEM_SUPPORT))) + "SELECT a, b, users FROM pairs",
        "mining_pair_recommender": W(*O.BASE, MINING_SQL, """
both_dirs AS (SELECT a AS item, b AS partner FROM pairs UNION ALL SELECT b, a FROM pairs)""")
        + "SELECT item, list_sort(list(partner)) AS partners FROM both_dirs GROUP BY item",
        "mining_pair_lookup": W(*O.SPLIT, MINING_SQL, """
both_dirs AS (SELECT a AS item, b AS partner FROM pairs UNION ALL SELECT b, a FROM pairs),
adj AS (SELECT item, list_sort(list(partner)) AS partners FROM both_dirs GROUP BY item)""")
        + "SELECT a.item, a.partners FROM adj a WHERE a.item IN (SELECT DISTINCT brewery FROM test)",
        "item_top_terms": W(*O.BASE, f"""
used AS (SELECT name, doc_key, count(*) AS m FROM reviews GROUP BY name, doc_key),
runs AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{TH.WORD_RUN.replace(chr(92) + 'p{L}', chr(92) + 'pL').replace(chr(92) + 'p{N}', chr(92) + 'pN')}')) AS term FROM documents),
toks AS (SELECT doc_id, term, count(*) AS c FROM runs WHERE regexp_full_match(term, '[a-z]{{2,}}')
         AND term NOT IN ({", ".join("'" + w.replace("'", "''") + "'" for w in TH.stop_word_list())}) GROUP BY doc_id, term),
counts AS (SELECT name, term, CAST(sum(m * c) AS BIGINT) AS n FROM used JOIN toks ON doc_id = doc_key GROUP BY name, term),
ranked AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY n DESC, term) AS term_rank FROM counts)""")
        + "SELECT name, term, n, CAST(term_rank AS BIGINT) AS term_rank FROM ranked WHERE term_rank <= 100",
        "page_links": W(PAGE_LINKS_SQL) + "SELECT page_id, pos, name, link FROM page_links WHERE name IS NOT NULL AND name <> ''",
        "page_taxonomy": W(PAGE_LINKS_SQL, f"""
heads AS (SELECT page_id, {_unescape_sql("trim(regexp_extract(html, '" + PG.HEADING + "', 1))")} AS heading FROM pages)""")
        + """SELECT h.page_id, h.heading, l.pos, l.name, l.link FROM heads h JOIN page_links l ON l.page_id = h.page_id
WHERE h.heading <> '' AND l.name IS NOT NULL AND l.name <> ''""",
        "page_paragraphs": W(f"""
consts AS (SELECT page_id, regexp_extract(html, '{PG.LANG}', 1) AS lang,
  {_unescape_sql("trim(regexp_extract(html, '" + PG.TITLE + "', 1))")} AS title FROM pages),
parts AS (SELECT page_id, string_split_regex(html, '{PG.PARAGRAPH}') AS p FROM pages),
blocks AS (SELECT page_id, unnest(p[2:]) AS b, generate_subscripts(p[2:], 1) - 1 AS pos FROM parts)""")
        + f"""SELECT b.page_id, CAST(b.pos AS INTEGER) AS pos, c.lang, c.title,
  coalesce(nullif({_strip_sql("regexp_replace(b.b, '" + PG.PARAGRAPH_END + "', '')")}, ''), c.title) AS text
FROM blocks b JOIN consts c ON c.page_id = b.page_id""",
        "crawl_frontier": W(f"""
countries AS (SELECT CAST(n_nationkey AS INTEGER) AS country_pos, lower(n_name) AS country_name, n_name AS country_text FROM nation
  WHERE NOT starts_with(n_name, 'All ') AND n_name <> '---'),
styles AS (SELECT CAST(dense_rank() OVER (ORDER BY p_type) AS INTEGER) AS style_pos,
  lower(replace(p_type, ' ', '-')) AS style_name, p_type AS style_text FROM (SELECT DISTINCT p_type FROM part)
  WHERE NOT starts_with(p_type, 'All ') AND p_type <> '---' AND NOT contains(p_type, 'Saké')),
fr AS (SELECT c.*, s.*, printf('https://example.org/top/%s/%s', style_name, country_name) AS url FROM countries c, styles s),
marks AS (SELECT min(CASE WHEN country_text = '{RESUME_COUNTRY}' THEN country_pos END) AS c0,
  min(CASE WHEN style_text = '{RESUME_STYLE}' THEN style_pos END) AS s0 FROM fr)""")
        + """SELECT fr.* FROM fr, marks WHERE marks.c0 IS NULL OR fr.country_pos > marks.c0
  OR (fr.country_pos = marks.c0 AND (marks.s0 IS NULL OR fr.style_pos >= marks.s0))""",
        "review_page_plan": W(*O.BASE, """
items_n AS (SELECT name, max(total_reviews) AS count FROM reviews GROUP BY name HAVING max(total_reviews) > 10)""")
        + "SELECT name, count, unnest(range(0, count // 100 + 1)) AS page FROM items_n",
        "reviews_location_split": W(*O.BASE) + """SELECT id, location, coalesce(substring(location, 1, 2), 'Un') AS location_short,
  coalesce(substring(location, 3), 'Unknown') AS location_rest FROM reviews""",
        "language_profile": W(LANG_PROFILE_SQL) + "SELECT lang, gram, n, round(logp, 6) AS logp FROM profile",
        "review_languages_en": W(*O.BASE, LANG_PROFILE_SQL, f"""
texts AS (SELECT DISTINCT md5(text) AS k, text AS review_text FROM documents
          WHERE text IS NOT NULL AND length(trim(text)) > 3),
tg AS (SELECT k, g AS gram, count(*) AS c FROM (
         SELECT k, unnest(CASE WHEN length(lower(review_text)) >= 3 THEN
           [substring(lower(review_text), i, 3) FOR i IN range(1, length(lower(review_text)) - 1)] ELSE [] END) AS g
         FROM texts) GROUP BY k, g),
tot AS (SELECT k, sum(c) AS n_total FROM tg GROUP BY k),
sums AS (SELECT tg.k, p.lang, sum(tg.c * (p.logp - ({LG.LOG_FLOOR}))) AS s FROM tg JOIN profile p ON p.gram = tg.gram GROUP BY tg.k, p.lang),
scored AS (SELECT s.k, s.lang, round(s.s + t.n_total * ({LG.LOG_FLOOR}), 9) AS score FROM sums s JOIN tot t ON t.k = s.k),
best AS (SELECT k, lang FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY score DESC, lang DESC) AS r FROM scored) WHERE r = 1)""")
        + """SELECT r.id, coalesce(b.lang, 'unknown') AS language FROM reviews r JOIN texts t ON t.k = r.text_hash LEFT JOIN best b ON b.k = r.text_hash
WHERE coalesce(b.lang, 'unknown') = 'en'""",
        "stream_clean": W(REVIEWS_RAW_ONLY, f"""
num AS (SELECT *, {O._num('rating')} AS rating_d, {O._num("regexp_replace(abv, '%+$', '')")} AS abv_d FROM reviews_raw)""")
        + """SELECT id, name, brewery, subgenre, round(abv_d, 6) AS abv, location, round(rating_d, 6) AS rating,
  round(average_rating, 6) AS average_rating, reviewer, review_date, doc_key, text_hash, algorithm_rating, total_reviews, vec_id
FROM num WHERE rating_d IS NOT NULL AND NOT isnan(rating_d) AND NOT isinf(rating_d)
  AND abv_d IS NOT NULL AND NOT isnan(abv_d) AND NOT isinf(abv_d)""",
        "stream_dedupe": W(*O.BASE) + """SELECT id, name, brewery, subgenre, round(abv, 6) AS abv, location, round(rating, 6) AS rating,
  round(average_rating, 6) AS average_rating, reviewer, review_date, doc_key, text_hash, algorithm_rating, total_reviews, vec_id
FROM reviews""",
        "stream_index": W(*split_q, LSH_INDEX_SQL(planes)) + "SELECT table_id, bucket, id FROM idx",
        "cf_user_mean_predictions": W(*O.SPLIT, CF_VARIANT_SQL("(avg(rating) - m)", "um")) + "SELECT reviewer, name, round(pred, 6) AS pred FROM pred_um",
        "cf_mean_added_predictions": W(*O.SPLIT, CF_VARIANT_SQL("avg(rating)", "raw"), """
means AS (SELECT reviewer, avg(r) AS m FROM cells_raw WHERE r <> 0 GROUP BY reviewer),
smv AS (SELECT s.u, sum(s.sim * m.m) AS smv FROM sim_raw s JOIN means m ON m.reviewer = s.v GROUP BY s.u),
num_r AS (SELECT s.u, c.name, sum(s.sim * c.r) AS num FROM sim_raw s JOIN cells_raw c ON c.reviewer = s.v GROUP BY s.u, c.name)""")
        + """SELECT n.u AS reviewer, n.name, round(coalesce(mu.m, 0.0) + (n.num - coalesce(v.smv, 0.0)) / d.den, 6) AS pred
FROM (SELECT u, name, num FROM num_r UNION ALL SELECT u, NULL, 0 FROM den_raw) n
JOIN den_raw d ON d.u = n.u LEFT JOIN smv v ON v.u = n.u LEFT JOIN means mu ON mu.reviewer = n.u""",
        "cf_zero_share": W(*O.SPLIT, O.CF_SQL, """
nz AS (SELECT k.reviewer, count_if(coalesce(p.pred, 0) <> 0) AS nz
       FROM (SELECT DISTINCT reviewer FROM cells WHERE reviewer IN (SELECT reviewer FROM targets)) k
       LEFT JOIN pred p ON p.reviewer = k.reviewer GROUP BY k.reviewer),
ni AS (SELECT count(DISTINCT name) AS n FROM cells)""")
        + """SELECT reviewer, round(100.0 * (1 - nz / CAST((SELECT n FROM ni) AS DOUBLE)), 6) AS zero_pct,
  round(0.6 + 0.004 * (100.0 * (1 - nz / CAST((SELECT n FROM ni) AS DOUBLE))), 6) AS beta FROM nz""",
        "rating_describe": W(*O.BASE) + """SELECT count(rating) AS count, round(avg(rating), 6) AS mean, round(stddev_samp(rating), 6) AS std,
  round(min(rating), 6) AS min, round(quantile_cont(rating, 0.25), 6) AS p25, round(quantile_cont(rating, 0.5), 6) AS p50,
  round(quantile_cont(rating, 0.75), 6) AS p75, round(max(rating), 6) AS max FROM reviews""",
        "subgenre_value_counts": W(*O.BASE) + "SELECT subgenre, count(*) AS count FROM reviews GROUP BY subgenre",
        "lsh_quality": W(*split_q, O.lsh_sql(planes), f"""
exact AS (SELECT q.query_id, t.id, {O.cosine_sql('t.embedding', 'q.embedding')} AS sim FROM queries q, train_v t),
truth AS (SELECT query_id, id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(sim, 9) DESC, id) AS r
          FROM exact) WHERE r <= 10),
c_n AS (SELECT query_id, count(*) AS n_c FROM cands GROUP BY query_id),
t_n AS (SELECT query_id, count(*) AS n_t FROM truth GROUP BY query_id),
both_ AS (SELECT c.query_id, count(*) AS hit FROM cands c JOIN truth t ON t.query_id = c.query_id AND t.id = c.id GROUP BY c.query_id),
per_q AS (SELECT t.query_id, t.n_t, coalesce(c.n_c, 0) AS n_c, coalesce(b.hit, 0) AS hit
          FROM t_n t LEFT JOIN c_n c ON c.query_id = t.query_id LEFT JOIN both_ b ON b.query_id = t.query_id)""")
        + """SELECT round(avg(hit / CAST(n_t AS DOUBLE)), 6) AS mean_recall,
  round(avg(CASE WHEN n_c = 0 THEN NULL ELSE hit / CAST(n_c AS DOUBLE) END), 6) AS mean_precision FROM per_q""",
        "evaluation_summary_bcdf": evaluation_sql(planes, "BCDF"),
        "evaluation_summary": evaluation_sql(planes, "ABCDEF"),
    }
    return sql


def evaluation_sql(planes, experiments: str) -> str:
    """E1-E4 for the named set-ups."""
    def hit(e, ranked, queries="queries"):
        return (f"SELECT '{e}' AS experiment, q.query_id, EXISTS (SELECT 1 FROM {ranked} r WHERE r.query_id = q.query_id "
                f"AND r.beer = q.true_name AND r.rank <= 20) AS hit FROM {queries} q")
    parts = {"A": hit("A", "a_ranked"), "B": hit("B", "b_ranked"), "C": hit("C", "c_ranked"), "D": hit("D", "d_ranked"),
             "E": hit("E", "e_ranked", "queries_i"), "F": hit("F", "f_ranked", "queries_i")}
    names = " ".join(f"WHEN '{e}' THEN '{t}'" for e, t in EV.PLAN_TYPES.items())
    clusters = [O.kmeans_sql(prefix="k_"), O.hybrid_ctes("k_text", "a_", "queries"), O.hybrid_ctes("k_text", "e_", "queries_i")]
    return O.with_ctes(
        *O.SPLIT, O.queries_sql(False), O.queries_sql(True).replace("queries AS", "queries_i AS"), O.CF_SQL, O.lsh_sql(planes),
        "text AS (SELECT query_id, name, avg(similarity) AS lsh_score FROM cand_rows GROUP BY query_id, name)",
        O.hybrid_ctes("text", "b_", "queries"), O.hybrid_ctes("text", "f_", "queries_i"),
        *(clusters if "A" in experiments else []), f"""
c_scores AS (
  SELECT q.query_id, t.name, avg({O.cosine_sql('t.embedding', 'q.embedding')}) AS cosine_score
  FROM queries q, train_v t GROUP BY q.query_id, t.name),
c_ranked AS (SELECT query_id, name AS beer, row_number() OVER (PARTITION BY query_id ORDER BY round(cosine_score, 9) DESC, name) AS rank
  FROM c_scores),
known AS (SELECT DISTINCT reviewer FROM cells WHERE reviewer IN (SELECT reviewer FROM targets)),
grid AS (SELECT k.reviewer, i.name FROM known k, (SELECT DISTINCT name FROM cells) i),
dense AS (SELECT g.reviewer, g.name, coalesce(p.pred, 0.0) AS collab_score FROM grid g
  LEFT JOIN pred p ON p.reviewer = g.reviewer AND p.name = g.name),
d_user AS (SELECT *, row_number() OVER (PARTITION BY reviewer ORDER BY round(collab_score, 9) DESC, name) AS rank FROM dense),
d_ranked AS (SELECT q.query_id, d.name AS beer, d.rank FROM queries q JOIN d_user d ON d.reviewer = q.reviewer),
hits AS (
  {" UNION ALL ".join(parts[e] for e in experiments)}),
agg AS (SELECT experiment, count_if(hit) AS hits, count_if(NOT hit) AS misses FROM hits GROUP BY experiment)""") + f"""SELECT experiment, hits, misses,
  round(CASE WHEN hits + hits * 19 > 0 THEN hits / (hits + hits * 19.0) ELSE 0.0 END, 6) AS precision,
  round(CASE WHEN hits + misses > 0 THEN hits / CAST(hits + misses AS DOUBLE) ELSE 0.0 END, 6) AS recall,
  round(CASE WHEN hits + misses > 0 THEN 100.0 * hits / (hits + misses) END, 6) AS accuracy_pct,
  CASE experiment {names} END AS type FROM agg"""


def CF_VARIANT_SQL(x_expr: str, tag: str) -> str:
    """Cells with a given x, cosine similarity for the target users, plain prediction."""
    t = tag
    means = ("um_means AS (SELECT reviewer, avg(r) AS m FROM (SELECT reviewer, name, avg(rating) AS r FROM train "
             "GROUP BY reviewer, name) WHERE r <> 0 GROUP BY reviewer),") if t == "um" else ""
    src = ("(SELECT tr.*, coalesce(um.m, 0.0) AS m FROM train tr LEFT JOIN um_means um USING (reviewer))" if t == "um" else "train")
    return f"""{means}
cells_{t} AS (SELECT reviewer, name, avg(rating) AS r, CASE WHEN avg(rating) <> 0 THEN {x_expr} ELSE 0 END AS x
              FROM {src} GROUP BY reviewer, name{', m' if t == 'um' else ''}),
norms_{t} AS (SELECT reviewer, sqrt(sum(x * x)) AS n FROM cells_{t} WHERE x <> 0 GROUP BY reviewer),
sim_{t} AS (
  SELECT a.reviewer AS u, b.reviewer AS v, sum(a.x * b.x) / (nu.n * nv.n) AS sim
  FROM cells_{t} a JOIN cells_{t} b ON a.name = b.name
  JOIN norms_{t} nu ON nu.reviewer = a.reviewer JOIN norms_{t} nv ON nv.reviewer = b.reviewer
  WHERE a.reviewer IN (SELECT DISTINCT reviewer FROM test) AND a.x <> 0 AND b.x <> 0
  GROUP BY a.reviewer, b.reviewer, nu.n, nv.n),
den_{t} AS (SELECT u, sum(abs(sim)) + 1e-8 AS den FROM sim_{t} GROUP BY u),
pred_{t} AS (
  SELECT s.u AS reviewer, c.name, sum(s.sim * c.x) / d.den AS pred
  FROM sim_{t} s JOIN cells_{t} c ON c.reviewer = s.v JOIN den_{t} d ON d.u = s.u
  GROUP BY s.u, c.name, d.den)
"""


def LSH_INDEX_SQL(planes) -> str:
    L = planes.shape[0]
    parts = " UNION ALL ".join(f"SELECT CAST({t} AS INTEGER) AS table_id, {O.bucket_sql('embedding', planes, t)} AS bucket, id FROM train_v"
                               for t in range(L))
    return f"idx AS ({parts})"


REVIEWS_RAW_ONLY = REVIEWS_RAW_SQL


LANG_PROFILE_SQL = f"""
dgrams AS (SELECT lang, g AS gram FROM (
  SELECT lang, unnest(CASE WHEN length(lower(text)) >= 3 THEN
    [substring(lower(text), i, 3) FOR i IN range(1, length(lower(text)) - 1)] ELSE [] END) AS g FROM documents)),
gcounts AS (SELECT lang, gram, count(*) AS n FROM dgrams GROUP BY lang, gram),
gkept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, gram) AS r FROM gcounts)
          WHERE r <= {LG.TOP_GRAMS}),
gtot AS (SELECT lang, sum(n) AS t FROM gkept GROUP BY lang),
profile AS (SELECT k.lang, k.gram, k.n, ln(k.n / t.t) AS logp FROM gkept k JOIN gtot t ON t.lang = k.lang)
"""


def _unescape_sql(x: str) -> str:
    for ent, ch in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
        x = f"replace({x}, '{ent}', '{ch}')"
    return x


def _strip_sql(x: str) -> str:
    return f"trim({_unescape_sql(f'regexp_replace({x}, {chr(39)}<[^>]*>{chr(39)}, {chr(39)} {chr(39)}, {chr(39)}g{chr(39)})')})"


PAGE_LINKS_SQL = f"""
lblocks AS (SELECT page_id, url, unnest(regexp_extract_all(html, '{PG.LINK}', 0)) AS b,
  generate_subscripts(regexp_extract_all(html, '{PG.LINK}', 0), 1) - 1 AS pos FROM pages),
lparts AS (SELECT page_id, url, pos, {_unescape_sql("regexp_extract(b, '" + PG.LINK + "', 1)")} AS href,
  {_unescape_sql("trim(regexp_extract(b, '" + PG.LINK + "', 2))")} AS name FROM lblocks),
page_links AS (SELECT page_id, CAST(pos AS INTEGER) AS pos, name,
  CASE WHEN regexp_matches(href, '^https?://') THEN href
       WHEN starts_with(href, '//') THEN concat(regexp_extract(url, '^(https?:)', 1), href)
       WHEN starts_with(href, '/') THEN concat(regexp_extract(url, '^(https?://[^/?#]*)', 1), href)
       ELSE concat(CASE WHEN regexp_extract(url, '^(https?://[^?#]*/)', 1) = ''
                        THEN concat(regexp_extract(url, '^(https?://[^/?#]*)', 1), '/')
                        ELSE regexp_extract(url, '^(https?://[^?#]*/)', 1) END, href) END AS link
  FROM lparts)
"""


EMBED_SQL = f"""
e_words AS (SELECT doc_id AS doc_key, concat('<', unnest(regexp_extract_all(lower(text), '{EB.EXPR_WORD}')), '>') AS w FROM documents),
e_grams AS (SELECT doc_key, unnest([substring(w, CAST(i AS INTEGER), 3) FOR i IN range(1, length(w) - 1)]) AS g FROM e_words),
e_hash AS (SELECT doc_key, CAST(concat('0x', substring(md5(g), 1, 8)) AS BIGINT) AS h FROM e_grams),
e_sum AS (SELECT doc_key, CAST(h % 64 AS INTEGER) AS slot, sum(CASE WHEN h >= 2147483648 THEN 1 ELSE -1 END) AS s FROM e_hash GROUP BY doc_key, h % 64),
e_norm AS (SELECT doc_key, sqrt(sum(s * s)) AS n FROM e_sum GROUP BY doc_key),
vectors AS (SELECT d.doc_id AS doc_key, CAST(p.slot AS INTEGER) AS slot, CASE WHEN n.n > 0 THEN coalesce(s.s, 0) / n.n ELSE 0.0 END AS value
  FROM documents d CROSS JOIN range(64) p(slot) LEFT JOIN e_sum s ON s.doc_key = d.doc_id AND s.slot = p.slot
  LEFT JOIN e_norm n ON n.doc_key = d.doc_id)
"""
MINING_SQL = f"""
b AS (SELECT DISTINCT reviewer AS u, brewery AS item FROM reviews WHERE rating >= 2.5),
nu AS (SELECT count(DISTINCT u) AS n FROM b),
f AS (SELECT item FROM b GROUP BY item HAVING count(*) > {MINING_SUPPORT} * (SELECT n FROM nu)),
fb AS (SELECT * FROM b WHERE item IN (SELECT item FROM f)),
pairs AS (SELECT x.item AS a, y.item AS b, count(*) AS users FROM fb x JOIN fb y ON x.u = y.u AND x.item < y.item
          GROUP BY x.item, y.item HAVING count(*) > {MINING_SUPPORT} * (SELECT n FROM nu))
"""
