"""Recommendation set-ups A-F and the early fixed-weight hybrid.

Every set-up takes a ``queries`` DataFrame - any number of rows of
(query_id, embedding, reviewer, abv_desired, style_desired) - and returns one
ranked table for all of them.  The reference answers one query at a time.

A  lsh_kmeans_cf : LSH candidates -> k-means in the bucket -> query's cluster -> mean cosine per item -> hybrid
B  lsh_cf        : LSH candidates -> mean cosine per item -> hybrid
C  cosine        : mean cosine of the query to every item (no index)
D  cf            : collaborative filtering only
E, F             : A and B with the held-out row's abv and style as wishes
fixed_weights    : 0.85 text / 0.15 CF, k=15 clusters, abv always, top 10 with notes
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring as S
from ..functions.arrowvec import QueryBlock, query_blocks
from ..operators import cf as CF
from ..operators import kmeans as KM
from ..operators import lsh as LSH
from ..operators.knn import item_similarity, score_items
from ..operators.lsh_store import LshStore
from ..session import write_once
from .sizing import broadcast_if_small

REC_COLUMNS = ["query_id", "beer", "score", "abv", "lsh_score", "lsh_score_weighted", "collab_score",
               "collab_score_weighted", "abv_diff", "abv_weight", "style_bonus", "weight_beta", "rank"]


#: The stored index is read in part while the queries want no more than this share of the rows.
STORE_SHARE = 0.2

#: Seed of the fixed-weight and the tuning recommender (fixed value).
FIXED_SEED = 42

#: (query, vector) pairs that every task may hold; users whose predictions are kept by their names.
MAX_HITS, MAX_USERS = 500_000, 10_000


@dataclass
class Model:
    """Everything the set-ups share: training rows (with vectors), item dimension, LSH planes and index.

    Reviews name their vector.  Hashing, k-means and similarities work on the vectors, each once with the number of
    its reviews; the reviews are met by the vector's id afterwards and their vectors are never moved.
    """
    train: DataFrame                 # id, name, reviewer, rating, abv, subgenre, embedding
    items: DataFrame                 # name, abv, subgenre, average_rating
    planes: np.ndarray
    index: DataFrame | None = None   # table_id, bucket, id
    scale: str = "midpoint"
    store: LshStore | None = None    # the index as stored tables that queries read in part
    candidates: str = "auto"         # auto: store if the queries want a small share of the rows | store | probe | join
    cells: DataFrame | None = None   # utility table, written once per model

    profiles: Callable[[], DataFrame] | None = None   # item profiles of ``train``, built when a plan asks for them
    vectors: DataFrame | None = None   # id, embedding
    rows: DataFrame | None = None      # id, name, vec_id: the reviews and the vectors that they name
    _kept: dict = field(default_factory=dict)

    def utility(self) -> DataFrame:
        if self.cells is None:
            self.cells = write_once(CF.utility(self.train, self.scale), "cells")
        return self.cells

    def weights(self, seed: int) -> DataFrame:
        """(id, w, h): the reviews of a vector, and the least seeded hash of their ids (partial aggregates); written once."""
        if ("weights", seed) not in self._kept:
            h = self.rows.select(F.col("vec_id").alias("vec"), KM.seeded_hash(seed).alias("h"))
            self._kept["weights", seed] = write_once(
                h.groupBy("vec").agg(F.count(F.lit(1)).alias("w"), F.min("h").alias("h")).withColumnRenamed("vec", "id"), "weights")
        return self._kept["weights", seed]

    def cf(self, users: DataFrame) -> tuple[DataFrame, DataFrame]:
        """CF predictions of the users for all items that they reach, and betas; written once for the same users."""
        some = users.limit(MAX_USERS + 1).collect()
        key = ("cf", frozenset(r[0] for r in some)) if len(some) <= MAX_USERS else None
        if key not in self._kept:
            pred, betas = CF.cf_scores(self.train, users, None, self.scale, cells=self.utility())
            both = write_once(pred, "pred"), betas
            if key is None:
                return both
            self._kept[key] = both
        return self._kept[key]

    @classmethod
    def build(cls, train: DataFrame, items: DataFrame, d: int, k: int = 8, L: int = 4, seed: int = 7,
              vectors: DataFrame | None = None, rows: DataFrame | None = None) -> "Model":
        planes = LSH.make_hyperplanes(d, k, L, seed)
        if vectors is None:              # every review has a vector of its own
            vectors, rows = train.select("id", "embedding"), train.select("id", "name", F.col("id").alias("vec_id"))
        return cls(train=train, items=items, planes=planes, index=LSH.build_index(train, planes), vectors=vectors, rows=rows)


def vector_candidates(model: Model, queries: DataFrame, with_vectors: bool = False) -> DataFrame:
    """(query_id, id, similarity[, embedding]) of every vector that the LSH tables give for a query.

    store: the pruned read of the stored index; probe: a map-only pass over all vectors for each block
    of queries, whose keys are broadcast (nothing needs to be stored before); join: index join + fetch by id.
    All give the same rows.
    """
    how = model.candidates
    if how == "auto":
        how = "store" if model.store is not None and model.store.share(queries) <= STORE_SHARE else "probe"
    if how == "store":
        return model.store.similarity(queries, with_vectors)
    if how == "probe":
        out = None
        for block in query_blocks(queries.select("query_id", "embedding")):
            part = LSH.probe_candidates(model.vectors, block, model.planes, keep=("id",), with_vectors=with_vectors)
            out = part if out is None else out.union(part)
        return out
    cands = LSH.query_index(LSH.build_index(model.vectors, model.planes), queries, model.planes)
    rows = LSH.fetch_candidates(cands, model.vectors, ("id", "embedding"))
    sims = LSH.candidate_similarity(rows, queries, keep=("id",))
    if with_vectors:
        sims = sims.join(model.vectors, "id")
    return sims


def meet(rows: DataFrame, hits: DataFrame) -> DataFrame:
    """The reviews of the vectors in ``hits`` (id, further columns): few hits go to the reviews, many meet them by a shuffle."""
    return rows.join(broadcast_if_small(hits.withColumnRenamed("id", "vec_id"), "hits", MAX_HITS), "vec_id")


def lsh_candidates(model: Model, queries: DataFrame) -> DataFrame:
    """(query_id, id, name, similarity) of every LSH candidate review."""
    hits = write_once(vector_candidates(model, queries), "hits")
    return meet(model.rows, hits).select("query_id", "id", "name", "similarity")


def text_scores_lsh(model: Model, queries: DataFrame) -> DataFrame:
    return item_similarity(lsh_candidates(model, queries))


def weighted_points(model: Model, queries: DataFrame, seed: int) -> DataFrame:
    """The candidate vectors of every query with the number of their reviews (``w``) and their least hash (``h``), written."""
    points = vector_candidates(model, queries, with_vectors=True)
    return write_once(points.join(broadcast_if_small(model.weights(seed), "weights", MAX_HITS), "id"), "points")


def text_scores_cluster(model: Model, queries: DataFrame, n_clusters: int = 5, iters: int = 300, seed: int = 7) -> DataFrame:
    """Mean similarity per item in the query's cluster."""
    hits = cluster_hits(model, queries.select("query_id", "embedding"), n_clusters, iters, seed)
    return item_similarity(meet(model.rows, hits).select("query_id", "name", "similarity"))


def cluster_hits(model: Model, queries: DataFrame, n_clusters: int, iters: int, seed: int) -> DataFrame:
    """(query_id, id, similarity) of the vectors in the query's cluster, written once for the same queries; blocks of
    queries whose centres fit are done in turn."""
    code = F.xxhash64("query_id", "embedding")
    same = queries.agg(F.count(F.lit(1)), F.bit_xor(code), F.sum(F.pmod(code, F.lit(1 << 40)))).first()
    key = ("cluster", tuple(same), n_clusters, iters, seed)
    if key not in model._kept:
        out = None
        for block in query_blocks(queries, per_query=n_clusters):
            points = weighted_points(model, block, seed)
            fitted = KM.keyed_kmeans(points, n_clusters, iters, seed, weight="w", order="h")
            part = write_once(fitted.same_cluster_similarity(points, QueryBlock.collect(block), keep=("id",)), "hits")
            out = part if out is None else out.union(part)
        model._kept[key] = out
    return model._kept[key]


def hybrid(model: Model, queries: DataFrame, text: DataFrame, beta_mode: str = "log",
           zero_is_wish: bool = False, use_style: bool = True, n: int | None = 20) -> DataFrame:
    """Combine text score, CF, abv penalty and style bonus; rank per query.

    ``beta_mode``: log (F15), linear (F16, from the share of zero predictions), fixed, or sum (H7).
    """
    users = queries.select("reviewer").distinct()
    pred, betas = model.cf(users)
    if beta_mode == "linear":
        betas = CF.zero_share(model.utility(), pred, users)
    q = (queries.select("query_id", "reviewer", "abv_desired", "style_desired")
         .join(betas.select("reviewer", F.lit(True).alias("known"), F.col("beta").alias("b")), "reviewer", "left"))
    q = write_once(q, "queries")
    # predictions are laid out as the scores are, by query and item: the scores are shuffled once, for their means
    cf = (pred.join(broadcast_if_small(q.select("query_id", "reviewer").distinct(), "queries"), "reviewer")
          .select(F.col("query_id").alias("_q"), F.col("name").alias("_n"), F.col("reviewer").alias("_u"), F.col("pred").alias("cf")))
    t = (text.join(broadcast_if_small(q, "queries"), "query_id")
         .join(cf, (F.col("query_id") == F.col("_q")) & (F.col("name") == F.col("_n"))
               & F.coalesce(F.col("reviewer") == F.col("_u"), F.lit(False)), "left").drop("_q", "_n", "_u")
         .join(broadcast_if_small(model.items.select("name", F.col("abv").alias("item_abv"), "subgenre"), "items"), "name"))
    if beta_mode == "fixed":
        beta = F.when(F.col("known"), F.lit(S.FIXED_BETA)).otherwise(F.lit(1.0))
    elif beta_mode == "sum":      # H7, first version: text + cf with weights 1 and 1
        beta = F.lit(None).cast("double")
    else:
        beta = F.coalesce(F.col("b"), F.lit(1.0))                 # H8: unknown user -> beta 1, cf 0
    cf = F.when(F.col("known"), F.coalesce(F.col("cf"), F.lit(0.0))).otherwise(F.lit(0.0))
    want = F.col("abv_desired")
    abv_w = S.abv_penalty("item_abv", want, zero_is_wish=zero_is_wish)
    bonus = S.style_bonus("subgenre", "style_desired") if use_style else F.lit(0.0)
    score = (S.hybrid_score("lsh_score", "collab_score", "weight_beta", "abv_weight", "style_bonus") if beta_mode != "sum"
             else F.col("lsh_score") + F.col("collab_score") + F.col("abv_weight") + F.col("style_bonus"))
    out = (t.withColumn("weight_beta", beta).withColumn("collab_score", cf)
           .withColumn("abv_weight", abv_w).withColumn("style_bonus", bonus)
           .withColumn("score", score)
           .select("query_id", F.col("name").alias("beer"), "score", F.col("item_abv").alias("abv"), "lsh_score",
                   (F.col("lsh_score") * F.coalesce("weight_beta", F.lit(1.0))).alias("lsh_score_weighted"), "collab_score",
                   (F.col("collab_score") * F.coalesce(1 - F.col("weight_beta"), F.lit(1.0))).alias("collab_score_weighted"),
                   S.abv_diff("item_abv", want, zero_is_wish).alias("abv_diff"), "abv_weight", "style_bonus",
                   "weight_beta"))
    return rank(out, "score", n)


def rank(df: DataFrame, score: str, n: int | None, key: str = "beer", digits: int = 9) -> DataFrame:
    """H9: position per query by score desc (ties by item name); keep the first n."""
    w = Window.partitionBy("query_id").orderBy(F.round(score, digits).desc(), F.col(key))
    out = df.withColumn("rank", F.row_number().over(w).cast("long"))
    return out if n is None else out.filter(F.col("rank") <= n)


def recommend(model: Model, queries: DataFrame, plan: str = "lsh_cf", n: int | None = 20,
              n_clusters: int = 5, iters: int = 300, seed: int = 7, beta: str = "log") -> DataFrame:
    """The ranked items of every query; ``n=None`` keeps all, ``beta`` is hybrid's ``beta_mode`` (A, B, E, F)."""
    if plan == "lsh_cf":
        return hybrid(model, queries, text_scores_lsh(model, queries), beta, n=n)
    if plan == "lsh_kmeans_cf":
        return hybrid(model, queries, text_scores_cluster(model, queries, n_clusters, iters, seed), beta, n=n)
    if plan == "cosine":
        profiles = model.profiles() if model.profiles else None
        return score_items(model.train, queries, n, profiles=profiles).withColumnRenamed("name", "beer")
    if plan == "cf":
        users = queries.select("reviewer").distinct()
        ranked = CF.recommend_cf(model.train, users, n, model.scale, cells=model.utility())
        return queries.select("query_id", "reviewer").join(ranked, "reviewer").select(
            "query_id", F.col("name").alias("beer"), "collab_score", "rank")
    if plan == "fixed_weights":
        text = text_scores_cluster(model, queries, 15, iters, FIXED_SEED)
        return hybrid(model, queries, text, beta_mode="fixed", zero_is_wish=True, use_style=False, n=n)
    if plan == "tuning":              # the tuning recommender: 15 clusters, linear beta
        text = text_scores_cluster(model, queries, 15, iters, FIXED_SEED)
        return hybrid(model, queries, text, beta_mode="linear", n=n)
    raise ValueError(f"unknown plan {plan!r}")


def bucket_score(model: Model, queries: DataFrame, n: int | None = None) -> DataFrame:
    """Score of the first candidate row per item in the whole bucket (not the mean)."""
    rows = lsh_candidates(model, queries)
    first = rows.groupBy("query_id", "name").agg(F.min_by("similarity", "id").alias("lsh_score"))
    return hybrid(model, queries, first, beta_mode="linear", n=n)


def queries_from_test(test: DataFrame, with_info: bool = False) -> DataFrame:
    """Held-out rows as queries; E/F use the row's abv and style as wishes."""
    return test.select(
        F.col("id").alias("query_id"), "embedding", "reviewer", F.col("name").alias("true_name"),
        (F.col("abv") if with_info else F.lit(None).cast("double")).alias("abv_desired"),
        (F.col("subgenre") if with_info else F.lit(None).cast("string")).alias("style_desired"))
