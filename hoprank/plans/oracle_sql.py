"""DuckDB SQL that states the same results as the Spark plans, for the
driver's side-by-side check.  Built from shared CTE blocks.

Doubles are rounded to 6 places on both sides; ranks order by the score
rounded to 9 places, then by name.
"""

from __future__ import annotations

import numpy as np

from ..fixtures import REVIEWS_RAW_SQL
from ..operators.clean import NUMBER_PATTERN
from .workspace import LSH_K, LSH_L, MASK_PCT, MIN_RATING, SEED, TEST_SIZE


def _num(expr: str) -> str:
    return f"(CASE WHEN regexp_matches({expr}, '{NUMBER_PATTERN}') THEN TRY_CAST(trim({expr}) AS DOUBLE) END)"


CLEAN_SQL = f"""
reviews_dedup AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY name, reviewer, text_hash ORDER BY id) rn FROM reviews_raw) WHERE rn = 1),
reviews_num AS (
  SELECT *, {_num('rating')} AS rating_d, {_num("regexp_replace(abv, '%+$', '')")} AS abv_d FROM reviews_dedup),
reviews AS (
  SELECT id, name, brewery, subgenre, abv_d AS abv, location, rating_d AS rating, average_rating, reviewer,
         review_date, doc_key, text_hash, algorithm_rating, total_reviews, vec_id
  FROM reviews_num
  WHERE rating_d IS NOT NULL AND NOT isnan(rating_d) AND NOT isinf(rating_d)
    AND abv_d IS NOT NULL AND NOT isnan(abv_d) AND NOT isinf(abv_d)),
items AS (
  SELECT name, abv, subgenre, average_rating FROM (
    SELECT *, row_number() OVER (PARTITION BY name ORDER BY id) rn FROM reviews) WHERE rn = 1)
"""

SPLIT_SQL = f"""
sampled AS (SELECT DISTINCT reviewer FROM (
  SELECT reviewer FROM reviews ORDER BY md5(concat('{SEED}|', id)) LIMIT {TEST_SIZE})),
srows AS (
  SELECT r.*, count(*) OVER (PARTITION BY r.reviewer) AS n_rev,
         row_number() OVER (PARTITION BY r.reviewer ORDER BY md5(concat('{SEED}|', r.id))) AS rk
  FROM reviews r WHERE reviewer IN (SELECT reviewer FROM sampled)),
masked AS (SELECT * EXCLUDE (n_rev, rk) FROM srows WHERE rk <= greatest(floor(n_rev * CAST({MASK_PCT} AS DOUBLE)), 1)),
test AS (SELECT * FROM masked WHERE rating > {MIN_RATING}),
train AS (SELECT * FROM reviews WHERE id NOT IN (SELECT id FROM test)),
train_v AS (SELECT t.*, e.embedding::DOUBLE[] AS embedding FROM train t JOIN embeddings e USING (vec_id)),
test_v AS (SELECT t.*, e.embedding::DOUBLE[] AS embedding FROM test t JOIN embeddings e USING (vec_id))
"""


def queries_sql(with_info: bool) -> str:
    abv = "abv" if with_info else "CAST(NULL AS DOUBLE)"
    style = "subgenre" if with_info else "CAST(NULL AS VARCHAR)"
    return f"""
queries AS (SELECT id AS query_id, embedding, reviewer, name AS true_name, {abv} AS abv_desired,
                   {style} AS style_desired FROM test_v)
"""


CF_SQL = """
cells AS (SELECT reviewer, name, avg(rating) AS r,
                 CASE WHEN avg(rating) <> 0 THEN (avg(rating) - 3) / 2 ELSE 0 END AS x
          FROM train GROUP BY reviewer, name),
targets AS (SELECT DISTINCT reviewer FROM test),
norms AS (SELECT reviewer, sqrt(sum(x * x)) AS n FROM cells WHERE x <> 0 GROUP BY reviewer),
sim AS (
  SELECT a.reviewer AS u, b.reviewer AS v, sum(a.x * b.x) / (nu.n * nv.n) AS sim
  FROM cells a JOIN cells b ON a.name = b.name
  JOIN norms nu ON nu.reviewer = a.reviewer JOIN norms nv ON nv.reviewer = b.reviewer
  WHERE a.reviewer IN (SELECT reviewer FROM targets) AND a.x <> 0 AND b.x <> 0
  GROUP BY a.reviewer, b.reviewer, nu.n, nv.n),
den AS (SELECT u, sum(abs(sim)) + 1e-8 AS den FROM sim GROUP BY u),
pred AS (
  SELECT s.u AS reviewer, c.name, sum(s.sim * c.x) / d.den AS pred
  FROM sim s JOIN cells c ON c.reviewer = s.v JOIN den d ON d.u = s.u
  GROUP BY s.u, c.name, d.den),
betas AS (
  SELECT reviewer, CASE WHEN count_if(r > 0) > 0 THEN 0.55 + 0.45 / (1 + ln(count_if(r > 0))) ELSE 0.55 END AS beta
  FROM cells WHERE reviewer IN (SELECT reviewer FROM targets) GROUP BY reviewer)
"""


def cosine_sql(a: str, b: str) -> str:
    return (f"(CASE WHEN list_dot_product({a}, {a}) = 0 OR list_dot_product({b}, {b}) = 0 THEN 0.0 "
            f"ELSE list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b}))) END)")


def bucket_sql(vec: str, planes: np.ndarray, t: int) -> str:
    _, k, _ = planes.shape
    parts = []
    for b in range(k):
        w = ", ".join(repr(float(x)) for x in planes[t, b])
        parts.append(f"(CASE WHEN list_dot_product({vec}, [{w}]::DOUBLE[]) > 0 THEN {1 << (k - 1 - b)} ELSE 0 END)")
    return "(" + " + ".join(parts) + ")"


def lsh_sql(planes: np.ndarray) -> str:
    L = planes.shape[0]
    tcols = ", ".join(f"{bucket_sql('embedding', planes, t)} AS b{t}" for t in range(L))
    union = "\n  UNION\n".join(
        f"  SELECT q.query_id, t.id FROM qsig q JOIN tsig t ON q.b{t} = t.b{t}" for t in range(L))
    return f"""
tsig AS (SELECT id, {tcols} FROM train_v),
qsig AS (SELECT query_id, {tcols} FROM queries),
cands AS (
{union}),
cand_rows AS (
  SELECT c.query_id, t.id, t.name, {cosine_sql('t.embedding', 'q.embedding')} AS similarity
  FROM cands c JOIN train_v t ON t.id = c.id JOIN queries q ON q.query_id = c.query_id)
"""


def kmeans_sql(k: int = 5, seed: int = 7, prefix: str = "") -> str:
    """K1-K3 for the candidates of every query; ends in ``{prefix}text``: mean similarity per item in the query's cluster."""
    p = prefix
    return f"""
{p}km_pts AS (
  SELECT c.query_id, t.embedding AS vid, t.embedding AS v, count(*) AS n, min(md5(concat('{seed}|', c.id))) AS h
  FROM cands c JOIN train_v t ON t.id = c.id GROUP BY c.query_id, t.embedding),
{p}km_of AS (SELECT query_id, embedding FROM queries),
{lloyd_sql(k, p)},
{p}text AS (
  SELECT r.query_id, r.name, avg(r.similarity) AS lsh_score
  FROM cand_rows r JOIN train_v t ON t.id = r.id
  JOIN {p}km_label b ON b.query_id = r.query_id AND b.vid = t.embedding
  JOIN {p}km_own o ON o.query_id = r.query_id AND o.cid = b.cid GROUP BY r.query_id, r.name)
"""


def lloyd_sql(k: int, p: str = "", iters: int = 300, tol: float = 1e-4, d: int = 64) -> str:
    """Lloyd's rounds of every query over its distinct vectors (``km_pts``: vid, v, weight n, order h) as one recursion.

    A query leaves the recursion when its centres move by no more than its limit.  Ends in
    ``km_label`` (query_id, vid, cid) and ``km_own``, the cluster of each vector of ``km_of``.
    """
    mean = ", ".join(f"sum(n * v[{j}]) / sum(n)" for j in range(1, d + 1))
    square = " + ".join(f"pow(sum(n * v[{j}]) / sum(n), 2)" for j in range(1, d + 1))
    return f"""
{p}km_init AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY h) - 1 AS INTEGER) AS cid, v AS c
  FROM {p}km_pts QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY h) <= {k}),
{p}km_limit AS (
  SELECT query_id, {tol!r}::DOUBLE * greatest(sum(n * list_dot_product(v, v)) / sum(n) - ({square}), 0) / {d} AS lim
  FROM {p}km_pts GROUP BY query_id),
{p}km AS (
  SELECT query_id, cid, c, 0 AS round, FALSE AS done FROM {p}km_init
  UNION ALL
  (WITH live AS (SELECT * FROM {p}km WHERE NOT done AND round < {iters}),
  near AS (
    SELECT pt.query_id, pt.vid, any_value(pt.v) AS v, any_value(pt.n) AS n, arg_min(l.cid, (list_distance(pt.v, l.c), l.cid)) AS cid
    FROM {p}km_pts pt JOIN live l ON l.query_id = pt.query_id GROUP BY pt.query_id, pt.vid),
  centre AS (SELECT query_id, cid, [{mean}] AS c FROM near GROUP BY query_id, cid),
  moved AS (
    SELECT l.query_id, l.cid, l.round, coalesce(m.c, l.c) AS c, pow(list_distance(coalesce(m.c, l.c), l.c), 2) AS shift
    FROM live l LEFT JOIN centre m ON m.query_id = l.query_id AND m.cid = l.cid)
  SELECT m.query_id, m.cid, m.c, m.round + 1, sum(m.shift) OVER (PARTITION BY m.query_id) <= k.lim
  FROM moved m JOIN {p}km_limit k ON k.query_id = m.query_id)),
{p}km_last AS (SELECT query_id, cid, c FROM {p}km QUALIFY round = max(round) OVER (PARTITION BY query_id)),
{p}km_label AS (
  SELECT pt.query_id, pt.vid, arg_min(l.cid, (list_distance(pt.v, l.c), l.cid)) AS cid
  FROM {p}km_pts pt JOIN {p}km_last l ON l.query_id = pt.query_id GROUP BY pt.query_id, pt.vid),
{p}km_own AS (
  SELECT q.query_id, arg_min(l.cid, (list_distance(q.embedding, l.c), l.cid)) AS cid
  FROM {p}km_of q JOIN {p}km_last l ON l.query_id = q.query_id GROUP BY q.query_id)"""


def grid_sql(planes: np.ndarray, ks, Ls, clusters: int = 5, seed: int = 7) -> str:
    """Buckets by common prefix of the bits, k-means per cell and query, places by counting better items."""
    L, kmax, _ = planes.shape
    rows = ",\n".join(f"({t}, {b}, [{', '.join(repr(float(x)) for x in planes[t, b])}])" for t in range(L) for b in range(kmax))
    return f"""
g_planes AS (SELECT t, b, w::DOUBLE[] AS w FROM (VALUES {rows}) AS p(t, b, w)),
g_keys AS (
  SELECT e.vec_id, p.t, CAST(sum(CASE WHEN list_dot_product(e.embedding::DOUBLE[], p.w) > 0 THEN 1 << ({kmax - 1} - p.b) ELSE 0 END) AS BIGINT) AS key
  FROM embeddings e, g_planes p GROUP BY e.vec_id, p.t),
g_test AS (SELECT id AS query_id, vec_id, row_number() OVER (ORDER BY id) AS q FROM test),
g_reach AS (
  SELECT a.q, b.vec_id, l.L, max({kmax} - length(ltrim(bin(xor(x.key, b.key)), '0'))) AS depth
  FROM g_test a JOIN g_keys x ON x.vec_id = a.vec_id JOIN g_keys b ON b.t = x.t
  JOIN (VALUES {', '.join(f'({x})' for x in Ls)}) AS l(L) ON x.t < l.L GROUP BY a.q, b.vec_id, l.L),
g_vec AS (SELECT vec_id, count(*) AS n, min(md5(concat('{seed}|', id))) AS h FROM train GROUP BY vec_id),
g_in AS (
  SELECT (r.q * 100 + k.k) * 100 + r.L AS cell, r.q, r.vec_id FROM g_reach r JOIN (VALUES {', '.join(f'({x})' for x in ks)}) AS k(k) ON r.depth >= k.k),
km_pts AS (SELECT i.cell AS query_id, i.vec_id AS vid, e.embedding::DOUBLE[] AS v, v.n, v.h
  FROM g_in i JOIN g_vec v ON v.vec_id = i.vec_id JOIN embeddings e ON e.vec_id = i.vec_id),
km_of AS (SELECT c.cell AS query_id, e.embedding::DOUBLE[] AS embedding FROM (SELECT DISTINCT cell, q FROM g_in) c
  JOIN g_test t ON t.q = c.q JOIN embeddings e ON e.vec_id = t.vec_id),
{lloyd_sql(clusters)},
g_sim AS (
  SELECT t.q, e.vec_id, {cosine_sql('e.embedding::DOUBLE[]', 'f.embedding::DOUBLE[]')} AS sim
  FROM g_test t JOIN embeddings f ON f.vec_id = t.vec_id, embeddings e),
g_nv AS (SELECT name, vec_id, count(*) AS n, min(id) AS id FROM train GROUP BY name, vec_id),
g_first AS (SELECT i.cell, i.q, r.name, arg_min(s.sim, r.id) AS first_sim
  FROM g_in i JOIN g_nv r ON r.vec_id = i.vec_id JOIN g_sim s ON s.q = i.q AND s.vec_id = i.vec_id GROUP BY i.cell, i.q, r.name),
g_mean AS (SELECT b.query_id AS cell, r.name, sum(r.n * s.sim) / sum(r.n) AS mean_sim
  FROM km_label b JOIN km_own o ON o.query_id = b.query_id AND o.cid = b.cid
  JOIN g_nv r ON r.vec_id = b.vid JOIN g_sim s ON s.q = b.query_id // 10000 AND s.vec_id = b.vid GROUP BY b.query_id, r.name),
g_scored AS (
  SELECT f.cell, f.q, f.name, q.true_name,
    CASE WHEN b.reviewer IS NULL THEN 1.0 ELSE b.beta END AS beta,
    CASE WHEN b.reviewer IS NULL THEN 0.0 ELSE coalesce(p.pred, 0.0) END AS cf,
    CASE WHEN abv_desired IS NULL OR abv_desired = 0 THEN 0.0
         ELSE -0.05 * ((i.abv - abv_desired) * (i.abv - abv_desired)) / (pow(abv_desired, 1.5) + 1) END
    + CASE WHEN style_desired IS NOT NULL AND style_desired <> '' AND i.subgenre = style_desired THEN 0.05 ELSE 0.0 END AS extra,
    f.first_sim, m.mean_sim
  FROM g_first f JOIN g_test t ON t.q = f.q JOIN queries q ON q.query_id = t.query_id JOIN items i ON i.name = f.name
  LEFT JOIN g_mean m ON m.cell = f.cell AND m.name = f.name
  LEFT JOIN betas_l b ON b.reviewer = q.reviewer LEFT JOIN pred p ON p.reviewer = q.reviewer AND p.name = f.name),
g_final AS (SELECT cell, name, true_name, round(beta * first_sim + (1 - beta) * cf + extra, 9) AS bucket,
  round(beta * mean_sim + (1 - beta) * cf + extra, 9) AS rec FROM g_scored),
g_true AS (SELECT cell, bucket, rec FROM g_final WHERE name = true_name),
g_place AS (
  SELECT t.cell, any_value(t.bucket) AS bucket, any_value(t.rec) AS rec, count(f.bucket) AS len_bucket, count(f.rec) AS len_rec,
    count_if(f.bucket > t.bucket OR (f.bucket = t.bucket AND f.name < f.true_name)) AS better_bucket,
    count_if(f.rec > t.rec OR (f.rec = t.rec AND f.name < f.true_name)) AS better_rec
  FROM g_true t JOIN g_final f ON f.cell = t.cell GROUP BY t.cell),
g_out AS (
  SELECT CAST((cell // 100) % 100 AS INTEGER) AS k, CAST(cell % 100 AS INTEGER) AS L, count(bucket) AS found_bucket,
    avg(CASE WHEN bucket IS NOT NULL THEN better_bucket / CAST(len_bucket AS DOUBLE) END) AS mean_norm_rank_bucket,
    count(rec) AS found_recommendations,
    avg(CASE WHEN rec IS NOT NULL THEN better_rec / CAST(len_rec AS DOUBLE) END) AS mean_norm_rank_recommendations
  FROM g_place GROUP BY ALL)
SELECT CAST(k.k AS INTEGER) AS k, CAST(l.L AS INTEGER) AS L, coalesce(o.found_bucket, 0) AS found_bucket,
  round(o.mean_norm_rank_bucket, 6) AS mean_norm_rank_bucket, coalesce(o.found_recommendations, 0) AS found_recommendations,
  round(o.mean_norm_rank_recommendations, 6) AS mean_norm_rank_recommendations
FROM (VALUES {', '.join(f'({x})' for x in ks)}) AS k(k), (VALUES {', '.join(f'({x})' for x in Ls)}) AS l(L)
LEFT JOIN g_out o ON o.k = k.k AND o.L = l.L
"""


def default_planes(d: int = 64) -> np.ndarray:
    from ..operators.lsh import make_hyperplanes
    return make_hyperplanes(d, LSH_K, LSH_L, SEED)


#: Betas from the share of zero predictions (F16), for the targets that have cells.
LINEAR_BETAS = """
known_l AS (SELECT DISTINCT reviewer FROM cells WHERE reviewer IN (SELECT reviewer FROM targets)),
betas_l AS (SELECT k.reviewer, 0.6 + 0.004 * (100.0 * (1 - count_if(coalesce(p.pred, 0) <> 0)
   / CAST((SELECT count(DISTINCT name) FROM cells) AS DOUBLE))) AS beta
   FROM known_l k LEFT JOIN pred p ON p.reviewer = k.reviewer GROUP BY k.reviewer)
"""


def hybrid_ctes(text_cte: str, prefix: str = "", queries: str = "queries", betas: str = "betas") -> str:
    """CTEs scoring (query_id, name, lsh_score) rows of ``text_cte``; ends in ``{prefix}ranked``."""
    p = prefix
    return f"""
{p}scored AS (
  SELECT t.query_id, t.name AS beer, t.lsh_score, i.abv AS item_abv, i.subgenre, q.abv_desired, q.style_desired,
         CASE WHEN b.reviewer IS NULL THEN 1.0 ELSE b.beta END AS weight_beta,
         CASE WHEN b.reviewer IS NULL THEN 0.0 ELSE coalesce(p.pred, 0.0) END AS collab_score
  FROM {text_cte} t JOIN {queries} q ON q.query_id = t.query_id
  JOIN items i ON i.name = t.name
  LEFT JOIN {betas} b ON b.reviewer = q.reviewer
  LEFT JOIN pred p ON p.reviewer = q.reviewer AND p.name = t.name),
{p}parts AS (
  SELECT *,
    CASE WHEN abv_desired IS NULL OR abv_desired = 0 THEN 0.0
         ELSE -0.05 * ((item_abv - abv_desired) * (item_abv - abv_desired)) / (pow(abv_desired, 1.5) + 1) END AS abv_weight,
    CASE WHEN abv_desired IS NULL OR abv_desired = 0 THEN 0.0 ELSE abs(item_abv - abv_desired) END AS abv_diff,
    CASE WHEN style_desired IS NOT NULL AND style_desired <> '' AND subgenre = style_desired THEN 0.05 ELSE 0.0 END AS style_bonus
  FROM {p}scored),
{p}final AS (
  SELECT *, weight_beta * lsh_score + (1 - weight_beta) * collab_score + abv_weight + style_bonus AS score FROM {p}parts),
{p}ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, beer) AS rank FROM {p}final)
"""


def hybrid_sql(text_cte: str, n: int = 20, betas: str = "betas") -> str:
    """Hybrid score for text scores in ``text_cte`` (query_id, name, lsh_score)."""
    return hybrid_ctes(text_cte, betas=betas) + f"""
SELECT query_id, beer, round(score, 6) AS score, round(item_abv, 6) AS abv, round(lsh_score, 6) AS lsh_score,
       round(lsh_score * weight_beta, 6) AS lsh_score_weighted, round(collab_score, 6) AS collab_score,
       round(collab_score * (1 - weight_beta), 6) AS collab_score_weighted, round(abv_diff, 6) AS abv_diff,
       round(abv_weight, 6) AS abv_weight, round(style_bonus, 6) AS style_bonus, round(weight_beta, 6) AS weight_beta,
       CAST(rank AS BIGINT) AS rank
FROM ranked WHERE rank <= {n}
"""


def with_ctes(*blocks: str) -> str:
    body = ",\n".join(b.strip().rstrip(",") for b in blocks)
    return f"WITH {'RECURSIVE ' if 'UNION ALL\n  (WITH live' in body else ''}{body}\n"


BASE = (REVIEWS_RAW_SQL, CLEAN_SQL)
SPLIT = BASE + (SPLIT_SQL,)
