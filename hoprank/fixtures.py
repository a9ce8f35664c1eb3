"""Driver tables -> the review table the engine works on.

The driver ships TPC-H-like tables; this module maps them onto the review
schema (one row per review: item ``name``, ``reviewer``, text ``rating`` and
``abv`` that still need cleaning, a review text and a vector id).  The same
mapping is given as DuckDB SQL (``REVIEWS_RAW_SQL``) for the oracle checks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.vectors import vector_dim

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a side that every task may hold; the rows of these sides are narrow.
SIDE_ROWS = 2_000_000
#: Bytes of vectors that every task may hold.
SIDE_BYTES = 64 << 20


def _side(df: DataFrame, counted: DataFrame | None = None) -> DataFrame:
    """The small side of a join: broadcast when the table it comes from has few rows (counted from file metadata)."""
    return F.broadcast(df) if (counted if counted is not None else df).count() <= SIDE_ROWS else df


def reviews_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lineitems as reviews, plus planted duplicates (every 50th order again)."""
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.col("l_quantity").cast("int").alias("q"), "l_shipdate")
    # two scalars from file metadata; no data passes through the driver
    n_docs = table(spark, sf_dir, "documents").count()
    n_vecs = table(spark, sf_dir, "embeddings").count()

    # sides are put together before they meet the reviews: the number of the reviewer's nation with the orders, the review
    # count (planted copies included; a partial aggregate, not a window over a hot item) with the items
    cust = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    orders = (table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
              .join(_side(cust), F.col("o_custkey") == F.col("c_custkey"))
              .select("o_orderkey", "o_custkey", "c_nationkey"))
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", "p_size")
    per_item = li.groupBy("l_partkey").agg(
        (F.count(F.lit(1)) + F.count_if(F.col("l_orderkey") % 50 == 0)).alias("total_reviews"))
    items = part.join(per_item, F.col("p_partkey") == F.col("l_partkey")).drop("l_partkey")
    # a review's text is a whole document; the reviews carry its id and its hash (see ``with_text``)
    docs = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("text_hash"))

    # the joins move numbers; the strings of a review are made after the last of them
    base = (li.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).drop("o_orderkey")
            .join(_side(items, part), F.col("l_partkey") == F.col("p_partkey")).drop("p_partkey")
            .withColumn("doc_key", (F.col("l_orderkey") * 7 + F.col("l_partkey")) % F.lit(n_docs))
            .withColumn("vec_id", (F.col("l_partkey") * 31 + F.col("l_orderkey")) % F.lit(n_vecs))
            .join(_side(docs, docs.select("doc_id")), F.col("doc_key") == F.col("doc_id"))
            .join(_side(nation), F.col("c_nationkey") == F.col("n_nationkey")))
    key = [F.col(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "q")]
    own, copy = F.concat_ws("-", *key), F.concat_ws("-", *key, F.lit("dup"))
    out = base.withColumn("id", F.explode(F.when(F.col("l_orderkey") % 50 == 0, F.array(own, copy)).otherwise(F.array(own))))

    q = F.col("q")
    return out.select(
        "id",
        F.concat(F.lit("item-"), F.col("l_partkey").cast("string")).alias("name"),
        F.col("p_brand").alias("brewery"),
        F.col("p_type").alias("subgenre"),
        F.when(F.col("l_partkey") % 23 == 0, F.lit("-"))
        .otherwise(F.concat(F.expr("(p_size % 50) DIV 5").cast("string"), F.lit("."),
                            ((F.col("p_size") % 5) * 2).cast("string"), F.lit("%"))).alias("abv"),
        F.col("n_name").alias("location"),
        F.when(F.col("l_suppkey") % 37 == 0, F.lit("Unknown"))
        .otherwise(F.concat(F.expr("q DIV 10").cast("string"), F.lit("."),
                            (q % 10).cast("string"))).alias("rating"),
        (F.lit(1.0) + (F.col("l_partkey") % 41) / F.lit(10.0)).alias("average_rating"),
        F.concat(F.lit("user-"), F.col("o_custkey").cast("string")).alias("reviewer"),
        F.date_format(F.col("l_shipdate"), "yyyy-MM-dd").alias("review_date"),
        "doc_key",
        "text_hash",
        F.lit(None).cast("double").alias("algorithm_rating"),
        "total_reviews",
        "vec_id",
    )


def with_text(spark: SparkSession, sf_dir: str, df: DataFrame) -> DataFrame:
    """Attach the whole review text by ``doc_key``: only plans that read the text pay for it."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc_key"), F.col("text").alias("review_text"))
    return df.join(docs, "doc_key")


def with_embedding(spark: SparkSession, sf_dir: str, df: DataFrame, col: str = "embedding") -> DataFrame:
    """Attach the review vector by ``vec_id`` (a join; fetch vectors as late as possible)."""
    vec = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias(col))
    width = vector_dim(vec, col)
    if vec.count() * max(width, 1) * 4 <= SIDE_BYTES:     # few vectors go to the rows
        vec = F.broadcast(vec)
    return df.join(vec, "vec_id")


# DuckDB form of ``reviews_raw`` (views: lineitem, orders, part, customer, nation,
# documents, embeddings are registered by the checker).
REVIEWS_RAW_SQL = """
reviews_base AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS INT) q, l_shipdate, o_custkey
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
reviews_nd AS (SELECT count(*) n FROM documents),
reviews_nv AS (SELECT count(*) n FROM embeddings),
reviews_r AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, q) id, b.* FROM reviews_base b
  UNION ALL
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, q, 'dup') id, b.*
  FROM reviews_base b WHERE l_orderkey % 50 = 0),
reviews_raw AS (
SELECT r.id,
  concat('item-', l_partkey) AS name,
  p_brand AS brewery,
  p_type AS subgenre,
  CASE WHEN l_partkey % 23 = 0 THEN '-'
       ELSE concat((p_size % 50) // 5, '.', (p_size % 5) * 2, '%') END AS abv,
  n_name AS location,
  CASE WHEN l_suppkey % 37 = 0 THEN 'Unknown'
       ELSE concat(q // 10, '.', q % 10) END AS rating,
  CAST(1 + (l_partkey % 41) / CAST(10 AS DOUBLE) AS DOUBLE) AS average_rating,
  concat('user-', o_custkey) AS reviewer,
  CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS review_date,
  doc_id AS doc_key, md5(text) AS text_hash,
  CAST(NULL AS DOUBLE) AS algorithm_rating,
  count(*) OVER (PARTITION BY l_partkey) AS total_reviews,
  vec_id
FROM reviews_r r
JOIN part ON p_partkey = l_partkey
JOIN customer ON c_custkey = o_custkey
JOIN nation ON n_nationkey = c_nationkey
CROSS JOIN reviews_nd nd CROSS JOIN reviews_nv nv
JOIN documents ON doc_id = (l_orderkey * 7 + l_partkey) % nd.n
JOIN embeddings ON vec_id = (l_partkey * 31 + l_orderkey) % nv.n)
"""
