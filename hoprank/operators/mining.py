"""Frequent-pair mining (M1-M5), apriori style.

Pass 1 counts users per item.  Pass 2 hashes the pairs of frequent items of each user into
a fixed number of buckets and counts these (a partial aggregate of at most BUCKETS rows a
task).  Pass 3 counts, exactly, only pairs whose bucket reaches the threshold: a frequent pair's bucket
always does, and most infrequent pairs never become rows of a shuffle.  A user's pairs
come from a join on the user, so no user's items are ever one row and adaptive execution
splits an active one.  Both thresholds are strict (> s * N), as in the reference.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.sizing import broadcast_if_small
from ..session import write_once

#: Buckets of the hashed pair counts.
BUCKETS = 1 << 20


def baskets(df: DataFrame, item: str = "name", user: str = "reviewer", min_rating: float = 2.5) -> DataFrame:
    """M1: distinct (user, item) with rating >= min_rating."""
    return (df.filter(F.col("rating") >= min_rating)
            .select(F.col(user).alias("user"), F.col(item).alias("item")).distinct())


def frequent_items(b: DataFrame, support: float) -> tuple[DataFrame, int]:
    """M2: items whose user count is strictly above support * N; also returns N."""
    n_users = b.select("user").distinct().count()
    counts = b.groupBy("item").agg(F.count(F.lit(1)).alias("users"))
    return counts.filter(F.col("users") > F.lit(support * n_users)), n_users


def frequent_pairs(df: DataFrame, support: float, item: str = "name", user: str = "reviewer",
                   min_rating: float = 2.5, buckets: int = BUCKETS) -> DataFrame:
    """M3: (a, b, users) with a < b, both frequent, co-rated by strictly more than support * N users."""
    b = write_once(baskets(df, item, user, min_rating), "baskets")      # read by every pass
    freq, n_users = frequent_items(b, support)
    fb = b.join(broadcast_if_small(freq.select("item"), "frequent items"), "item", "left_semi")
    x, y = fb.select("user", F.col("item").alias("a")), fb.select("user", F.col("item").alias("b"))
    pairs = x.join(y, "user").filter("a < b").select("a", "b", F.pmod(F.xxhash64("a", "b"), F.lit(buckets)).alias("bucket"))
    enough = F.col("users") > F.lit(support * n_users)
    hot = pairs.groupBy("bucket").agg(F.count(F.lit(1)).alias("users")).filter(enough).select("bucket")
    # at most BUCKETS numbers by construction
    some = pairs.join(F.broadcast(hot) if buckets <= BUCKETS else hot, "bucket", "left_semi")
    return some.groupBy("a", "b").agg(F.count(F.lit(1)).alias("users")).filter(enough)


def pair_recommender(pairs: DataFrame) -> DataFrame:
    """M4: item -> sorted list of partners (both directions)."""
    both = pairs.select(F.col("a").alias("item"), F.col("b").alias("partner")).unionByName(
        pairs.select(F.col("b").alias("item"), F.col("a").alias("partner")))
    return both.groupBy("item").agg(F.sort_array(F.collect_list("partner")).alias("partners"))


def recommend_pairs(adjacency: DataFrame, items: DataFrame, item_col: str = "item") -> DataFrame:
    """M5: partners of the given items (items without partners are absent)."""
    return items.select(F.col(item_col).alias("item")).distinct().join(adjacency, "item")
