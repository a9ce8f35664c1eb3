"""Held-out split.

Random choices use a seeded md5 order of the row id, so they are repeatable
and the same in any engine that has md5.

T1  sample n rows (not reviewers) -> their distinct reviewers
T2  all rows of those reviewers
T3  per reviewer, mask max(floor(count * pct), 1) rows: the first ones in hash order
T4  keep masked rows with rating > min_rating (the rest go back to train)
T5  train = all rows minus the kept test rows

T3 is a per-group "first m rows"; a reviewer may own a large share of the
table, so the rank is not computed in one window over the reviewer.  Rows are
cut into 4096 hash ranges; range counts (a small aggregate) locate the range
holding the m-th row, and only that range is ranked row by row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.sizing import broadcast_if_small

HASH_RANGE_CHARS = 3   # 16^3 = 4096 ranges per reviewer


def row_hash(seed: int, col: str = "id"):
    return F.md5(F.concat(F.lit(f"{seed}|"), F.col(col).cast("string")))


def sample_reviewers(df: DataFrame, n: int = 100, seed: int = 7, reviewer_col: str = "reviewer") -> DataFrame:
    """Reviewers of n rows drawn without replacement (seeded hash order; top-n, no full sort)."""
    drawn = df.select(reviewer_col, row_hash(seed).alias("_h")).orderBy("_h").limit(n)
    return drawn.select(reviewer_col).distinct()


def mask_per_group(rows: DataFrame, pct: float = 0.10, seed: int = 7, group: str = "reviewer") -> DataFrame:
    """The first max(floor(count * pct), 1) rows of each group in hash order."""
    h = rows.withColumn("_h", row_hash(seed)).withColumn("_r", F.substring("_h", 1, HASH_RANGE_CHARS))
    ranges = h.groupBy(group, "_r").agg(F.count(F.lit(1)).alias("_cnt"))
    w = Window.partitionBy(group).orderBy("_r")
    wall = Window.partitionBy(group)
    ranges = (ranges
              .withColumn("_before", F.coalesce(F.sum("_cnt").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
              .withColumn("_n", F.sum("_cnt").over(wall))
              .withColumn("_m", F.greatest(F.floor(F.col("_n") * F.lit(pct)), F.lit(1)).cast("long"))
              .filter(F.col("_before") < F.col("_m"))
              .select(group, "_r", "_before", "_cnt", "_m"))
    # at most 4096 rows per group: small, checked
    tagged = h.join(broadcast_if_small(ranges, "hash ranges"), [group, "_r"])
    whole = tagged.filter(F.col("_before") + F.col("_cnt") <= F.col("_m"))
    edge = tagged.filter(F.col("_before") + F.col("_cnt") > F.col("_m"))
    we = Window.partitionBy(group, "_r").orderBy("_h")
    edge = edge.withColumn("_k", F.row_number().over(we)).filter(F.col("_before") + F.col("_k") <= F.col("_m")).drop("_k")
    return whole.unionByName(edge).drop("_h", "_r", "_before", "_cnt", "_m")


def create_test_train(df: DataFrame, reviewer_col: str = "reviewer", seed: int = 7, test_size: int = 100,
                      mask_pct: float = 0.10, min_rating: float | None = 3.5) -> tuple[DataFrame, DataFrame]:
    """(train, test)."""
    reviewers = sample_reviewers(df, test_size, seed, reviewer_col)
    # at most test_size reviewers by construction: a proven bound, no count needed
    rows = df.join(F.broadcast(reviewers), reviewer_col, "left_semi")
    test = mask_per_group(rows, mask_pct, seed, reviewer_col)
    if min_rating is not None:
        test = test.filter(F.col("rating") > min_rating)
    train = df.join(test.select("id"), "id", "left_anti")
    return train, test


def split_summary(df: DataFrame, train: DataFrame, test: DataFrame, test_size: int = 100) -> DataFrame:
    """Rows drawn, train rows, test rows (one aggregate over the tagged union)."""
    tagged = train.select(F.lit(True).alias("_train")).unionByName(test.select(F.lit(False).alias("_train")))
    return tagged.agg(F.lit(test_size).cast("long").alias("reviewers_sampled"),
                      F.count_if("_train").alias("train_rows"), F.count_if(~F.col("_train")).alias("test_rows"))
