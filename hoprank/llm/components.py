"""Connected components by alternating large-star and small-star, as Spark joins.

Each round points every larger neighbour of a vertex at its smallest neighbour
(large-star), then every smaller one (small-star), until each component is a star
around its smallest vertex.  A hub's neighbours are
never gathered in one row: the minimum is a partial aggregate, and it is joined
back to the edges (adaptive execution splits a hot hub).  Rounds are cut with
``checkpoint()``; they end when every component is a star.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(edges: DataFrame) -> DataFrame:
    near = _both(edges)
    low = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return near.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Edges point from u to a smaller v."""
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(low, "u")
    return (moved.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(low.select("u", F.col("m").alias("v"))).distinct())


def _is_star(edges: DataFrame) -> bool:
    """Whether each vertex points at one other, which points at none."""
    ends = edges.select(F.col("u").alias("vertex"), F.lit(1).alias("out")).union(
        edges.select(F.col("v").alias("vertex"), F.lit(None).cast("int")))
    return ends.groupBy("vertex").agg(F.count("out").alias("out"), F.count_if(F.col("out").isNull()).alias("in")).filter(
        (F.col("out") > 1) | ((F.col("out") > 0) & (F.col("in") > 0))).isEmpty()


def stars(links: DataFrame) -> DataFrame:
    """``links`` (u, v) -> (u, v): each vertex that isn't the smallest of its component, and the smallest."""
    edges = cut_lineage(links.filter("u <> v").select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while not _is_star(edges):
        edges = cut_lineage(_small_star(_large_star(edges)))
    return edges


def components(links: DataFrame) -> DataFrame:
    """``links`` (u, v) -> (vertex, component): the smallest vertex reachable, for every vertex that has a link.

    Null ends and loops are left out; repeated links count once; no links give no rows.
    """
    edges = stars(links)
    return edges.select(F.col("u").alias("vertex"), F.col("v").alias("component")).union(
        edges.select(F.col("v").alias("vertex"), F.col("v").alias("component")).distinct())
