"""Vector primitives as Spark column expressions (V5, V6, element-wise mean).

Everything here stays inside the JVM: array higher-order functions for the
per-row maths and one ``avg`` per dimension for the element-wise mean, so a
group mean is a normal partial (map-side) aggregate and never collects a
group's vectors into one place.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dot(a, b) -> Column:
    """Sum of element products, in double precision."""
    prods = F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(prods, F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def sq_norm(a) -> Column:
    return F.aggregate(_c(a), F.lit(0.0).cast("double"), lambda acc, x: acc + x.cast("double") * x.cast("double"))


def l2norm(a) -> Column:
    return F.sqrt(sq_norm(a))


def cosine(a, b) -> Column:
    """Cosine similarity; a zero vector gives 0 (as a normalised matrix product does)."""
    return F.coalesce(F.try_divide(dot(a, b), l2norm(a) * l2norm(b)), F.lit(0.0))


def scale_by(a, n) -> Column:
    """Divide every element by ``n`` (a column computed once per row); 0 stays 0."""
    n = _c(n)
    return F.transform(_c(a), lambda x: F.when(n > 0, x.cast("double") / n).otherwise(F.lit(0.0)))


def with_unit(df, vec: str, out: str):
    """Add the unit-length copy of ``vec`` as ``out``.  The norm is its own column
    first: a norm written inside the element lambda would be recomputed per element."""
    return df.withColumn("_norm", l2norm(vec)).withColumn(out, scale_by(vec, "_norm")).drop("_norm")


def normalize(a) -> Column:
    """Unit-length copy as one expression (norm per element: use ``with_unit`` on wide vectors)."""
    return scale_by(a, l2norm(a))


def elementwise_avg(a, dim: int) -> Column:
    """Aggregate: element-wise mean of a fixed-width vector column (one ``avg`` per slot)."""
    col = _c(a)
    return F.array(*[F.avg(col.getItem(i).cast("double")) for i in range(dim)])


def elementwise_sum(a, dim: int) -> Column:
    col = _c(a)
    return F.array(*[F.sum(col.getItem(i).cast("double")) for i in range(dim)])


def sq_dist(a, b) -> Column:
    diffs = F.zip_with(_c(a), _c(b), lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.aggregate(diffs, F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def vector_dim(df, col: str = "embedding") -> int:
    """Width of a vector column, read from one row (a single-row job)."""
    row = df.select(F.size(col).alias("d")).filter(F.col("d") > 0).first()
    return int(row["d"]) if row else 0
