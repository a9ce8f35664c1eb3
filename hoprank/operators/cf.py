"""User-user collaborative filtering on a sparse utility table.

The reference pivots to a dense reviewer x item matrix and multiplies dense
matrices.  Here every matrix stays a long table of non-empty cells:

* ``utility``      (reviewer, name, r, x)   one row per rated cell
* ``user_similarity`` (u, v, sim)          from a self-join on the item,
  restricted to a set of target users (the evaluation's users), so its size
  is |targets| x |neighbours| and not |users|^2
* ``predict``      (reviewer, name, pred)  sum of sim * x over neighbours,
  divided by the user's sum of |sim| over all users (not only raters of the item)
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.scoring import CF_EPS, beta_log, beta_linear
from ..plans.sizing import broadcast_if_small, small_enough
from ..session import cut_lineage, write_once


def utility(df: DataFrame, scale: str = "midpoint", user: str = "reviewer", item: str = "name",
            rating: str = "rating") -> DataFrame:
    """Mean rating per (user, item) cell, then the cell value ``x``.

    midpoint  x = (r - 3) / 2          (final version)
    user_mean x = r - mean of the user's cells
    zscore    x = mean over the cell's rows of (rating - user mean) / user sample std, 0 if std is 0/undefined
    like      x = mean over the cell's rows of (rating >= 3)
    """
    rows = df.select(F.col(user).alias("reviewer"), F.col(item).alias("name"), F.col(rating).cast("double").alias("rating"))
    if scale == "zscore":
        # per-user moments by a partial aggregate, joined back (no window over a hot user)
        mom = rows.groupBy("reviewer").agg(F.avg("rating").alias("m"), F.stddev_samp("rating").alias("sd"))
        rows = rows.join(mom, "reviewer").withColumn(
            "v", F.when(F.col("sd") > 0, (F.col("rating") - F.col("m")) / F.col("sd")).otherwise(F.lit(0.0)))
        return rows.groupBy("reviewer", "name").agg(F.avg("rating").alias("r"), F.avg("v").alias("x"))
    if scale == "like":
        return rows.groupBy("reviewer", "name").agg(
            F.avg("rating").alias("r"), F.avg((F.col("rating") >= 3).cast("double")).alias("x"))
    cells = rows.groupBy("reviewer", "name").agg(F.avg("rating").alias("r"))
    if scale == "raw":      # the mean-added variant measures similarity on the ratings themselves
        return cells.withColumn("x", F.col("r"))
    if scale == "midpoint":
        return cells.withColumn("x", F.when(F.col("r") != 0, (F.col("r") - 3) / 2).otherwise(F.lit(0.0)))
    if scale == "user_mean":
        m = cells.filter(F.col("r") != 0).groupBy("reviewer").agg(F.avg("r").alias("m"))
        return cells.join(m, "reviewer", "left").withColumn(
            "x", F.when(F.col("r") != 0, F.col("r") - F.coalesce("m", F.lit(0.0))).otherwise(F.lit(0.0))).drop("m")
    raise ValueError(f"unknown scale {scale!r}")


def review_counts(cells: DataFrame) -> DataFrame:
    """rated items per user (cells with r > 0)."""
    return cells.groupBy("reviewer").agg(F.count_if(F.col("r") > 0).alias("n_reviews"))


def user_betas(cells: DataFrame) -> DataFrame:
    """F14 + F15: beta per user."""
    return review_counts(cells).withColumn("beta", beta_log("n_reviews"))


def _targets(cells: DataFrame, users: DataFrame | None) -> DataFrame:
    if users is None:
        return cells
    u = users.select(F.col(users.columns[0]).alias("reviewer")).distinct()
    return cells.join(broadcast_if_small(u, "target users"), "reviewer", "left_semi")


def _only(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows whose key is among ``keys``, picked out where they lie if the distinct keys are few; else all rows."""
    keys = write_once(keys.select(key).distinct(), "keys")
    return rows.join(F.broadcast(keys), key, "left_semi") if small_enough(keys) else rows


#: Rows of one key in a block of a sparse product.
BLOCK_ROWS = 100_000


def blocked_join(small: DataFrame, large: DataFrame, key: str, spread: str, rows: int | None = None) -> DataFrame:
    """Join on ``key`` in blocks: a key with more than ``rows`` rows in ``large`` is cut by a hash of ``spread``, and
    its rows in ``small`` are repeated for each of its blocks.  A hot item or user is split by construction."""
    rows = rows or BLOCK_ROWS
    hot = (large.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / rows).cast("int").alias("_n")).filter("_n > 1"))
    hot = broadcast_if_small(cut_lineage(hot), "hot keys")          # one key per ``rows`` rows at most
    count = F.coalesce("_n", F.lit(1))
    left = small.join(hot, key, "left").withColumn("_b", F.explode(F.sequence(F.lit(0), count - 1))).drop("_n")
    right = large.join(hot, key, "left").withColumn("_b", F.pmod(F.xxhash64(spread), count).cast("int")).drop("_n")
    return left.join(right, [key, "_b"]).drop("_b")


def user_similarity(cells: DataFrame, metric: str = "cosine", users: DataFrame | None = None) -> DataFrame:
    """Similarity of each target user u to every user v sharing an item.

    cosine   sum(x_u x_v) / (|x_u| |x_v|); a zero user gets 0; self-similarity included
    jaccard  sum(b_u b_v) / |b_u or b_v| over integer-cast cells; 0/0 -> null
    Pairs with no shared non-zero item have similarity 0 and are not stored.
    """
    left = _targets(cells, users)
    if metric == "cosine":
        nz = cells.filter(F.col("x") != 0).select("reviewer", "name", "x")
        l = left.filter(F.col("x") != 0).select(F.col("reviewer").alias("u"), "name", F.col("x").alias("xu"))
        if users is not None:      # only cells of the targets' items meet them, and only their users need a norm
            near = _only(nz, l, "name")
            nz = _only(nz, near, "reviewer")
        else:
            near = nz
        r = near.select(F.col("reviewer").alias("v"), "name", F.col("x").alias("xv"))
        dots = blocked_join(l, r, "name", "v").groupBy("u", "v").agg(F.sum(F.col("xu") * F.col("xv")).alias("dot"))
        norms = nz.groupBy("reviewer").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("n"))
        nu = norms.select(F.col("reviewer").alias("u"), F.col("n").alias("nu"))
        nv = norms.select(F.col("reviewer").alias("v"), F.col("n").alias("nv"))
        return (dots.join(nu, "u").join(nv, "v")
                .select("u", "v", (F.col("dot") / (F.col("nu") * F.col("nv"))).alias("sim")))
    if metric == "jaccard":
        b = cells.select("reviewer", "name", F.col("x").cast("int").alias("b")).filter(F.col("b") != 0)
        l = _targets(b, users).select(F.col("reviewer").alias("u"), "name", F.col("b").alias("bu"))
        near = b
        if users is not None:
            near = _only(b, l, "name")
            b = _only(b, near, "reviewer")
        r = near.select(F.col("reviewer").alias("v"), "name", F.col("b").alias("bv"))
        inter = blocked_join(l, r, "name", "v").groupBy("u", "v").agg(
            F.sum(F.col("bu") * F.col("bv")).alias("both"), F.count(F.lit(1)).alias("n_both"))
        sizes = b.groupBy("reviewer").agg(F.count(F.lit(1)).alias("n"))
        su = sizes.select(F.col("reviewer").alias("u"), F.col("n").alias("nu"))
        sv = sizes.select(F.col("reviewer").alias("v"), F.col("n").alias("nv"))
        return (inter.join(su, "u").join(sv, "v").select(
            "u", "v", F.try_divide(F.col("both").cast("double"),
                                   (F.col("nu") + F.col("nv") - F.col("n_both")).cast("double")).alias("sim")))
    raise ValueError(f"unknown metric {metric!r}")


def neighbours(sim: DataFrame, k: int = 5, include_self: bool = True) -> DataFrame:
    """the k most similar users per user (ties by neighbour name; null similarity last)."""
    s = sim if include_self else sim.filter(F.col("u") != F.col("v"))
    w = Window.partitionBy("u").orderBy(F.col("sim").desc_nulls_last(), F.col("v"))
    return s.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= k)


def predict(cells: DataFrame, sim: DataFrame, items: DataFrame | None = None, mode: str = "plain") -> DataFrame:
    """predicted cell values for the users on the left of ``sim``.

    plain       pred = sum_v sim * x_v,i / (sum_v |sim| + 1e-8)
    mean_added  pred = m_u + sum_v sim * (r_v,i - m_v) / (sum_v |sim| + 1e-8), where an
                unrated cell enters as (0 - m_v); expanded as
                sum_v sim * r_v,i - sum_v sim * m_v so it stays sparse.
    ``items`` (reviewer, name) restricts which cells are predicted.  Plain: cells
    without a rated neighbour are 0 and left out.  Mean-added: such cells all have the
    value m_u - c_u / den of their user; with ``items`` they are filled in, without it one
    row per user whose name is null stands for every item that isn't listed.
    """
    den = sim.groupBy("u").agg((F.sum(F.abs("sim")) + F.lit(CF_EPS)).alias("den"))
    c = _only(cells.select(F.col("reviewer").alias("v"), "name", "x", "r"), sim, "v")
    if items is not None:
        need = items.select("name").distinct()
        c = c.join(need, "name", "left_semi")
    val = F.col("x") if mode == "plain" else F.col("r")
    num = (blocked_join(sim, c, "v", "name").groupBy(F.col("u"), F.col("name"))
           .agg(F.sum(F.col("sim") * val).alias("num")))
    if items is not None:
        num = num.join(items.select(F.col("reviewer").alias("u"), "name").distinct(), ["u", "name"], "left_semi")
    out = num.join(den, "u")
    if mode == "plain":
        return out.select(F.col("u").alias("reviewer"), "name", (F.col("num") / F.col("den")).alias("pred"))
    if mode == "mean_added":
        raters = sim.select(F.col("u").alias("reviewer")).unionByName(sim.select(F.col("v").alias("reviewer")))
        means = (_only(cells.filter(F.col("r") != 0), raters, "reviewer")
                 .groupBy("reviewer").agg(F.avg("r").alias("m")))
        mv = means.select(F.col("reviewer").alias("v"), F.col("m").alias("mv"))
        sm = sim.join(mv, "v").groupBy("u").agg(F.sum(F.col("sim") * F.col("mv")).alias("smv"))
        mu = means.select(F.col("reviewer").alias("u"), F.col("m").alias("mu"))
        per_user = (den.join(sm, "u", "left").join(mu, "u", "left")
                    .select("u", "den", F.coalesce("mu", F.lit(0.0)).alias("mu"), F.coalesce("smv", F.lit(0.0)).alias("smv")))
        if items is None:
            listed = num.select("u", "name", "num").unionByName(
                per_user.select("u", F.lit(None).cast("string").alias("name"), F.lit(0.0).alias("num")))
        else:
            asked = items.select(F.col("reviewer").alias("u"), "name").distinct()
            listed = asked.join(num, ["u", "name"], "left").select("u", "name", F.coalesce("num", F.lit(0.0)).alias("num"))
        return listed.join(per_user, "u").select(
            F.col("u").alias("reviewer"), "name",
            (F.col("mu") + (F.col("num") - F.col("smv")) / F.col("den")).alias("pred"))
    raise ValueError(f"unknown mode {mode!r}")


def cf_scores(train: DataFrame, users: DataFrame, items: DataFrame | None = None,
              scale: str = "midpoint", cells: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """CF part of the hybrid: (predictions for the given users, beta for them)."""
    cells = cells if cells is not None else write_once(utility(train, scale), "cells")      # read several times below
    sim = write_once(user_similarity(cells, "cosine", users), "sim")      # read for the sums and for the weights: written once
    pred = predict(cells, sim, items)
    betas = user_betas(_targets(cells, users))
    return pred, betas


def recommend_cf(train: DataFrame, users: DataFrame, n: int | None = 20, scale: str = "midpoint",
                 cells: DataFrame | None = None) -> DataFrame:
    """F13 / plan D: the n best items for each known target user, as in the dense ranking.

    In the dense form every item has a score; items without a non-zero
    prediction score exactly 0.  Ranking is (score desc, name).  The sparse
    form ranks the positive predictions, fills with zero-score items in name
    order, then negative predictions - without building the user x item grid.
    Rated items are not removed.  Unknown users get no rows.
    """
    cells = cells if cells is not None else write_once(utility(train, scale), "cells")      # read several times below
    sim = write_once(user_similarity(cells, "cosine", users), "sim")
    # targets x items at most; reused by several steps below, so written once
    pred = write_once(predict(cells, sim).filter(F.col("pred") != 0), "pred")
    known = _targets(cells, users).select("reviewer").distinct()
    all_names = write_once(cells.select("name").distinct(), "names")
    n_items = all_names.count()   # one scalar

    n = n_items if n is None else n
    stats = known.join(pred.groupBy("reviewer").agg(
        F.count_if(F.col("pred") > 0).alias("n_pos"), F.count(F.lit(1)).alias("nnz")), "reviewer", "left"
    ).fillna(0, ["n_pos", "nnz"]).withColumn("n_zero", F.lit(n_items) - F.col("nnz"))

    w = Window.partitionBy("reviewer").orderBy(F.col("collab_score").desc(), F.col("name"))
    scored = pred.select("reviewer", "name", F.col("pred").alias("collab_score"))
    pos = (scored.filter(F.col("collab_score") > 0).withColumn("rank", F.row_number().over(w))
           .filter(F.col("rank") <= n))

    # zero-score items for users with fewer than n positives: of the first n + nnz names in order,
    # n at least aren't predicted.  The names are numbered once and met by position.
    from ..sources.io import with_surrogate_key
    short = stats.filter(F.col("n_pos") < n)
    names = with_surrogate_key(all_names.sort("name"), "pos")
    asked = (short.withColumn("upto", F.least(F.lit(n_items).cast("long"), F.col("nnz") + F.lit(n)))
             .filter(F.col("upto") > 0)
             .select("reviewer", "n_pos", F.explode(F.sequence(F.lit(0).cast("long"), F.col("upto") - 1)).alias("pos")))
    free = (asked.join(names, "pos").join(pred.select("reviewer", "name"), ["reviewer", "name"], "left_anti"))
    by_name = Window.partitionBy("reviewer").orderBy("pos")
    zeros = (free.withColumn("i", F.row_number().over(by_name)).withColumn("rank", F.col("n_pos") + F.col("i"))
             .filter((F.col("i") <= n) & (F.col("rank") <= n))
             .select("reviewer", "name", F.lit(0.0).alias("collab_score"), "rank"))

    # negative predictions only when positives and zeros do not fill n places
    need_neg = stats.filter(F.col("n_pos") + F.col("n_zero") < n).select("reviewer", "n_pos", "n_zero")
    neg = (scored.filter(F.col("collab_score") < 0).join(need_neg, "reviewer")
           .withColumn("rank", F.row_number().over(w) + F.col("n_pos") + F.col("n_zero"))
           .filter(F.col("rank") <= n).select("reviewer", "name", "collab_score", "rank"))
    return pos.unionByName(zeros).unionByName(neg).withColumn("rank", F.col("rank").cast("long"))


def zero_share(cells: DataFrame, pred: DataFrame, users: DataFrame | None = None) -> DataFrame:
    """F16: percent of items whose prediction is exactly 0, per user; beta_linear from it.

    ``users``: the users that predictions were asked for; those of them who have cells but
    no prediction other than 0 show 100 percent.
    """
    n_items = cells.select("name").distinct().count()
    nz = pred.groupBy("reviewer").agg(F.count_if(F.col("pred") != 0).alias("nz"))
    if users is not None:
        known = _targets(cells, users.select("reviewer")).select("reviewer").distinct()
        nz = known.join(nz, "reviewer", "left").fillna(0, ["nz"])
    return (nz.withColumn("zero_pct", 100.0 * (1 - F.col("nz") / F.lit(n_items)))
            .withColumn("beta", beta_linear("zero_pct")).select("reviewer", "zero_pct", "beta"))


#: Bins of a round, and values of one bin that are taken out to be sorted.
BINS, FEW = 256, 4096


def order_statistics(df: DataFrame, col: str, ranks: list[int]) -> dict[int, float]:
    """The values at 0-based ranks of the sorted column (nulls and NaN left out), by repeated refinement of a histogram.

    A round counts the values of the interval of each rank in BINS bins (partial counts; count, least and largest
    value per bin) and goes on inside the bin that holds the rank, narrowed to its values.  It ends when
    the bin has one distinct value or at most FEW values, which are sorted.  No task holds more than that.
    """
    values = df.select(F.col(col).cast("double").alias("v")).filter("v is not null and not isnan(v)")
    ends = values.agg(F.min("v"), F.max("v")).collect()[0]
    todo, done = {r: (ends[0], ends[1], 0, None) for r in set(ranks)}, {}       # interval, ranks below it, its size
    while todo:
        for r, (lo, hi, below, n) in list(todo.items()):
            if lo == hi:
                done[r] = lo
                del todo[r]
            elif n is not None and n <= FEW:
                got = sorted(x["v"] for x in values.filter((F.col("v") >= lo) & (F.col("v") <= hi)).limit(FEW).collect())
                done[r] = got[r - below]
                del todo[r]
        spans = sorted({(lo, hi) for lo, hi, _, _ in todo.values()})
        if not spans:
            break
        # scaled before the difference: the width of an interval may not fit a double
        place = F.array(*[F.when((F.col("v") >= lo) & (F.col("v") <= hi), F.struct(
            F.lit(k).alias("k"), F.least(F.floor((F.col("v") / 4 - lo / 4) / (hi / 4 - lo / 4) * BINS), F.lit(BINS - 1)).alias("bin")))
            for k, (lo, hi) in enumerate(spans)])
        counts = (values.select("v", F.explode(place).alias("p")).filter("p is not null").groupBy("p.k", "p.bin")
                  .agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect())
        for r, (lo, hi, below, _) in list(todo.items()):
            mine = sorted((c["bin"], c["n"], c["lo"], c["hi"]) for c in counts if c["k"] == spans.index((lo, hi)))
            for _, n, least, most in mine:
                if r < below + n:
                    todo[r] = (least, most, below, n)
                    break
                below += n
    return done


def quantiles(df: DataFrame, col: str, shares: list[float]) -> list[float | None]:
    """Exact quantiles, linear between neighbouring values; None for a column without values."""
    n = df.select(F.col(col).cast("double").alias("v")).filter("v is not null and not isnan(v)").count()
    if not n:
        return [None] * len(shares)
    at = [p * (n - 1) for p in shares]
    known = order_statistics(df, col, [int(a) for a in at] + [min(int(a) + 1, n - 1) for a in at])
    out = []
    for a in at:
        low, high = known[int(a)], known[min(int(a) + 1, n - 1)]
        out.append(low if a == int(a) else low * (1 - (a - int(a))) + high * (a - int(a)))
    return out


def describe(df: DataFrame, col: str) -> DataFrame:
    """count, mean, std, min, quartiles, max of a column; quartiles by ``quantiles``."""
    c = F.col(col)
    q = [F.lit(v).cast("double") for v in quantiles(df, col, [0.25, 0.5, 0.75])]
    return df.agg(
        F.count(c).alias("count"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).alias("min"),
        F.max(c).alias("max")).select("count", "mean", "std", "min", q[0].alias("p25"), q[1].alias("p50"), q[2].alias("p75"), "max")


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """frequency table (order by count desc, then value)."""
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("count"))
