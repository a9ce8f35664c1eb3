"""Cleaning, projection and filters.

``preprocess`` is the reference's three-stage clean-up: keep the first copy of
each (name, reviewer, text), drop rows whose rating is not a number,
drop rows whose abv (a percent string) is not a number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.sizing import small_enough
from ..session import write_once

DEDUPE_KEYS = ("name", "reviewer", "text_hash")      # with_text_hash gives the last from review_text

# a plain decimal or exponent number, optional sign and surrounding blanks
NUMBER_PATTERN = r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$"


def with_text_hash(df: DataFrame, text: str = "review_text") -> DataFrame:
    """The hash that stands for the review text in keys: long texts are neither grouped by nor shuffled as keys."""
    return df if "text_hash" in df.columns else df.withColumn("text_hash", F.md5(text))


#: Hashes of repeated keys (a number each) that every task may hold.
SHARED_KEYS = 8_000_000


def dedupe_first(df: DataFrame, keys=DEDUPE_KEYS, order: str = "id", apart: bool = False) -> DataFrame:
    """Keep the row with the smallest ``order`` value per key.

    Written as ``min(struct(order, rest...))`` per key: a partial aggregate, so a
    key with a huge number of copies is combined map-side before the shuffle
    instead of being sorted in one window task.

    ``apart``: the rows are written once, and the hashes of their keys are counted.  A row whose hash comes once
    is the only one of its key and stays where it lies; only the others are moved.
    """
    columns, df = df.columns, with_text_hash(df) if "text_hash" in keys else df
    out = dedupe_written(write_once(df, "rows"), keys, order) if apart else _dedupe(df, list(keys), order)
    return out.select(*columns)


def split_copies(rows: DataFrame, keys: list) -> tuple[DataFrame | None, DataFrame]:
    """(rows whose key comes once, rows whose key may come again) of written rows, which are read twice.

    Only a hash of each key is moved.  With too many repeated keys the first is None and the second holds all rows.
    """
    key_hash = F.xxhash64(*keys).alias("_hash")
    shared = write_once(rows.select(key_hash).groupBy("_hash").agg(F.count(F.lit(1)).alias("_n"))
                        .filter("_n > 1").select("_hash"), "shared")
    if not small_enough(shared, SHARED_KEYS):
        return None, rows
    hashed = rows.select("*", key_hash)
    return (hashed.join(F.broadcast(shared), "_hash", "left_anti").drop("_hash"),
            hashed.join(F.broadcast(shared), "_hash", "left_semi").drop("_hash"))


def dedupe_written(rows: DataFrame, keys=DEDUPE_KEYS, order: str = "id") -> DataFrame:
    """``dedupe_first`` of written rows: those whose key comes once stay where they lie."""
    alone, copies = split_copies(rows, list(keys))
    first = _dedupe(copies, list(keys), order)
    return first if alone is None else alone.unionByName(first)


def _dedupe(df: DataFrame, keys: list, order: str) -> DataFrame:
    rest = [c for c in df.columns if c not in keys and c != order]
    first = F.min(F.struct(F.col(order).alias(order), *[F.col(c) for c in rest])).alias("_first")
    out = df.groupBy(*keys).agg(first)
    return out.select(*keys, *[F.col(f"_first.{c}").alias(c) for c in [order] + rest]).select(*df.columns)


def to_number(c) -> Column:
    """C2 rule: a number written in decimal or exponent form, else null (also drops NaN/inf)."""
    col = F.col(c) if isinstance(c, str) else c
    v = F.when(col.rlike(NUMBER_PATTERN), F.trim(col).try_cast("double"))
    return F.when(~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))), v)


def coerce_numeric(df: DataFrame, c: str) -> DataFrame:
    """Parse ``c`` as a number; rows that do not parse are dropped."""
    return df.withColumn(c, to_number(c)).filter(F.col(c).isNotNull())


def percent_number(c, strict: bool = False) -> Column:
    """Strip trailing '%' signs and parse.  ``strict``: '-' means missing, junk raises."""
    col = F.col(c) if isinstance(c, str) else c
    if strict:
        return F.regexp_replace(F.nullif(col, F.lit("-")), "%+$", "").cast("double")
    return to_number(F.regexp_replace(col.cast("string"), "%+$", ""))


def parse_percent(df: DataFrame, c: str, strict: bool = False) -> DataFrame:
    out = df.withColumn(c, percent_number(c, strict))
    return out if strict else out.filter(F.col(c).isNotNull())


def preprocess(df: DataFrame, apart: bool = False) -> DataFrame:
    """C1-C3 in the reference's order."""
    return parse_percent(coerce_numeric(dedupe_first(df, apart=apart), "rating"), "abv")


def stage_counts(df: DataFrame) -> DataFrame:
    """Rows after each cleaning stage, as one small table (one scan, one aggregate).

    The three stages are nested filters over the de-duplicated rows, so their
    sizes come from conditional counts in a single pass; the raw size is the sum
    of the copies of each key.
    """
    keyed = with_text_hash(df)
    d = (keyed.groupBy(*DEDUPE_KEYS).agg(F.min(F.struct("id", "rating", "abv")).alias("f"), F.count(F.lit(1)).alias("n"))
         .select("n", "f.rating", "f.abv"))
    rating_ok = to_number("rating").isNotNull()
    abv_ok = percent_number("abv").isNotNull()
    counts = d.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("raw"),
        F.count(F.lit(1)).alias("deduped"),
        F.count_if(rating_ok).alias("rating_ok"),
        F.count_if(rating_ok & abv_ok).alias("abv_ok"),
    )
    stages = F.array(*[F.struct(F.lit(step).alias("step"), F.lit(stage).alias("stage"), F.col(c).alias("rows"))
                       for step, (stage, c) in enumerate((("raw", "raw"), ("drop_duplicates", "deduped"),
                                                          ("drop_rating_na", "rating_ok"), ("drop_abv_na", "abv_ok")))])
    return counts.select(F.explode(stages).alias("s")).select("s.step", "s.stage", F.col("s.rows").cast("long").alias("rows"))


def fill_defaults(df: DataFrame, text_cols=("review_text",), num_cols=("abv",)) -> DataFrame:
    """Missing text -> '', missing numbers -> 0."""
    return df.na.fill("", list(text_cols)).na.fill(0.0, list(num_cols))


def distinct_on(df: DataFrame, cols) -> DataFrame:
    """C7."""
    return df.select(*cols).distinct()


def item_info(df: DataFrame) -> DataFrame:
    """Item dimension, first row (by id) per item name."""
    first = F.min(F.struct("id", "abv", "subgenre", "average_rating")).alias("f")
    return df.groupBy("name").agg(first).select(
        "name", F.col("f.abv").alias("abv"), F.col("f.subgenre").alias("subgenre"),
        F.col("f.average_rating").alias("average_rating"))


def count_equal(df: DataFrame, col: str, value) -> DataFrame:
    """Number of rows with ``col == value`` (as a one-row table)."""
    return df.agg(F.count_if(F.col(col) == F.lit(value)).alias("n"))
