"""Language filter (C11, C12), re-aimed from a per-text library to Spark jobs.

C12 profile: character trigrams of lower-cased text, counted per language;
    the ``top`` most frequent per language (ties by gram) with
    log P(gram | language) = ln(count / total of the kept grams).
C11 detection: every distinct text (stripped length > 3) once: sum over its
    trigrams of log P, a gram outside a language's profile counting a fixed
    floor; the best language wins (ties: larger code), no profile gram at all
    gives "unknown"; short or missing texts get null and drop out of the filter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

N_GRAM = 3
TOP_GRAMS = 300
LOG_FLOOR = -12.0            # log probability of a gram outside a profile
UNKNOWN = "unknown"


def char_grams(text: str, n: int = N_GRAM) -> Column:
    """All overlapping n-grams (code points) of a column, in one linear regex scan:
    a zero-width look-ahead captures the n characters at every position.
    (Indexing with ``substring`` per position would rescan the string each time.)"""
    return F.regexp_extract_all(F.col(text), F.lit(f"(?s)(?=(.{{{n}}}))"), 1)


def train_language_profile(df: DataFrame, text: str = "text", lang: str = "lang", n: int = N_GRAM,
                           top: int = TOP_GRAMS) -> DataFrame:
    """(lang, gram, n, logp) - whole texts, counted map-side before the shuffle."""
    low = df.select(F.col(lang).alias("lang"), F.lower(text).alias("_lt"))
    grams = low.select("lang", F.explode(char_grams("_lt", n)).alias("gram"))
    counts = grams.groupBy("lang", "gram").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("lang").orderBy(F.col("n").desc(), F.col("gram"))
    kept = counts.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= top).drop("r")
    tot = kept.groupBy("lang").agg(F.sum("n").alias("t"))
    return kept.join(tot, "lang").select("lang", "gram", "n", F.ln(F.col("n") / F.col("t")).alias("logp"))


def detect_language(df: DataFrame, profile: DataFrame, text: str = "review_text", out: str = "language",
                    n: int = N_GRAM) -> DataFrame:
    """C11: add the detected language of ``text`` (null for short or missing texts)."""
    ok = F.col(text).isNotNull() & (F.length(F.trim(F.col(text))) > 3)
    texts = df.filter(ok).select(F.md5(text).alias("_k"), text).distinct()
    g = texts.select("_k", F.lower(text).alias("_lt")).select("_k", char_grams("_lt", n).alias("_g"))
    # a text's trigrams meet the profile (languages x TOP_GRAMS rows) where the text lies and are summed there:
    # a row per text and language is shuffled, none per trigram
    prof = F.broadcast(profile.select("lang", "gram", (F.col("logp") - LOG_FLOOR).alias("delta")))
    sums = (g.select("_k", F.size("_g").alias("n_total"), F.explode("_g").alias("gram")).join(prof, "gram")
            .groupBy("_k", "lang").agg(F.sum("delta").alias("s"), F.first("n_total").alias("n_total")))
    best = (sums.withColumn("score", F.col("s") + F.col("n_total") * LOG_FLOOR)
            .groupBy("_k").agg(F.max(F.struct(F.round("score", 9).alias("score"), F.col("lang").alias("lang"))).alias("b"))
            .select("_k", F.col("b.lang").alias("_lang")))
    keyed = df.withColumn("_k", F.when(ok, F.md5(text)))
    return (keyed.join(best, "_k", "left")
            .withColumn(out, F.when(ok, F.coalesce("_lang", F.lit(UNKNOWN))))
            .drop("_k", "_lang"))


def keep_language(df: DataFrame, code: str = "en", col: str = "language") -> DataFrame:
    return df.filter(F.col(col) == code)
