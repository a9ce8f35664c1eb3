"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

1. Each source's documents are shuffled (ordered by a hash of seed, doc_id and text)
   and laid end to end; the stream is cut into equal blocks of at most BLOCK words.
   A long document lies in many blocks, short ones share a block.
2. A source's target in words becomes a number of block draws.  Slot n of the mix is
   the point n / golden ratio (mod 1, as a 31-bit integer), mapped through the
   cumulated draws of the sources: at every length the mix is near its weights.
3. Slots are ranked per source; rank r draws block r mod (number of blocks), so a
   source is read through once before anything of it is repeated, and EPOCHS times at
   most.
4. A document's taken words are the words of its blocks times their draws.

Running sums are two-level (within hash ranges or chunks of slots, then over these),
so a source that holds a third of all rows is never one window.  Only the table of
sources (a row for each) is ordered as a whole.

Defined results: a null text has size 0 and is never taken; a null source is a
source of its own, after all others; rows that share doc_id and text are separate
rows; no rows or no words give no slots, and every target is 0; other columns are not
looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship_package
from . import common as C

BLOCK, EPOCHS, SEED = 128, 3, "mix-1"
#: Points are 31-bit integers; GOLDEN is the odd number nearest to 2**31 / golden ratio.
POINTS, GOLDEN = 2**31, 1327217885
#: Ranges of points that slots and sources are joined by, and slots that are ranked together.
BINS, CHUNK = 4096, 65536


def _place(doc_id: Column, text: Column) -> Column:
    """Where a document stands in the shuffled order of its source."""
    return F.md5(F.concat(F.lit(SEED + "|"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("|"),
                          F.coalesce(text, F.lit(""))).cast("binary"))


def sizes(docs: DataFrame) -> DataFrame:
    """row_id, doc_id, source, size, and the place in the shuffled order of the source."""
    text = F.coalesce("text", F.lit(""))
    return C.written(docs.select(
        F.monotonically_increasing_id().alias("row_id"), F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.regexp_count(text, F.lit(C.WORD)).cast("long").alias("size"),
        _place(F.col("doc_id"), F.col("text")).alias("place")), "sizes")


def targets(sized: DataFrame) -> DataFrame:
    """One row per source: number, size, target in words, blocks and draws.

    Shares go by weight (1, 2, 3, repeating by source); a target stops at EPOCHS times
    the source's size and the rest is shared again.  In the order of cap by weight the
    capped sources come first, so running sums find the final share at once.
    """
    every = Window.partitionBy()
    by_name = Window.orderBy(F.asc_nulls_last("source"))
    by_cap = Window.orderBy("fill", "src").rowsBetween(Window.unboundedPreceding, -1)
    s = (sized.groupBy("source").agg(F.sum("size").alias("source_size"))
         .withColumn("src", F.row_number().over(by_name) - 1)
         .withColumn("weight", F.col("src") % 3 + 1)
         .withColumn("fill", F.expr("source_size * (6 div weight)")))
    big = "decimal(38,0)"
    s = (s.withColumn("total", F.sum("source_size").over(every)).withColumn("weights", F.sum("weight").over(every))
         .withColumn("rest", F.col("total") - EPOCHS * F.coalesce(F.sum("source_size").over(by_cap), F.lit(0)))
         .withColumn("rest_weight", F.col("weights") - F.coalesce(F.sum("weight").over(by_cap), F.lit(0)))
         .withColumn("capped", F.col("rest").cast(big) * F.col("weight").cast(big)
                     >= F.col("source_size").cast(big) * EPOCHS * F.col("rest_weight").cast(big)))
    free = F.when(~F.col("capped"), F.lit(1))
    s = (s.withColumn("free_weight", F.sum(free * F.col("weight")).over(every))
         .withColumn("free_words", F.col("total")
                     - EPOCHS * F.coalesce(F.sum(F.when(F.col("capped"), F.col("source_size"))).over(every), F.lit(0)))
         .withColumn("target", F.when(F.col("capped"), (EPOCHS * F.col("source_size")).cast("double"))
                     .otherwise((F.col("weight") * F.col("free_words")).cast("double")
                                / F.col("free_weight").cast("double")))
         .withColumn("blocks", F.expr(f"(source_size + {BLOCK - 1}) div {BLOCK}"))
         .withColumn("draws", F.when(F.col("source_size") > 0, F.floor(
             F.col("target") * F.col("blocks").cast("double") / F.col("source_size").cast("double") + F.lit(0.5)))
             .otherwise(F.lit(0)).cast("long")))
    upto = Window.orderBy("src").rowsBetween(Window.unboundedPreceding, 0)
    s = s.withColumn("slots", F.sum("draws").over(every)).withColumn("upto", F.sum("draws").over(upto))
    point = f"cast(cast({{}} as {big}) * {POINTS} div nullif(slots, 0) as long)"
    return s.select("src", "source", "source_size", "target", "blocks", "draws", "slots",
                    F.expr(point.format("(upto - draws)")).alias("lo"), F.expr(point.format("upto")).alias("hi"),
                    F.expr("source_size div nullif(blocks, 0)").alias("base"),
                    F.expr("source_size % nullif(blocks, 0)").alias("longer"))


def schedule(sources: DataFrame) -> DataFrame:
    """slot, src, rank (of the slot among the source's), block: what is read when."""
    spark = sources.sparkSession
    slots = sources.agg(F.coalesce(F.max("slots"), F.lit(0))).first()[0]
    width = POINTS // BINS
    at = (spark.range(slots).withColumnRenamed("id", "slot")
          .withColumn("point", F.expr(f"(slot % {POINTS}) * {GOLDEN} % {POINTS}"))
          .withColumn("bin", F.expr(f"point div {width}")))
    spread = sources.filter("hi > lo").select(
        "src", "lo", "hi", "blocks", F.explode(F.expr(f"sequence(lo div {width}, (hi - 1) div {width})")).alias("bin"))
    drawn = (at.join(spread, "bin").filter("point >= lo and point < hi")
             .select("slot", "src", "blocks", F.expr(f"slot div {CHUNK}").alias("chunk")))
    before = Window.partitionBy("src").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    start = (drawn.groupBy("src", "chunk").agg(F.count(F.lit(1)).alias("n"))
             .select("src", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")))
    inside = Window.partitionBy("src", "chunk").orderBy("slot")
    return (drawn.withColumn("i", F.row_number().over(inside)).join(start, ["src", "chunk"])
            .withColumn("rank", F.col("start") + F.col("i") - 1)
            .filter(F.col("rank") < EPOCHS * F.col("blocks"))
            .select("slot", "src", "rank", (F.col("rank") % F.col("blocks")).alias("block")))


def mix(docs: DataFrame) -> DataFrame:
    """row_id, doc_id, source, size, source_size, target, taken: one row per document."""
    sized = sizes(docs)
    sources = C.written(targets(sized), "sources")
    s = sources.select("src", F.col("source").alias("_s"), "source_size", "target", "blocks", "base", "longer")
    rows = sized.join(s, F.col("source").eqNullSafe(F.col("_s"))).withColumn(
        "range", F.conv(F.substring("place", 1, 3), 16, 10).cast("int"))
    before = Window.partitionBy("src").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    start = (rows.groupBy("src", "range").agg(F.sum("size").alias("n"))
             .select("src", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")))
    inside = (Window.partitionBy("src", "range").orderBy("place", "doc_id", "row_id")
              .rowsBetween(Window.unboundedPreceding, -1))
    placed = (rows.filter("size > 0")
              .withColumn("i", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(start, ["src", "range"])
              .withColumn("a", F.col("start") + F.col("i")).withColumn("b", F.expr("a + size")))
    block = ("if({0} < longer * (base + 1), {0} div (base + 1),"
             " longer + ({0} - longer * (base + 1)) div base)")
    begin = "({0} * base + least({0}, longer))"
    pieces = (placed.withColumn("first", F.expr(block.format("a"))).withColumn("last", F.expr(block.format("(b - 1)")))
              .select("row_id", "src", "a", "b", "base", "longer", F.explode(F.expr("sequence(first, last)")).alias("block"))
              .withColumn("words", F.expr(f"least(b, {begin.format('(block + 1)')}) - greatest(a, {begin.format('block')})")))
    drawn = schedule(sources).groupBy("src", "block").agg(F.count(F.lit(1)).alias("times"))
    taken = (pieces.select("row_id", "src", "block", "words").join(drawn, ["src", "block"])
             .groupBy("row_id").agg(F.sum(F.col("words") * F.col("times")).alias("taken")))
    return rows.join(taken, "row_id", "left").select(
        "row_id", "doc_id", "source", "place", "size", "source_size", "target",
        F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mix_query(spark, sf_dir: str) -> DataFrame:
    return mix(C.table(spark, sf_dir, "documents")).drop("row_id", "source", "place")


def _first_words(batches):
    """Columns of documents and a number of words -> columns of documents, texts cut after these words (null: whole)."""
    for rb in batches:
        names = rb.schema.names[:-1]
        text, k = rb.column(names.index("text")), rb.column(len(names))
        todo = np.flatnonzero(np.asarray(k.is_valid()))
        if len(todo):
            at, new = pa.array(todo), text.to_pylist()
            want = np.asarray(k.take(at))
            for s in C.slices(text.take(at).cast(pa.binary())):
                w = C.words(s)
                for i in range(s.rows()):
                    end = w.ends[w.offs[i] + want[s.lo + i] - 1]
                    new[todo[s.lo + i]] = s.buf[s.offs[i]:end].tobytes().decode()
            text = pa.array(new, type=text.type)
            if "n_chars" in names:
                c = names.index("n_chars")
                size = rb.column(c).to_pylist()
                for i in todo:
                    size[i] = size[i] if size[i] is None else len(new[i])
                rb = rb.set_column(c, rb.schema.field(c), pa.array(size, type=rb.column(c).type))
        yield pa.RecordBatch.from_arrays([text if c == "text" else rb.column(i) for i, c in enumerate(names)], names=names)


def mix_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The taken words as rows: whole copies of a document, and its first words for what is over (n_chars follows).

    A source's blocks are read from the first one on, so those that are drawn once more than
    the others come first: of a document, they hold its first words.  Rows that share doc_id,
    source and text share their taken words evenly.  Empty texts aren't taken.
    """
    ship_package(spark)
    taken = mix(docs).groupBy(F.col("doc_id").alias("_d"), F.col("place").alias("_p"), F.col("source").alias("_s")).agg(
        F.max("size").alias("_size"), F.expr("sum(taken) div count(*)").alias("_n")).filter("_n > 0")
    taken = taken.select("_d", "_p", "_s", F.expr(
        "concat(array_repeat(-1L, int(_n div greatest(_size, 1))), filter(array(_n % greatest(_size, 1)), x -> x > 0))").alias("_parts"))
    own = [docs[c] for c in docs.columns]
    joined = docs.join(taken, (_place(docs["doc_id"], docs["text"]) == taken["_p"])
                       & docs["doc_id"].cast("long").eqNullSafe(taken["_d"])
                       & docs["source"].cast("string").eqNullSafe(taken["_s"]))
    parts = joined.select(*own, F.explode(taken["_parts"]).alias("_words"))
    cut = F.when(F.col("_words") > 0, F.col("_words"))
    return parts.select(*[parts[k] for k in range(len(own))], cut.alias("_words")).mapInArrow(_first_words, docs.schema)


SQL = rf"""
WITH z AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) size,
   md5('{SEED}|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(text, '')) place FROM documents),
s1 AS (SELECT source, CAST(sum(size) AS BIGINT) source_size FROM z GROUP BY source),
s2 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 src FROM s1),
s3 AS (SELECT *, src % 3 + 1 weight, source_size * (6 // (src % 3 + 1)) fill FROM s2),
s4 AS (SELECT *, sum(source_size) OVER () total, sum(weight) OVER () weights,
   sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER p, 0) rest,
   sum(weight) OVER () - coalesce(sum(weight) OVER p, 0) rest_weight
   FROM s3 WINDOW p AS (ORDER BY fill, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s5 AS (SELECT *, rest * weight >= source_size * 3 * rest_weight capped FROM s4),
s6 AS (SELECT *, sum(CASE WHEN NOT capped THEN weight END) OVER () free_weight,
   total - 3 * coalesce(sum(CASE WHEN capped THEN source_size END) OVER (), 0) free_words FROM s5),
s7 AS (SELECT *, CASE WHEN capped THEN CAST(3 * source_size AS DOUBLE)
   ELSE CAST(weight * free_words AS DOUBLE) / CAST(free_weight AS DOUBLE) END target,
   (source_size + {BLOCK - 1}) // {BLOCK} blocks FROM s6),
s8 AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target * CAST(blocks AS DOUBLE)
   / CAST(source_size AS DOUBLE) + CAST(0.5 AS DOUBLE)) AS BIGINT) ELSE 0 END draws FROM s7),
s9 AS (SELECT *, sum(draws) OVER () slots, sum(draws) OVER (ORDER BY src) upto FROM s8),
src AS (SELECT *, (upto - draws) * {POINTS}::HUGEINT // slots lo, upto * {POINTS}::HUGEINT // slots hi,
   source_size // blocks base, source_size % blocks longer FROM s9 WHERE source_size > 0),
slot AS (SELECT n, (n % {POINTS}) * {GOLDEN} % {POINTS} point
   FROM (SELECT unnest(range(CAST((SELECT max(slots) FROM s9) AS BIGINT))) n)),
drawn AS (SELECT src, blocks, row_number() OVER (PARTITION BY src ORDER BY n) - 1 r
   FROM slot JOIN src ON point >= lo AND point < hi),
times AS (SELECT src, r % blocks block, count(*) times FROM drawn WHERE r < 3 * blocks GROUP BY ALL),
a AS (SELECT z.doc_id, z.place, z.size, src.*, coalesce(sum(z.size) OVER (PARTITION BY src.src ORDER BY z.place, z.doc_id
   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) a
   FROM z JOIN src ON z.source IS NOT DISTINCT FROM src.source),
p AS (SELECT *, a + size b, CASE WHEN a < longer * (base + 1) THEN a // (base + 1)
   ELSE longer + (a - longer * (base + 1)) // base END f, CASE WHEN a + size - 1 < longer * (base + 1)
   THEN (a + size - 1) // (base + 1) ELSE longer + (a + size - 1 - longer * (base + 1)) // base END l FROM a WHERE size > 0),
q AS (SELECT *, unnest(range(CAST(f AS BIGINT), CAST(l + 1 AS BIGINT))) block FROM p),
t AS (SELECT q.doc_id, q.place, sum((least(b, (q.block + 1) * base + least(q.block + 1, longer))
   - greatest(a, q.block * base + least(q.block, longer))) * times) taken
   FROM q JOIN times ON times.src = q.src AND times.block = q.block GROUP BY q.doc_id, q.place)
SELECT z.doc_id, z.size, s7.source_size, s7.target, CAST(coalesce(t.taken, 0) AS BIGINT) taken
FROM z JOIN s7 ON z.source IS NOT DISTINCT FROM s7.source
LEFT JOIN t ON t.doc_id = z.doc_id AND t.place = z.place
"""
