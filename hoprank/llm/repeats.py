"""Substring de-duplication over a compacted token de Bruijn graph.

The edges of the graph are the windows of WINDOW consecutive words.  Shuffling every
edge would cost many times the text, so edges travel as paths:

1. Every window holds one anchor: the leftmost of its ANCHOR-word grams with the
   smallest hash.  Consecutive windows with the same anchor form a nonbranching path
   of edges (a super-k-mer), kept as anchor, path hash and source coordinates.  Equal
   windows have equal anchors, so edges can only be equal under one anchor.
2. Paths are counted by (anchor, path) in Spark.  An anchor that occurs once has no
   repeated edge.  An anchor under which one path occurs again and again, and no
   other, is compacted: all its edges are repeated.  Only where several different
   paths share an anchor does the graph branch.
3. The states are joined back to the source coordinates.  Of branching paths, those that
   occur again are repeated as a whole, and one occurrence stands for all; it and the
   single ones are opened into their edges, which are counted under (anchor, window
   hash) - 128 bits - and the edges of single paths are joined back to their coordinates.
4. Repeated windows are joined to spans of words per document, and the words under
   them are removed.

Hot windows are counted with partial aggregates and joined back to their coordinates
with sort-merge joins, which adaptive execution splits; no group is gathered.

Defined results: a null text has no words; windows never cross rows; rows that share
doc_id and text are two copies of each other, so all their windows are repeated; other
columns are not looked at; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

WINDOW, ANCHOR = 35, 10

PATHS = "doc_id long, th long, anchor long, path long, start int, n int"
EDGES = "doc_id long, th long, anchor long, edge long, start int, w int"
KEPT = "doc_id long, n_words long, n_removed long, kept binary"


def _sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    """Index of the leftmost smallest value among the ``width`` values from each position on."""
    at, value, have = np.arange(len(h)), h, 1
    while have < width:
        step = min(have, width - have)
        left, right = slice(0, len(value) - step), slice(step, len(value))
        lower = value[right] < value[left]
        at = np.where(lower, at[right], at[left])
        value = np.where(lower, value[right], value[left])
        have += step
    return at


def paths(s: C.Slice):
    """The super-k-mers of each row: row, anchor hash, path hash, first window, number of windows; and the words."""
    w = C.words(s)
    pos, row = C.gram_rows(w.offs, WINDOW)
    if not len(pos):
        return None, w
    gram = C.grams(w.hash, ANCHOR)
    at = _sliding_min(gram, WINDOW - ANCHOR + 1)[pos]
    new = np.ones(len(pos), dtype=bool)
    new[1:] = (at[1:] != at[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(pos)))
    window = C.grams(w.hash, WINDOW)[pos]
    # a path is told by its windows in order; the anchor's place in the first of them is told by these
    with np.errstate(over="ignore"):
        k = np.arange(len(pos)) - np.repeat(first, n)
        path = C.mix(np.add.reduceat(window * C._pow(WINDOW)[k], first) + n.astype(np.uint64))
    return (row[first], C.mix(gram[at[first]]), path, (pos - w.offs[row])[first], n), w


def _paths(batches):
    for rb in batches:
        for s in C.slices(rb.column("body")):
            found, _ = paths(s)
            if found is not None:
                row, anchor, path, start, n = found
                take = pa.array(row + s.lo)
                yield pa.RecordBatch.from_arrays([
                    rb.column("doc_id").take(take), rb.column("th").take(take), C.int64s(anchor), C.int64s(path),
                    pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32))],
                    names=["doc_id", "th", "anchor", "path", "start", "n"])


def _flat(col: pa.Array):
    """Offsets and the int arrays of a column of lists of (a, b, w)."""
    offs = col.offsets.to_numpy().astype(np.int64)
    return offs, *(col.values.field(k).to_numpy() for k in range(3))


def _edges(batches):
    """Open the branching paths of a text (``spans``: first window, number of windows, weight) into edges."""
    for rb in batches:
        offs, start, n, weight = _flat(rb.column("spans"))
        for s in C.slices(rb.column("body")):
            w = C.words(s)
            a, b = offs[s.lo], offs[s.hi]
            row = np.repeat(np.arange(s.rows()), np.diff(offs[s.lo:s.hi + 1]))
            count = n[a:b].astype(np.int64)
            at = np.repeat(w.offs[row] + start[a:b], count) + np.arange(count.sum()) - np.repeat(
                np.cumsum(count) - count, count)
            row = np.repeat(row, count)
            if not len(at):
                continue
            gram = C.grams(w.hash, ANCHOR)
            anchor = C.mix(gram[_sliding_min(gram, WINDOW - ANCHOR + 1)[at]])
            take = pa.array(row + s.lo)
            yield pa.RecordBatch.from_arrays([
                rb.column("doc_id").take(take), rb.column("th").take(take), C.int64s(anchor),
                C.int64s(C.grams(w.hash, WINDOW)[at]), pa.array((at - w.offs[row]).astype(np.int32)),
                pa.array(np.repeat(weight[a:b], count).astype(np.int32))],
                names=["doc_id", "th", "anchor", "edge", "start", "w"])


def _remove(batches):
    """Words that aren't under a span (first window, number of windows) of the text."""
    for rb in batches:
        spans = rb.column("spans")
        offs, start, n, _ = _flat(spans)
        empty = np.asarray(spans.is_null())
        total, removed, kept = [], [], []
        for i, text in enumerate(rb.column("body")):
            ws = text.as_py().split()
            left = ws
            if not empty[i]:
                cover = np.zeros(len(ws) + 1, dtype=np.int32)
                a = start[offs[i]:offs[i + 1]]
                np.add.at(cover, a, 1)
                np.add.at(cover, a + n[offs[i]:offs[i + 1]] + (WINDOW - 1), -1)
                keep = np.cumsum(cover)[:-1] == 0
                left = [ws[k] for k in np.flatnonzero(keep)]
            kept.append(b" ".join(left))
            total.append(len(ws))
            removed.append(len(ws) - len(left))
        yield pa.RecordBatch.from_arrays([rb.column("doc_id"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()),
                                          C.binary_array(kept)], names=["doc_id", "n_words", "n_removed", "kept"])


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), C.text_key(F.col("text")).alias("th"),
                       C.body(F.col("text")).alias("body"))


def _with_spans(texts: DataFrame, spans: DataFrame, how: str) -> DataFrame:
    """Texts with the distinct spans (start, n, w) of their doc_id and text, as one list per text."""
    own = spans.groupBy(F.col("doc_id").alias("_d"), F.col("th").alias("_t")).agg(
        F.collect_set(F.struct(F.col("start").alias("a"), F.col("n").alias("b"), "w")).alias("spans"))
    return texts.join(own, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("th") == F.col("_t")), how).select(
        "doc_id", "th", "body", "spans")


def repeated_spans(docs: DataFrame) -> DataFrame:
    """doc_id, th, start, n: runs of n repeated windows from window ``start`` on.

    A document's spans are a list of its own; rows that share doc_id and text share it.
    """
    texts = _texts(docs)
    found = C.written(texts.mapInArrow(_paths, PATHS), "paths")
    by_path = found.groupBy("anchor", "path").agg(F.count(F.lit(1)).alias("c"))
    state = (by_path.groupBy("anchor").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("kinds"))
             .filter("c > 1").select(F.col("anchor").alias("_a"), (F.col("kinds") > 1).alias("branches")))
    known = C.written(found.join(state, F.col("anchor") == F.col("_a")).select(
        "doc_id", "th", "start", "n", "branches", F.when(F.col("branches"), F.col("anchor")).alias("anchor"),
        F.when(F.col("branches"), F.col("path")).alias("path")), "known")
    single = known.filter("branches").withColumn("at", F.xxhash64("doc_id", "th", "start"))
    paths = single.groupBy(F.col("anchor").alias("_a"), F.col("path").alias("_p")).agg(
        F.count(F.lit(1)).alias("c"), F.min("at").alias("first"))
    told = C.written(single.join(paths, (F.col("anchor") == F.col("_a")) & (F.col("path") == F.col("_p"))).select(
        "doc_id", "th", "start", "n", "c", (F.col("at") == F.col("first")).alias("stands")), "branching")
    opened = told.filter("c = 1 or stands").select("doc_id", "th", "start", "n", F.expr("if(c = 1, 1, 2)").alias("w"))
    edges = C.written(_with_spans(texts, opened.distinct(), "inner").mapInArrow(_edges, EDGES), "edges")
    twice = (edges.groupBy("anchor", "edge").agg(F.sum("w").alias("c")).filter("c > 1")
             .select(F.col("anchor").alias("_a"), F.col("edge").alias("_e")))
    again = edges.filter("w = 1").join(twice, (F.col("anchor") == F.col("_a")) & (F.col("edge") == F.col("_e")), "left_semi")
    return known.filter("not branches").select("doc_id", "th", "start", "n").union(
        told.filter("c > 1").select("doc_id", "th", "start", "n")).union(
        again.select("doc_id", "th", "start", F.lit(1).alias("n")))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words that stay, joined by a space): one row per document."""
    out = _with_spans(_texts(docs), repeated_spans(docs).withColumn("w", F.lit(1)), "left").mapInArrow(_remove, KEPT)
    return out.withColumn("kept", F.col("kept").cast("string"))


def digests(removed: DataFrame) -> DataFrame:
    """The same with kept_sha256 for the kept text."""
    return removed.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def repeats_query(spark, sf_dir: str) -> DataFrame:
    return digests(remove_repeats(C.table(spark, sf_dir, "documents")))


SQL = rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') ws FROM documents),
g AS (SELECT doc_id, i, array_to_string(list_slice(ws, i, i + {WINDOW - 1}), ' ') g FROM
       (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - {WINDOW - 2}, 1))) i FROM w)),
r AS (SELECT doc_id, i FROM g WHERE g IN (SELECT g FROM g GROUP BY g HAVING count(*) > 1)),
c AS (SELECT doc_id, list(DISTINCT p) ps FROM (SELECT doc_id, unnest(range(i, i + {WINDOW})) p FROM r) GROUP BY doc_id),
k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) kept, count(*) n FROM
       (SELECT doc_id, unnest(ws) word, unnest(range(1, len(ws) + 1)) p FROM w)
       ANTI JOIN (SELECT doc_id, unnest(ps) p FROM c) x USING (doc_id, p) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) n_words, CAST(len(ws) - coalesce(k.n, 0) AS BIGINT) n_removed,
  sha256(coalesce(k.kept, '')) kept_sha256
FROM w LEFT JOIN k USING (doc_id)
"""
