"""Quality rules: base counts of a text, and cross-document line frequency per host.

One Arrow pass over the texts counts words, symbols, repeats and lines, and hashes
the normalised lines (A-Z lower-cased, digits as 0, white space as one space).
Spark then counts, for every host and line, the distinct documents that hold the
line.  Lines above the limit are boilerplate: ``clean`` cuts them out of the text,
and a document of which too little is left is rejected.  The host of a row of
``documents`` is its ``source``.

What is left of a text is its other lines as they were, joined by newlines again.
The hashes of the lines to cut are joined back to the rows by doc_id, source and
text, and a pass over the texts hashes the lines again to find them.

Copies: rows of one host with equal text count as one document, so a group of
exact copies can't make its own lines look like boilerplate.

Defined results: a null or empty text has no words and fails the base rule; a
null source is a host of its own; rows that repeat a doc_id are judged each by
its own text; other columns are not looked at; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from . import common as C

SYMBOLS = C._bytes(b"#*$%&|<>")
DIGITS_AS_ZERO = C.LOWER.copy()
DIGITS_AS_ZERO[ord("0"):ord("9") + 1] = ord("0")
REPEAT_WORDS = 5

#: A line is boilerplate of its host if it is in at least MIN_DOCS distinct documents and in MAX_SHARE of them.
MIN_DOCS, MAX_SHARE = 20, 0.10
#: A document is depleted with fewer words left than MIN_LEFT, or less than LEFT_SHARE of its words.
MIN_LEFT, LEFT_SHARE = 10, 0.30

SCHEMA = """row_id long, doc_id long, source string, th long, n_words long, word_chars long, n_symbols long,
 n_dup_lines long, n_repeat_words long, lines array<struct<h: long, w: int>>"""
LINE = pa.struct([("h", pa.int64()), ("w", pa.int32())])


def _repeat_words(w: C.Words) -> np.ndarray:
    """Words of each row that a 5-word window covers which the row has twice or more."""
    pos, row = C.gram_rows(w.offs, REPEAT_WORDS)
    covered = np.zeros(len(w.hash) + 1, dtype=np.int32)
    if len(pos):
        g = C.grams(w.hash, REPEAT_WORDS)[pos]
        order = np.argsort(g ^ C.mix(row.astype(np.uint64)), kind="stable")
        same = (g[order][1:] == g[order][:-1]) & (row[order][1:] == row[order][:-1])
        twice = np.zeros(len(pos), dtype=bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        np.add.at(covered, pos[twice], 1)
        np.add.at(covered, pos[twice] + REPEAT_WORDS, -1)
    return C.sums(np.cumsum(covered)[:-1] > 0, w.offs)


def _word_lines(s: C.Slice, w: C.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The lines with words: starts, ends, rows, numbers of words, normalised hashes."""
    starts, ends = C.runs(s.buf != 10, s.offs)
    n_words = np.searchsorted(w.starts, ends) - np.searchsorted(w.starts, starts)
    starts, ends, n_words = starts[n_words > 0], ends[n_words > 0], n_words[n_words > 0]
    row = np.searchsorted(s.offs, starts, side="right") - 1
    if not len(starts):
        return starts, ends, row, n_words, np.zeros(0, np.uint64)
    # normalised: the sequence of the normalised words
    norm = DIGITS_AS_ZERO[s.buf]
    h = C.hash_runs(norm, ~C.SPACE[s.buf], w.starts)
    first = np.searchsorted(w.starts, starts)
    at = np.arange(len(h)) - np.repeat(first, n_words)
    with np.errstate(over="ignore"):
        return starts, ends, row, n_words, C.mix(np.add.reduceat(C.placed(h, at), first))


def _lines(s: C.Slice, w: C.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per row: repeated lines; and the distinct normalised lines: offsets, hashes, words."""
    inside = s.buf != 10
    starts, _, row, n_words, line = _word_lines(s, w)
    if not len(starts):
        zero = np.zeros(s.rows() + 1, np.int64)
        return zero[1:], zero, np.zeros(0, np.uint64), np.zeros(0, np.int64)
    # equal bytes: a line of white space only has no word and is left out above
    all_starts = C.runs(inside, s.offs)[0]
    raw = C.hash_runs(s.buf, inside, all_starts)[np.searchsorted(all_starts, starts)]
    order = np.argsort(raw ^ C.mix(row.astype(np.uint64)), kind="stable")
    again = np.zeros(len(raw), dtype=bool)
    again[order[1:]] = (raw[order][1:] == raw[order][:-1]) & (row[order][1:] == row[order][:-1])
    dup = np.bincount(row[again], minlength=s.rows())
    order = np.lexsort((line, row))
    new = np.ones(len(line), dtype=bool)
    new[1:] = (line[order][1:] != line[order][:-1]) | (row[order][1:] != row[order][:-1])
    at = np.flatnonzero(new)
    count = np.add.reduceat(n_words[order], at)
    return dup, np.searchsorted(row[order][at], np.arange(s.rows() + 1)), line[order][at], count


def scan(batches):
    """doc_id, source, th, body -> SCHEMA, with row_id left to the caller."""
    for rb in batches:
        for s in C.slices(rb.column("body")):
            w = C.words(s)
            inside = np.zeros(len(s.buf) + 1, dtype=np.int8)
            inside[w.starts] += 1
            np.subtract.at(inside, w.ends, 1)
            dup, offs, line, count = _lines(s, w)
            part = rb.slice(s.lo, s.rows())
            yield pa.RecordBatch.from_arrays([
                part.column("doc_id"), part.column("source"), part.column("th"),
                C.int64s(np.diff(w.offs)),
                C.int64s(C.sums((np.cumsum(inside)[:-1] > 0) & C.POINT[s.buf], s.offs)),
                C.int64s(C.sums(SYMBOLS[s.buf], s.offs)),
                C.int64s(dup), C.int64s(_repeat_words(w)),
                C.lists(pa.StructArray.from_arrays([C.int64s(line), pa.array(count.astype(np.int32))], fields=list(LINE)),
                        offs),
            ], names=["doc_id", "source", "th", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                      "lines"])


def line_counts(docs: DataFrame) -> DataFrame:
    """One row per document with its base counts and its distinct lines, written once."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
                       C.text_key(F.col("text")).alias("th"), C.body(F.col("text")).alias("body"))
    counted = rows.mapInArrow(scan, SCHEMA.replace("row_id long, ", ""))
    return C.written(counted.select(F.monotonically_increasing_id().alias("row_id"), "*"), "quality")


def boilerplate(counted: DataFrame, min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE) -> DataFrame:
    """Host, line hash and number of distinct documents of the lines above the limit."""
    lines = counted.select("source", "th", F.explode("lines.h").alias("h"))
    freq = (lines.distinct().groupBy("source", "h").agg(F.count(F.lit(1)).alias("docs"))
            .filter(F.col("docs") >= min_docs))
    hosts = (counted.select("source", "th").distinct().groupBy(F.col("source").alias("host"))
             .agg(F.count(F.lit(1)).alias("host_docs")))
    return (freq.join(hosts, F.col("source").eqNullSafe(F.col("host")))
            .filter(F.col("docs") >= F.col("host_docs") * F.lit(max_share))
            .select("host", F.col("h").alias("line"), "docs"))


def verdicts(docs: DataFrame, min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE, min_left: int = MIN_LEFT,
             left_share: float = LEFT_SHARE) -> DataFrame:
    """One row per document: the base counts, the boilerplate lines to cut and their words, and the verdict."""
    counted = line_counts(docs)
    lines = counted.select("row_id", "source", F.explode("lines").alias("l")).select(
        "row_id", "source", F.col("l.h").alias("h"), F.col("l.w").alias("w"))
    common = boilerplate(counted, min_docs, max_share)
    removed = (lines.join(common, F.col("source").eqNullSafe(F.col("host")) & (F.col("h") == F.col("line")))
               .groupBy("row_id").agg(F.sum("w").cast("long").alias("n_boilerplate_words"),
                                      F.collect_list("h").alias("cut")))
    n, left = F.col("n_words"), F.col("n_words") - F.col("n_boilerplate_words")
    return (counted.drop("lines").join(removed, "row_id", "left")
            .withColumn("n_boilerplate_words", F.coalesce("n_boilerplate_words", F.lit(0).cast("long")))
            .withColumn("base_failed", (n < 10) | (100 * F.col("n_repeat_words") > 20 * n))
            .withColumn("kept", ~F.col("base_failed") & (left >= min_left) & (left >= n * F.lit(left_share)))
            .drop("row_id"))


def judge(docs: DataFrame, min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE, min_left: int = MIN_LEFT,
          left_share: float = LEFT_SHARE) -> DataFrame:
    """One row per document: the base counts, words on boilerplate lines, and the verdict."""
    return verdicts(docs, min_docs, max_share, min_left, left_share).drop("cut")


def _without(s: C.Slice, cut: pa.Array) -> list[bytes]:
    """The texts of a slice without the lines whose normalised hashes are in the row's ``cut``."""
    starts, ends, row, _, line = _word_lines(s, C.words(s))
    rows = np.repeat(np.arange(len(cut)), np.asarray(cut.value_lengths()))
    pair = np.dtype([("row", np.int64), ("h", np.int64)])
    have, want = np.empty(len(line), pair), np.empty(len(rows), pair)
    have["row"], have["h"] = row, line.view(np.int64)
    want["row"], want["h"] = rows, np.asarray(cut.flatten(), dtype=np.int64)
    gone = np.isin(have, want)
    step = np.zeros(len(s.buf) + 2, dtype=np.int32)
    last = ends[gone] == s.offs[row[gone] + 1]              # no newline after it: the one before it goes
    np.add.at(step, starts[gone], 1)
    np.add.at(step, ends[gone] + ~last, -1)
    keep = np.cumsum(step[:len(s.buf)]) == 0
    out = [s.buf[a:b][keep[a:b]].tobytes() for a, b in zip(s.offs[:-1], s.offs[1:])]
    for r in row[gone][last]:
        out[r] = out[r].removesuffix(b"\n")
    return out


def _cut(batches):
    """Columns of documents and the lines to cut (null: none) -> columns of documents."""
    for rb in batches:
        names = rb.schema.names[:-1]
        text, cut = rb.column(names.index("text")), rb.column(len(names))
        todo = np.flatnonzero(np.asarray(cut.is_valid()))
        if len(todo):
            at = pa.array(todo)
            new = text.to_pylist()
            lines = cut.take(at)
            for s in C.slices(text.take(at).cast(pa.binary())):
                for k, t in zip(todo[s.lo:s.hi], _without(s, lines.slice(s.lo, s.rows()))):
                    new[k] = t.decode()
            text = pa.array(new, type=text.type)
            if "n_chars" in names:
                at = names.index("n_chars")
                size = rb.column(at).to_pylist()
                for k in todo:
                    size[k] = size[k] if size[k] is None else len(new[k])
                rb = rb.set_column(at, rb.schema.field(at), pa.array(size, type=rb.column(at).type))
        yield pa.RecordBatch.from_arrays([text if c == "text" else rb.column(k) for k, c in enumerate(names)], names=names)


def clean(docs: DataFrame) -> DataFrame:
    """The rows that pass, without their boilerplate lines (n_chars follows); told apart by doc_id, source and text."""
    ship_package(docs.sparkSession)
    out = verdicts(docs).filter(~F.col("kept") | F.col("cut").isNotNull()).groupBy(
        F.col("doc_id").alias("_d"), F.col("source").alias("_s"), F.col("th").alias("_h")).agg(
        F.first("kept").alias("_kept"), F.first("cut").alias("_cut"))
    rows = docs.join(out, docs["doc_id"].cast("long").eqNullSafe(out["_d"])
                     & docs["source"].cast("string").eqNullSafe(out["_s"])
                     & (C.text_key(docs["text"]) == out["_h"]), "left").filter(F.coalesce(out["_kept"], F.lit(True)))
    return rows.select(*[docs[c] for c in docs.columns], out["_cut"]).mapInArrow(_cut, docs.schema)


def quality_query(spark, sf_dir: str) -> DataFrame:
    return judge(C.table(spark, sf_dir, "documents")).drop("source", "th")


def quality_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that pass, with cleaned texts."""
    return clean(docs)


SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') ws FROM d),
g AS (SELECT doc_id, i, list_slice(ws, i, i + 4) gram FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) i FROM w)),
g2 AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) c FROM g),
rep AS (SELECT doc_id, count(DISTINCT p) n FROM (SELECT doc_id, i + unnest([0, 1, 2, 3, 4]) p FROM g2 WHERE c > 1)
        GROUP BY doc_id),
l AS (SELECT doc_id, source, t, unnest(string_split(t, chr(10))) line FROM d),
lw AS (SELECT *, regexp_extract_all(line, '[^\x20\x09-\x0D]+') lws FROM l),
lx AS (SELECT *, regexp_replace(translate(array_to_string(lws, ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
       'abcdefghijklmnopqrstuvwxyz'), '[0-9]', '0', 'g') norm FROM lw WHERE len(lws) > 0),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) n FROM lx GROUP BY doc_id),
f AS (SELECT source, norm, count(DISTINCT t) c FROM lx GROUP BY source, norm),
h AS (SELECT source, count(DISTINCT t) c FROM d GROUP BY source),
b AS (SELECT f.source, f.norm FROM f JOIN h ON f.source IS NOT DISTINCT FROM h.source
      WHERE f.c >= 20 AND f.c >= h.c * CAST(0.1 AS DOUBLE)),
r AS (SELECT doc_id, CAST(sum(len(lws)) AS BIGINT) n FROM lx JOIN b
      ON lx.source IS NOT DISTINCT FROM b.source AND lx.norm = b.norm GROUP BY doc_id),
a AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) word_chars,
   CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) n_symbols,
   coalesce(dup.n, 0) n_dup_lines, coalesce(rep.n, 0) n_repeat_words, coalesce(r.n, 0) n_boilerplate_words
 FROM w LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN r USING (doc_id))
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND n_words - n_boilerplate_words >= 10
  AND n_words - n_boilerplate_words >= n_words * CAST(0.3 AS DOUBLE) AS kept
FROM a
"""
