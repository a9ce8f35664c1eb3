"""Benchmark decontamination: rare n-gram seeds join passages to test items, Smith-Waterman scores them.

Words here are runs of ASCII letters, digits and non-ASCII characters of the
lower-cased text, so case, punctuation and white space don't hide a copy.  Test items
are cut evenly into segments of at most SEGMENT words; equal segments are one.

1. A segment's seeds are the rarest of its pairs of neighbouring words (rare: in few
   segments).  One Arrow pass over all texts looks up its pairs of neighbouring words and
   of words with one between them (blocks of items with a bounded size are sent to the
   tasks, one block after the other).  Hits on one segment near one diagonal become a
   passage, if they are SURE or more, which is kept as word hashes with a margin around it.
2. A passage goes on if the words of the segment that it holds allow the score.
3. Smith-Waterman over words (MATCH, MISMATCH, GAP) aligns passage and segment,
   vectorised over passages.  A passage is a leak if its score is at least THRESHOLD
   of the score of an exact copy.

The seeds miss nothing.  Of n words an alignment may lose 2 n (1 - THRESHOLD) of the
score.  Between two matches, s words of the segment and t of the text without a match cost
2 s + max(s, t); they break s + 1 pairs, but none if s = 0 and t = 1.  That is at most two
pairs for a loss of three (one word replaced), so ``seeds`` takes SURE pairs more than
the whole loss can break (or all pairs, and fewer hits will do).  Nor does the margin: t
is at most n in all.  Where a text is cut into pieces of hits, one hit will do in it.

Items of fewer than MIN_ITEM words must be in a text as a whole (score 1).  Such a phrase
may stand in any text: the stage acts on items of EVIDENCE words and more only.

Defined results: null or empty texts and items match nothing; a null doc_id or item_id
is reported as null; rows that share doc_id and text are one row in the result; of
equally good passages the one that ends last is told; a text of any length, of one
repeated word as well, is worked on in pieces of HITS hits; other columns are not looked
at; empty tables give no rows.
"""

from __future__ import annotations

from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from . import common as C

SEGMENT, MIN_ITEM, EVIDENCE = 64, 8, 4
MATCH, MISMATCH, GAP = 2, -1, 1
THRESHOLD = 0.5
#: Hits that a passage of a long segment has for sure.
SURE = 4
#: Bytes of items that are sent to the tasks at once.
BLOCK_BYTES = 8_000_000
#: Elements of the score rows, and hits of seeds, that are worked on at once.
CELLS, HITS = 1_000_000, 1_000_000

LETTERS = np.array([not (b < 128 and not chr(b).isalnum()) for b in range(256)])
PASSAGE = "doc_id long, th long, seg int, start int, words binary"
SCORED = "doc_id long, th long, item_id long, item_words int, score double, end_word long"


def item_words(s: C.Slice) -> C.Words:
    return C.words(s, space=~LETTERS)


def pairs(h: np.ndarray, step: int) -> np.ndarray:
    """Hash of each word with the one ``step`` words after it (step 0: of the word alone)."""
    with np.errstate(over="ignore"):
        return C.mix(h[:len(h) - step] * C._GRAM + h[step:]) if step else C.mix(h + C._GRAM)


def broken(n: int, need: float) -> int:
    """The most pairs of n words that an alignment with ``need`` of the full score can lack."""
    return int(2 * MATCH * n * (1 - need) / 3 + 1e-9)


class Items:
    """The distinct segments of a block of items, and their seeds sorted by hash."""

    def __init__(self, ids: list, texts: pa.Array, threshold: float):
        known: dict[tuple, int] = {}
        self.words, self.need, self.item = [], [], []
        for s in C.slices(texts):
            w = item_words(s)
            for r in range(s.rows()):
                h = w.hash[w.offs[r]:w.offs[r + 1]]
                need = threshold if len(h) >= MIN_ITEM else 1.0
                for part in np.array_split(h, -(-len(h) // SEGMENT)) if len(h) else ():
                    k = known.setdefault((need, part.tobytes()), len(known))
                    if k == len(self.words):
                        self.words.append(part)
                        self.need.append(need)
                        self.item.append(set())
                    self.item[k].add((ids[s.lo + r], len(h)))
        self.item = [sorted(x, key=lambda i: (i[0] is not None, i)) for x in self.item]
        self.size = np.array([len(h) for h in self.words], dtype=np.int64)
        self.need = np.array(self.need, dtype=np.float64)
        #: The words of the items that must be found as a whole.
        self.whole = self.size < MIN_ITEM
        self.head = np.zeros((len(self.words), MIN_ITEM - 1), np.uint64)
        for k in np.flatnonzero(self.whole):
            self.head[k, :self.size[k]] = self.words[k]
        lost = np.array([broken(len(h), need) for h, need in zip(self.words, self.need)], dtype=np.int64)
        self.least = np.where(self.whole, 1, np.minimum(SURE, self.size - 1 - lost))
        self.gram, self.seg, self.low, self.high = self.seeds(lost + self.least)

    def seeds(self, take: np.ndarray) -> tuple[np.ndarray, ...]:
        """Hash, segment, and first and last place in the segment of its ``take`` rarest pairs."""
        every = [pairs(h, min(1, len(h) - 1)) for h in self.words]
        if not every:
            return np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3))
        names, df = np.unique(np.concatenate([np.unique(g) for g in every]), return_counts=True)
        gram, seg, at = [], [], []
        for k, g in enumerate(every):
            rare = np.argsort(df[np.searchsorted(names, g)], kind="stable")[:take[k]]
            gram.append(g[rare])
            seg.append(np.full(len(rare), k))
            at.append(rare)
        gram, seg, at = np.concatenate(gram), np.concatenate(seg), np.concatenate(at)
        order = np.lexsort((at, seg, gram))
        gram, seg, at = gram[order], seg[order], at[order]
        new = np.ones(len(gram), dtype=bool)
        new[1:] = (gram[1:] != gram[:-1]) | (seg[1:] != seg[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(gram)) - 1
        return gram[first], seg[first], at[first], at[last]

    @cached_property
    def seen(self) -> np.ndarray:
        """Which lower bits of a hash some seed has; built where it is used."""
        out = np.zeros(1 << max(20, (32 * len(self.gram)).bit_length()), dtype=bool)
        out[self.gram & np.uint64(len(out) - 1)] = True
        return out


def _hits(items: Items, w: C.Words):
    """Word and row of seeds in the texts, their range in ``items.gram``, and whether all hits of the row are here.

    In the order of the words, HITS hits at a time.
    """
    found = []
    for step in (1, 2, 0) if (items.size == 1).any() else (1, 2):
        pos, row = C.gram_rows(w.offs, step + 1)
        if not len(pos):
            continue
        g = pairs(w.hash, step)[pos]
        maybe = np.flatnonzero(items.seen[g & np.uint64(len(items.seen) - 1)])
        lo = np.searchsorted(items.gram, g[maybe], side="left")
        n = np.searchsorted(items.gram, g[maybe], side="right") - lo
        maybe, lo, n = maybe[n > 0], lo[n > 0], n[n > 0]
        found.append((pos[maybe], row[maybe], lo, n))
    if not found:
        return
    pos, row, lo, n = (np.concatenate(x) for x in zip(*found))
    order = np.argsort(pos, kind="stable")
    pos, row, lo, n = pos[order], row[order], lo[order], n[order]
    upto = np.cumsum(n)
    a = 0
    while a < len(n):
        b = max(a + 1, int(np.searchsorted(upto, upto[a] - n[a] + HITS, side="right")))
        part = row[a:b]
        all_here = np.ones(len(part), dtype=bool)
        if a and row[a - 1] == row[a]:
            all_here &= part != row[a]
        if b < len(n) and row[b] == row[b - 1]:
            all_here &= part != row[b]
        yield pos[a:b], part, lo[a:b], n[a:b], all_here
        a = b


def _passages(items: Items, s: C.Slice, part: pa.RecordBatch):
    w = item_words(s)
    for pos, row, lo, n, all_here in _hits(items, w):
        hit = np.repeat(np.arange(len(n)), n)
        j = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        row, seg, sure = row[hit], items.seg[j], all_here[hit]
        low, high = pos[hit] - items.high[j], pos[hit] - items.low[j]
        whole = items.whole[seg]
        if whole.any():                                         # as a whole, or not at all
            good = ~whole | ((low >= w.offs[row]) & (low + items.size[seg] <= w.offs[row + 1]))
            for i in range(items.head.shape[1]):
                at = np.clip(low + i, 0, len(w.hash) - 1)
                good &= ~whole | (i >= items.size[seg]) | (w.hash[at] == items.head[seg, i])
            row, seg, low, high, whole, sure = (x[good] for x in (row, seg, low, high, whole, sure))
        if not len(row):
            continue
        order = np.lexsort((low, seg, row))
        row, seg, low, high, whole, sure = (x[order] for x in (row, seg, low, high, whole, sure))
        new = np.ones(len(row), dtype=bool)
        new[1:] = ((row[1:] != row[:-1]) | (seg[1:] != seg[:-1])
                   | ((low[1:] - low[:-1] > 2 * items.size[seg[1:]]) & ~whole[1:]))
        first = np.flatnonzero(new)
        enough = (np.diff(np.append(first, len(row))) >= items.least[seg[first]]) | ~sure[first]
        begin, end = low[first], np.maximum.reduceat(high, first)
        row, seg, whole, begin, end = (x[enough] for x in (row[first], seg[first], whole[first], begin, end))
        size = items.size[seg]
        a = np.maximum(np.where(whole, begin, begin - size), w.offs[row])
        b = np.minimum(np.where(whole, begin + size, end + 2 * size), w.offs[row + 1])
        able = np.array([np.isin(items.words[k], w.hash[x:y]).sum() for k, x, y in zip(seg, a, b)], dtype=np.int64)
        go = able >= items.need[seg] * size
        if go.any():
            row, seg, a, b = row[go], seg[go], a[go], b[go]
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([
                part.column("doc_id").take(take), part.column("th").take(take), pa.array(seg.astype(np.int32)),
                pa.array((a - w.offs[row]).astype(np.int32)),
                C.binary_array([w.hash[x:y].tobytes() for x, y in zip(a, b)]),
            ], names=["doc_id", "th", "seg", "start", "words"])


def align(segments: list[np.ndarray], passages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Smith-Waterman of each segment with its passage: best score, and the passage word after its end."""
    score, end = np.zeros(len(segments), np.int64), np.zeros(len(segments), np.int64)
    order = sorted(range(len(segments)), key=lambda i: (len(passages[i]), len(segments[i])), reverse=True)
    while order:
        width = max(1, len(passages[order[0]]))
        now, order = order[:max(1, CELLS // width)], order[max(1, CELLS // width):]
        deep = max(len(segments[i]) for i in now)
        a = np.zeros((len(now), deep), np.uint64)           # 0 and 1 stand for no word on either side
        b = np.ones((len(now), width), np.uint64)
        for k, i in enumerate(now):
            a[k, :len(segments[i])], b[k, :len(passages[i])] = segments[i], passages[i]
        up = np.zeros((len(now), width), np.int32)
        diag = np.zeros_like(up)
        slope = np.arange(width, dtype=np.int32) * GAP
        best, at = np.zeros(len(now), np.int64), np.zeros(len(now), np.int64)
        for r in range(deep):
            diag[:, 1:] = up[:, :-1]
            here = np.where(b == a[:, r:r + 1], diag + MATCH, diag + MISMATCH)
            np.maximum(here, up - GAP, out=here)
            np.maximum(here, 0, out=here)
            here += slope                                   # a gap along the passage costs GAP a word
            np.maximum.accumulate(here, axis=1, out=here)
            here -= slope
            top = here.argmax(axis=1)
            value = here[np.arange(len(now)), top]
            at = np.where(value > best, top + 1, at)
            best = np.maximum(best, value)
            up = here
        score[now], end[now] = best, at
    return score, end


def _find(items):
    def run(batches):
        for rb in batches:
            for s in C.slices(rb.column("body")):
                yield from _passages(items.value, s, rb.slice(s.lo, s.rows()))
    return run


def _score(items):
    def run(batches):
        known = items.value
        for rb in batches:
            seg = np.asarray(rb.column("seg"), dtype=np.int64)
            score, end = align([known.words[k] for k in seg],
                               [np.frombuffer(x.as_buffer(), np.uint64) for x in rb.column("words")])
            share = score / (MATCH * known.size[seg])
            good = np.flatnonzero(share >= known.need[seg])
            of = [known.item[k] for k in seg[good]]
            row = np.repeat(good, [len(x) for x in of]) if len(good) else good
            take, flat = pa.array(row), [i for x in of for i in x]
            yield pa.RecordBatch.from_arrays([
                rb.column("doc_id").take(take), rb.column("th").take(take),
                pa.array([i for i, _ in flat], type=pa.int64()), pa.array([n for _, n in flat], type=pa.int32()),
                pa.array(share[row], type=pa.float64()),
                pa.array((np.asarray(rb.column("start")) + end)[row], type=pa.int64())],
                names=["doc_id", "th", "item_id", "item_words", "score", "end_word"])
    return run


def leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD,
          block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, th (hash of the text), item_id, item_words, score, end_word: the leaks of each item into each document."""
    if broken(MIN_ITEM, threshold) > MIN_ITEM - 2:
        raise ValueError(f"threshold {threshold}: pairs of words can't find every such passage")
    spark = docs.sparkSession
    ship_package(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), C.text_key(F.col("text")).alias("th"),
                       C.body(F.lower("text")).alias("body"))
    tests = benchmark.select(F.col("item_id").cast("long").alias("item_id"), C.body(F.lower("text")).alias("body"))
    size = tests.agg(F.coalesce(F.sum(F.length("body")), F.lit(0))).first()[0]
    blocks = int(size // block_bytes) + 1
    out = None
    for k in range(blocks):
        held = tests.filter(F.pmod(F.xxhash64("item_id", "body"), F.lit(blocks)) == k).toArrow().combine_chunks()
        texts = held.column("body").combine_chunks()
        known = spark.sparkContext.broadcast(Items(
            held.column("item_id").to_pylist(), texts.cast(pa.binary())
            if not isinstance(texts, pa.ChunkedArray) else pa.concat_arrays(texts.chunks).cast(pa.binary()), threshold))
        found = C.written(rows.mapInArrow(_find(known), PASSAGE), "passages")
        scored = found.mapInArrow(_score(known), SCORED)
        out = scored if out is None else out.union(scored)
    best = F.max(F.struct("score", "end_word", "item_words")).alias("b")
    return out.groupBy("doc_id", "th", "item_id").agg(best).select(
        "doc_id", "th", "item_id", F.col("b.item_words").alias("item_words"), F.col("b.score").alias("score"),
        F.col("b.end_word").alias("end_word"))


def leak_query(spark, sf_dir: str) -> DataFrame:
    return leaks(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "benchmark")).drop("th")


def leak_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a leaked passage of an item of EVIDENCE words or more go."""
    out = leaks(docs, C.table(spark, sf_dir, "benchmark")).filter(F.col("item_words") >= EVIDENCE).select(
        F.col("doc_id").alias("_d"), F.col("th").alias("_t")).distinct()
    return docs.join(out, docs["doc_id"].cast("long").eqNullSafe(out["_d"])
                     & (C.text_key(docs["text"]) == out["_t"]), "left_anti")
