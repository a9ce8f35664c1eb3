"""Near-duplicates: many universal hash minima, banding, signature check, full-set check, components.

1. One Arrow pass over the texts: the set of 5-word shingles (A-Z lower-cased), its
   size, a 128-bit fingerprint of the set, and the minima of HASHES universal hash
   functions over it; kept are the last byte of each and the keys of the bands.
2. Equal sets collapse to one class (smallest doc_id), whatever their number.
3. Banding: BANDS hashes of ROWS of the minima each.  At a similarity of 0.75 a pair shares
   no band with probability (1 - 0.75**4)**32, about 5e-6.
4. A shingle that only one class has is no part of any intersection, so the other
   shingles of two classes bound their similarity from above, exactly.
5. Links are found in rounds that together test every candidate pair which isn't
   already in one component: first each class against the hub of a shared bucket, the
   class with the fewest shingles of its own (in a group of edited copies the
   original); then, in buckets that still hold several components, all pairs across
   components that the bound allows, the best of each two components first.  So a bucket of thousands
   of copies costs about one test per copy, and yet no link between components is
   lost.  Pairs whose signatures agree in fewer than SURE of the minima are dropped:
   at 0.75 that is four and a half standard deviations below the mean.  Every other pair is
   decided on its full sets.
6. Components by alternating large-star and small-star.

Defined results: null, empty or blank texts have no shingles and are linked with
nothing (component_id = doc_id); a text of one to four words is one shingle; rows
that share a doc_id are linked with each other, so that they have one component; a null
doc_id is linked with nothing, its component_id is null and it is kept; other columns are
not looked at; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .components import stars

WORDS, BANDS, ROWS, HASHES = 5, 32, 4, 512
#: Percent of the union that the intersection must have.
PERCENT = 75
#: Least number of equal minima (by their last bytes) of a pair that is tested on full sets.
SURE = int(HASHES * (0.75 - 4.5 * (0.75 * 0.25 / HASHES) ** 0.5))
#: Buckets above this many classes are compared in blocks of it.
BLOCK = 512
_rng = np.random.default_rng(7)
_MUL = _rng.integers(0, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 2**63, HASHES, dtype=np.uint64)
_BAND = _rng.integers(0, 2**63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(s: C.Slice) -> tuple[np.ndarray, np.ndarray]:
    """The sorted set of shingle hashes of each row, one after the other, and the offsets."""
    w = C.words(s, C.LOWER[s.buf])
    n = np.diff(w.offs)
    count = np.where(n >= WORDS, n - WORDS + 1, (n > 0).astype(np.int64))
    offs = np.concatenate([[0], np.cumsum(count)])
    out = np.empty(offs[-1], dtype=np.uint64)
    pos, row = C.gram_rows(w.offs, WORDS)
    if len(pos):
        first = np.cumsum(np.bincount(row, minlength=len(n))) - np.bincount(row, minlength=len(n))
        out[offs[row] + np.arange(len(pos)) - first[row]] = C.grams(w.hash, WORDS)[pos]
    for r in np.flatnonzero((n > 0) & (n < WORDS)):
        few = C.grams(w.hash[w.offs[r]:w.offs[r + 1]], int(n[r]))
        out[offs[r]] = C.mix(few + np.uint64(n[r]))[0]
    for r in np.flatnonzero(count > 1):
        out[offs[r]:offs[r + 1]].sort()
    row = np.repeat(np.arange(len(n)), count)
    new = np.ones(len(out), dtype=bool)
    new[1:] = (out[1:] != out[:-1]) | (row[1:] != row[:-1])
    return out[new], np.searchsorted(row[new], np.arange(len(n) + 1))


def minima(sets: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """The signature of each row with a set: a row of HASHES 32-bit minima."""
    some = np.flatnonzero(np.diff(offs))
    sig = np.zeros((len(offs) - 1, HASHES), dtype=np.uint32)
    if len(some):
        with np.errstate(over="ignore"):
            for k in range(HASHES):
                h = ((sets * _MUL[k] + _ADD[k]) >> np.uint64(32)).astype(np.uint32)
                sig[some, k] = np.minimum.reduceat(h, offs[some])
    return sig


def _band_keys(sig: np.ndarray) -> np.ndarray:
    """Bucket keys of each signature, one for each band."""
    part = sig[:, :BANDS * ROWS].astype(np.uint64).reshape(-1, BANDS, ROWS)
    with np.errstate(over="ignore"):
        return C.mix(C.mix((C.mix(part + np.uint64(1)) * _BAND).sum(axis=2, dtype=np.uint64))
                     + np.arange(BANDS, dtype=np.uint64))


def _sign(batches):
    for rb in batches:
        for s in C.slices(rb.column("body"), C.SLICE_BYTES // 4):   # the hash loop runs in the cache
            sets, offs = shingles(s)
            sig = minima(sets, offs)
            part = rb.slice(s.lo, s.rows())
            yield pa.RecordBatch.from_arrays([
                part.column("doc_id"), C.int64s(np.diff(offs)),
                C.binary_array([hashlib.blake2b(sets[a:b], digest_size=16).digest() for a, b in zip(offs, offs[1:])]),
                C.binary_array([x.tobytes() for x in sig.astype(np.uint8)]),
                C.lists(C.int64s(_band_keys(sig).ravel()), np.arange(s.rows() + 1) * BANDS)],
                names=["doc_id", "n_shingles", "fp", "sig", "keys"])


def _as_matrix(col: pa.Array) -> np.ndarray:
    offs, data = C.binary_parts(col)
    return data[offs[0]:offs[-1]].reshape(-1, HASHES)


def _agree(batches):
    """Number of equal minima of each pair."""
    for rb in batches:
        same = (_as_matrix(rb.column("sx")) == _as_matrix(rb.column("sy"))).sum(axis=1)
        yield pa.RecordBatch.from_arrays([rb.column("x"), rb.column("y"), pa.array(same.astype(np.int32))],
                                         names=["x", "y", "same"])


def _compare(batches):
    """Two blocks of a bucket (lists of MEMBER): pairs that may be links across components, in their first shared band."""
    def block(col):
        m = col.values
        number = [m.field(k).to_numpy() for k in ("v", "c", "size", "common")]
        return col.offsets.to_numpy(), number, _as_matrix(m.field("sig")), m.field("keys").flatten().to_numpy().reshape(-1, BANDS)

    for rb in batches:
        (la, (va, ca, na, ma), sa, ka), (lb, (vb, cb, nb, mb), sb, kb) = block(rb.column("some")), block(rb.column("all"))
        out = [[], [], [], [], []]
        for r, (key, most) in enumerate(zip(rb.column("key").to_numpy(), rb.column("most").to_numpy())):
            a, b = slice(la[r], la[r + 1]), slice(lb[r], lb[r + 1])
            ok = (ca[a, None] != cb[None, b]) & ((cb[None, b] == most) | (ca[a, None] < cb[None, b]))
            # the smaller number of common shingles is the most that the intersection can be
            ok &= (100 + PERCENT) * np.minimum(ma[a, None], mb[None, b]) >= PERCENT * (na[a, None] + nb[None, b])
            i, j = np.nonzero(ok)
            for k in range(0, len(i), 8192):
                p, q = i[k:k + 8192] + la[r], j[k:k + 8192] + lb[r]
                shared = ka[p] == kb[q]
                here = ka[p, shared.argmax(axis=1)] == key
                p, q = p[here], q[here]
                n = (sa[p] == sb[q]).sum(axis=1)
                p, q, n = p[n >= SURE], q[n >= SURE], n[n >= SURE]
                out[0].append(np.minimum(va[p], vb[q]))
                out[1].append(np.maximum(va[p], vb[q]))
                out[2].append(np.minimum(ca[p], cb[q]))
                out[3].append(np.maximum(ca[p], cb[q]))
                out[4].append(n)
        if out[0]:
            x, y, cx, cy, same = map(np.concatenate, out)
            yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y), pa.array(cx), pa.array(cy),
                                              pa.array(same.astype(np.int32))], names=["x", "y", "cx", "cy", "same"])


def _sets(batches):
    for rb in batches:
        for s in C.slices(rb.column("body")):
            sets, offs = shingles(s)
            yield pa.RecordBatch.from_arrays([rb.column("v").slice(s.lo, s.rows()), C.lists(C.int64s(sets), offs)],
                                             names=["v", "shingles"])


def _confirm(batches):
    """The pairs whose full sets are similar enough."""
    for rb in batches:
        keep = []
        (x, xs), (y, ys) = ((c.offsets.to_numpy(), c.values.to_numpy()) for c in (rb.column("ax"), rb.column("ay")))
        for i in range(rb.num_rows):
            a, b = xs[x[i]:x[i + 1]], ys[y[i]:y[i + 1]]
            both = np.concatenate([a, b])
            both.sort(kind="stable")
            inter = int((both[1:] == both[:-1]).sum())
            if 100 * inter >= PERCENT * (len(a) + len(b) - inter):
                keep.append(i)
        yield pa.RecordBatch.from_arrays([rb.column(c).take(pa.array(keep, pa.int64())) for c in ("x", "y")],
                                         names=["u", "v"])


def signatures(docs: DataFrame) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), C.body(F.col("text")).alias("body"))
    return C.written(rows.mapInArrow(_sign, "doc_id long, n_shingles long, fp binary, sig binary, keys array<long>"), "minhash")


def _similar(pairs: DataFrame, marks: DataFrame) -> DataFrame:
    """Signature check of pairs (x, y): those with enough equal minima, and their number."""
    x, y = (marks.select(F.col("v").alias(k), F.col("sig").alias("s" + k)) for k in "xy")
    return pairs.join(x, "x").join(y, "y").select("x", "y", "sx", "sy").mapInArrow(
        _agree, "x long, y long, same int").filter(F.col("same") >= SURE)


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    x, y = (sets.select(F.col("v").alias(k), F.col("shingles").alias("a" + k)) for k in "xy")
    return pairs.select("x", "y").join(y, "y").join(x, "x").select("x", "y", "ax", "ay").mapInArrow(
        _confirm, "u long, v long").distinct()


def _bounds(sets: DataFrame) -> DataFrame:
    """v, size and number of shingles that some other class has as well."""
    one = sets.select("v", F.explode("shingles").alias("h"))
    own = (one.groupBy("h").agg(F.count(F.lit(1)).alias("c"), F.min("v").alias("v")).filter("c = 1")
           .groupBy(F.col("v").alias("_v")).agg(F.count(F.lit(1)).alias("own")))
    return (sets.groupBy("v").agg(F.max(F.size("shingles")).cast("long").alias("size"))
            .join(own, F.col("v") == F.col("_v"), "left")
            .select("v", "size", (F.col("size") - F.coalesce("own", F.lit(0))).alias("common")))


def _named(rows: DataFrame, vertex: str, comps: DataFrame, to: str) -> DataFrame:
    """Add the component of column ``vertex``: the end of its edge in the stars, or itself."""
    edge = comps.select(F.col("u").alias("_u"), F.col("v").alias("_end"))
    return rows.join(edge, F.col(vertex) == F.col("_u"), "left").withColumn(to, F.coalesce("_end", vertex)).drop("_u", "_end")


def _across(buckets: DataFrame, comps: DataFrame, marks: DataFrame) -> DataFrame:
    """Pairs (x, y) of one bucket whose components (cx < cy) differ and that the bound allows.

    Of a bucket's largest component only the partners of the others are wanted, so one
    side of the join holds the others alone.  Blocks of the bucket meet in the join, and
    their members are compared inside the task, so that rows are only made for pairs
    whose signatures agree.
    """
    member = _named(buckets, "v", comps, "c")
    several = (member.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi"),
                                         F.count(F.lit(1)).alias("n")).filter("lo <> hi").select("key", "n"))
    member = member.join(several, "key")
    most = (member.groupBy("key", "c").agg(F.count(F.lit(1)).alias("m"))
            .groupBy("key").agg(F.max(F.struct("m", "c")).alias("top")).select("key", F.col("top.c").alias("most")))
    member = member.join(most, "key").withColumn(
        "block", F.expr(f"pmod(xxhash64(v), (n - 1) div {BLOCK} + 1)")).join(marks, "v")
    blocks = [side.groupBy("key", "most", "block").agg(F.collect_list(F.struct(
        "v", "c", "size", "common", "sig", "keys")).alias(name)).drop("block")
        for name, side in (("some", member.filter("c <> most")), ("all", member))]
    return blocks[0].join(blocks[1].drop("most"), "key").mapInArrow(_compare, "x long, y long, cx long, cy long, same int")


def _same_id(some: DataFrame, classes: DataFrame) -> DataFrame:
    """Links between the classes of rows that share a doc_id."""
    several = some.groupBy("doc_id").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).filter("lo <> hi").select(
        F.col("doc_id").alias("_d"))
    own = some.join(several, F.col("doc_id") == F.col("_d"), "left_semi").select("doc_id", "fp").join(
        classes.select(F.col("fp").alias("_fp"), "v"), F.col("fp") == F.col("_fp"))
    return own.select(F.col("doc_id").alias("u"), "v").filter("u <> v").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per row of ``docs`` (doc_id, text)."""
    signed = signatures(docs)
    some = signed.filter("n_shingles > 0 and doc_id is not null")
    classes = C.written(
        some.groupBy("fp").agg(F.min(F.struct("doc_id", "sig", "keys")).alias("a"))
        .select("fp", F.col("a.doc_id").alias("v"), F.col("a.sig").alias("sig"), F.col("a.keys").alias("keys")), "classes")
    keyed = classes.select("v", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.min("v").alias("lo"), F.max("v").alias("hi")).filter("lo <> hi").select("key")
    buckets = C.written(keyed.join(shared, "key"), "buckets")

    involved = buckets.select(F.col("v").alias("_v")).distinct()
    marks = C.written(classes.join(involved, F.col("v") == F.col("_v"), "left_semi").select("v", "sig", "keys"), "marks")
    texts = docs.select(F.col("doc_id").cast("long").alias("v"), C.body(F.col("text")).alias("body"))
    sets = C.written(texts.join(involved, F.col("v") == F.col("_v"), "left_semi").mapInArrow(
        _sets, "v long, shingles array<long>"), "shingles")
    bounds = C.written(_bounds(sets), "bounds")
    members = buckets.join(bounds, "v")

    # each class against the hub with which it shares most bands
    hubs = members.groupBy("key").agg(F.min(F.struct(F.expr("size - common").alias("own"), "v")).alias("h")).select(
        "key", F.col("h.v").alias("hub"))
    together = buckets.join(hubs, "key").filter("v <> hub").groupBy("v", "hub").agg(F.count(F.lit(1)).alias("n"))
    first = together.groupBy("v").agg(F.max(F.struct("n", (-F.col("hub")).alias("h"))).alias("a")).select(
        F.expr("-a.h").alias("x"), F.col("v").alias("y"))
    links = C.written(_verified(_similar(first, marks), sets).union(_same_id(some, classes)), "links")
    comps = stars(links)
    pairs = C.written(_across(members, comps, marks), "pairs")

    # the best pair of each two components, then all pairs that still are between components
    best = pairs.groupBy("cx", "cy").agg(F.max(F.struct("same", "x", "y")).alias("b")).select("b.x", "b.y")
    for test in (best, None):
        if test is None:
            test = _named(_named(pairs, "cx", comps, "dx"), "cy", comps, "dy").filter("dx <> dy")
        new = C.written(_verified(test, sets), "links")
        if not new.isEmpty():
            comps = stars(comps.select("u", "v").union(new))
    member = _named(classes.select("fp", "v"), "v", comps, "_c").select(F.col("fp").alias("_fp"), "_c")
    return (signed.join(member, F.col("fp") == F.col("_fp"), "left")
            .select("doc_id", "n_shingles",
                    F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("_c"))
                    .otherwise(F.col("doc_id")).alias("component_id"))
            .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))))


def near_dup_query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(C.table(spark, sf_dir, "documents"))


def near_dup_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the one with the smallest doc_id (rows that repeat it stay with it)."""
    out = near_duplicates(docs).filter(~F.col("kept")).select(F.col("doc_id").alias("_d")).distinct()
    return docs.join(out, docs["doc_id"].cast("long") == out["_d"], "left_anti")


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
       'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') ws FROM documents),
s AS (SELECT DISTINCT doc_id, list_slice(ws, i, i + 4) g FROM
       (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id x, b.doc_id y, count(*) c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id
      GROUP BY a.doc_id, b.doc_id),
l AS (SELECT x, y FROM i JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 75 * (p.n + q.n - c)),
r AS (SELECT doc_id, doc_id c FROM w UNION SELECT l.y, r.c FROM r JOIN l ON l.x = r.doc_id),
m AS (SELECT doc_id, min(c) c FROM r GROUP BY doc_id)
SELECT w.doc_id, coalesce(n.n, 0) n_shingles, m.c component_id, w.doc_id = m.c AS kept
FROM w LEFT JOIN n USING (doc_id) JOIN m USING (doc_id)
"""
