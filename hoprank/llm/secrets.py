"""Secret scans: fixed patterns, and character Markov models of random strings and ordinary identifiers.

The fixed patterns (assign, access, hex) give the base spans.  They also label the
training samples: what they match is a random string, every other token of at least
ORDINARY characters is an ordinary identifier.  One pass over all documents counts
character pairs of both kinds; the counts (alphabet squared, whatever the corpus size)
become two first-order Markov models with add-one smoothing.  A second pass scores
each token of at least CANDIDATE characters that no base span touches by the
log-likelihood ratio of the models; those above the limits are added as ``markov``.

Defined results: a null or empty text has no spans; each row is scanned on its own, so
repeated rows repeat their result; other columns are not looked at; without any token
the models are uniform and nothing is added; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from . import common as C

# The kinds of base spans, in the order of listing.
KINDS = ("assign", "access", "hex", "markov")
ASSIGN = re.compile(rb"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24

ALPHABET = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
TOKEN = C._bytes(ALPHABET)
HEX = C._bytes(b"0123456789abcdef")
K = len(ALPHABET)
_code = np.zeros(256, dtype=np.int64)
_code[list(ALPHABET)] = np.arange(K)

#: Least length of a training identifier and of a candidate.
ORDINARY, CANDIDATE = 6, 16
#: Least log-likelihood ratio of a secret: in all, and a character.
LEAST_SUM, LEAST_MEAN = 10.0, 0.5

COUNTS = "random boolean, pair int, n long"
FOUND = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def base_spans(s: C.Slice) -> list[list[tuple[int, int, int]]]:
    """(start, kind, end) in bytes of each row, in order."""
    out = [[] for _ in range(s.rows())]
    starts, ends = C.runs(HEX[s.buf], s.offs)
    long = np.flatnonzero(ends - starts >= HEX_LEAST)
    for r, a, b in zip(np.searchsorted(s.offs, starts[long], side="right") - 1, starts[long], ends[long]):
        out[r].append((int(a - s.offs[r]), 2, int(b - s.offs[r])))
    raw = s.buf.tobytes()
    low = raw.lower()
    if b"AKIA" in raw or any(k in low for k in KEYWORDS):
        for r, (a, b) in enumerate(zip(s.offs, s.offs[1:])):
            text = raw[a:b]
            if b"AKIA" in text:
                out[r] += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
            small = low[a:b]
            if any(k in small for k in KEYWORDS):
                out[r] += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text)
                           if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    for spans in out:
        spans.sort()
    return out


def _tokens(s: C.Slice, spans, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of at least ``least`` characters that no base span touches."""
    starts, ends = C.runs(TOKEN[s.buf], s.offs)
    long = ends - starts >= least
    starts, ends = starts[long], ends[long]
    taken = np.zeros(len(s.buf) + 1, dtype=np.int32)
    for r, row in enumerate(spans):
        for a, _, b in row:
            taken[s.offs[r] + a] += 1
            taken[s.offs[r] + b] -= 1
    before = np.concatenate([[0], np.cumsum(np.cumsum(taken)[:-1] > 0)])
    free = before[ends] == before[starts]
    return starts[free], ends[free]


def _pairs(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The character pairs of the runs, and the first of each run."""
    n = np.maximum(ends - starts - 1, 0)
    at = np.repeat(starts, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return _code[buf[at]] * K + _code[buf[at + 1]], np.cumsum(n) - n


def _random_runs(s: C.Slice, spans) -> tuple[np.ndarray, np.ndarray]:
    """The token characters inside base spans: of assignments the value alone."""
    at, to = [], []
    raw = s.buf.tobytes()
    for r, row in enumerate(spans):
        for a, kind, b in row:
            a, b = int(s.offs[r]) + a, int(s.offs[r]) + b
            if kind == 0:
                a = ASSIGN.match(raw, a, b).start(2)
            at.append(a)
            to.append(b)
    inside = np.zeros(len(s.buf), dtype=bool)
    for a, b in zip(at, to):
        inside[a:b] = True
    return C.runs(inside & TOKEN[s.buf], s.offs)


def _count(batches):
    total = np.zeros((2, K * K), dtype=np.int64)
    for rb in batches:
        for s in C.slices(rb.column("body")):
            spans = base_spans(s)
            for label, (a, b) in enumerate((_tokens(s, spans, ORDINARY), _random_runs(s, spans))):
                total[label] += np.bincount(_pairs(s.buf, a, b)[0], minlength=K * K)
    label, pair = np.nonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(label.astype(bool)), pa.array(pair.astype(np.int32)),
                                      pa.array(total[label, pair])], names=["random", "pair", "n"])


def ratio(counts: np.ndarray) -> np.ndarray:
    """Log-likelihood ratio of each character pair, from the counts of ordinary and of random strings."""
    p = (counts + 1.0).reshape(2, K, K)
    p /= p.sum(axis=2, keepdims=True)
    return (np.log(p[1]) - np.log(p[0])).ravel()


def train(docs: DataFrame) -> np.ndarray:
    """The pair ratios learnt from all documents (K * K numbers)."""
    ship_package(docs.sparkSession)
    rows = docs.select(C.body(F.col("text")).alias("body")).mapInArrow(_count, COUNTS)
    counts = np.zeros((2, K * K), dtype=np.int64)
    for r in rows.groupBy("random", "pair").agg(F.sum("n").alias("n")).collect():   # 2 * K * K rows at most
        counts[int(r["random"]), r["pair"]] = r["n"]
    return ratio(counts)


def score(model: np.ndarray, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Log-likelihood ratio of each run (of two characters or more)."""
    if not len(starts):
        return np.zeros(0)
    pair, first = _pairs(buf, starts, ends)
    return np.add.reduceat(model[pair], first)


def _scan(model: np.ndarray):
    def run(batches):
        for rb in batches:
            for s in C.slices(rb.column("body")):
                base = base_spans(s)
                a, b = _tokens(s, base, CANDIDATE)
                value = score(model, s.buf, a, b)
                hit = (value >= LEAST_SUM) & (value >= LEAST_MEAN * (b - a - 1))
                row = np.searchsorted(s.offs, a[hit], side="right") - 1
                added = [[] for _ in base]
                for r, x, y in zip(row, a[hit], b[hit]):
                    added[r].append((int(x - s.offs[r]), 3, int(y - s.offs[r])))
                counts, digests, lists = [], [], []
                for r, (own, more) in enumerate(zip(base, added)):
                    text = ""
                    every = ""
                    if own or more:
                        point = np.concatenate([[0], np.cumsum(C.POINT[s.buf[s.offs[r]:s.offs[r + 1]]])])
                        say = lambda spans: ",".join(f"{KINDS[k]}:{point[i]}:{point[j]}" for i, k, j in spans)
                        text, every = say(own), say(sorted(own + more))
                    counts.append([sum(k == kind for _, k, _ in own) for kind in range(3)])
                    digests.append(hashlib.sha256(text.encode()).hexdigest())
                    lists.append(every)
                counts = np.array(counts, dtype=np.int64).reshape(-1, 3)
                yield pa.RecordBatch.from_arrays([
                    rb.column("doc_id").slice(s.lo, s.rows()), *(C.int64s(counts[:, k].copy()) for k in range(3)),
                    pa.array(digests, pa.string()), pa.array(lists, pa.string())],
                    names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])
    return run


def find_secrets(docs: DataFrame, model: np.ndarray | None = None) -> DataFrame:
    """One row per document; spans are kind:start:end in code points, end exclusive."""
    ship_package(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), C.body(F.col("text")).alias("body"))
    return rows.mapInArrow(_scan(train(docs) if model is None else model), FOUND)


def secrets_query(spark, sf_dir: str) -> DataFrame:
    return find_secrets(C.table(spark, sf_dir, "documents"))
