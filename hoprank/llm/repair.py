"""Conversation structure repair: the cheapest edits to ``(s?(ua)+)?``, by Four-Russians block tables.

A row becomes one of nine symbols (must go; or one of four role initials, each
sound or truncated).  The costs still to come from the four states of the grammar
(nothing yet, after system, after user, after assistant) form a vector whose entries differ by
a few units only, so up to a common offset there are few vectors.  For every vector
and every block of BLOCK symbols a table holds the vector before the block.  A
conversation is read from its end, a lookup per block; then each block is expanded,
backward from the vector at its end, and traced forward.  In a state every letter of an
audit leads to one place, so taking the least letter that keeps the cost gives the
ASCII-least audit.

On Spark the texts stay out of it: rows travel as hashes and symbols, ordered by range
partitions, packed into segments of at most SEGMENT rows.  A conversation that spans
segments is settled by small summaries (for each vector after a segment: the vector
before it, and the state after it for each state before it), so that its segments are
traced in parallel.  Equal rows of a turn travel once, with a number.

Defined results.  A null role or text is one space; null ids are one conversation and
null turns stand first.  Rows of one turn stand in the order of a SHA-256 of role and
text; equal rows are adjacent.  A role other than those that begin with s, u or a (an
empty one too) can only be reroled or deleted.  Empty and very long texts are hashed
whole.  Other columns are not looked at; an empty table gives no rows.  The digest of a
conversation is a running hash, so its messages stream through one task in order
(bounded memory); all else of a hot conversation is spread.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from . import common as C

#: Symbols that one table lookup covers; rows in a segment.
BLOCK, SEGMENT = 4, 1 << 16
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: States of the grammar, and where the next user or assistant message leads.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = (USER, USER, ASSISTANT, USER)
MESSAGE = {USER: "u", ASSISTANT: "a"}
ROLES = {"u": "user", "a": "assistant"}
#: Symbol 0 must go; 1 + initial is sound, 5 + initial truncated; initials: s, u, a, any other.
SYMBOLS = 9
INITIALS = "sua"
NOT_BLANK, ENDS = r"[^\x20\x09-\x0D]", r"[.!?][\x20\x09-\x0D]*\z"

SEGMENTS = "conv_id long, whole boolean, turn array<long>, h array<binary>, copies array<long>, sym array<tinyint>, ini array<tinyint>"
EDITS = """conv_id long, turn long, h binary, seq long, i int, audit string, before string, kind int, after string, cost long,
 n_blank long, n_duplicate long, n_truncated long, n_illegal long"""


# ---------------------------------------------------------------- tables

def _inserted(v: list[float]) -> list[float]:
    for _ in range(3):
        v = [min(v[q], INSERT + v[NEXT[q]]) for q in range(4)]
    return v


def _moves(sym: int, q: int) -> list[tuple[str, int, int]]:
    """What can be done with a row in a state, by rising letters: letter, cost, next state."""
    moves = [("D", DELETE, q)]
    if sym:
        late, initial = TRUNCATED * (sym > 4), (sym - 1) % 4
        kept = {0: SYSTEM if q == START else None, 1: USER if q != USER else None, 2: ASSISTANT if q == USER else None, 3: None}[initial]
        if kept is not None:
            moves.append(("K", KEEP + late, kept))
        moves.append(("R", REROLE + late, NEXT[q]))
    return moves


def _before(sym: int, after: tuple[int, ...]) -> list[int]:
    """Costs to come before a row, from those after it."""
    return _inserted([min(cost + after[to] for _, cost, to in _moves(sym, q)) for q in range(4)])


def _normal(v: list) -> tuple[tuple[int, ...], int]:
    low = min(v)
    return tuple(int(x - low) for x in v), int(low)


def _traced(sym: int, after: tuple[int, ...], q: int) -> tuple[str, str, int, int, int]:
    """The least letters for a row: audit, inserted initials, kind (0 gone, 1 kept, 2 user, 3 assistant), state, cost."""
    costs, audit, inserted = _before(sym, after), "", ""
    spent = 0
    while True:
        ways = {letter: (cost, to) for letter, cost, to in _moves(sym, q) if cost + after[to] == costs[q]}
        if "D" not in ways and INSERT + costs[NEXT[q]] == costs[q]:
            audit, q = audit + "I", NEXT[q]
            inserted += MESSAGE[q]
            spent += INSERT
            continue
        letter = min(ways)
        cost, to = ways[letter]
        kind = {"D": 0, "K": 1}.get(letter, to)
        return audit + letter, inserted, kind, to, spent + cost


class Tables:
    """one[v][s], block[v][code]: the vector before a symbol or block; out[v][code][q]: the state after a block;
    step[v][s][q]: what is done with a row; v: the vector after it."""

    def __init__(self, block: int = BLOCK):
        self.size = block
        end, _ = _normal(_inserted([0, 99, 99, 0]))
        known, vectors, one = {end: 0}, [end], []
        for v in vectors:                            # grows while it is read
            row = []
            for s in range(SYMBOLS):
                w, _ = _normal(_before(s, v))
                if w not in known:
                    known[w] = len(vectors)
                    vectors.append(w)
                row.append(known[w])
            one.append(row)
        self.vectors, self.one = vectors, one
        self.step = [[[_traced(s, v, q) for q in range(4)] for s in range(SYMBOLS)] for v in vectors]
        self.end = [self._end(q) for q in range(4)]
        first = np.array(one)                                        # [v, s]
        state = np.array([[[self.step[v][s][q][3] for q in range(4)] for s in range(SYMBOLS)] for v in range(len(vectors))])
        ids, out = first, state
        for _ in range(block - 1):                                   # one more symbol in front
            longer = first[ids]                                      # [v, rest, s]: the vector before s, rest
            to = state[ids]                                          # [v, rest, s, q]: after s
            v, rest = np.indices(ids.shape)
            out = out[v[..., None, None], rest[..., None, None], to]
            ids = longer.transpose(0, 2, 1).reshape(len(vectors), -1)
            out = out.transpose(0, 2, 1, 3).reshape(len(vectors), -1, 4)
        self.ids, self.out, self._first, self._state = ids, out, first, state
        self.block = ids.tolist()
        self.powers = SYMBOLS ** np.arange(block - 1, -1, -1)

    @staticmethod
    def _end(q: int) -> str:
        inserted = ""
        while q not in (START, ASSISTANT):
            q = NEXT[q]
            inserted += MESSAGE[q]
        return inserted

    def codes(self, sym: np.ndarray) -> np.ndarray:
        """Codes of the whole blocks; the symbols after them stand alone."""
        return sym[:len(sym) // self.size * self.size].reshape(-1, self.size).astype(np.int64) @ self.powers

    def trace(self, sym: np.ndarray, right: int, q: int) -> tuple[list[tuple], int]:
        """What is done with each row of a segment, and the state after it."""
        codes, rows = self.codes(sym).tolist(), sym.tolist()
        at, w, ends = len(codes) * self.size, right, []
        rest = rows[at:]
        for s in reversed(rest):
            w = self.one[w][s]
        for code in reversed(codes):
            ends.append(w)
            w = self.block[w][code]
        done = []
        for lo, w in [*zip(range(0, at, self.size), reversed(ends)), (at, right)]:
            part = rows[lo:lo + self.size] if lo < at else rest
            after = [w]
            for s in reversed(part[1:]):
                after.append(self.one[after[-1]][s])
            for s, v in zip(part, reversed(after)):
                did = self.step[v][s][q]
                done.append(did)
                q = did[3]
        return done, q

    def summary(self, sym: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each vector after a segment: the vector before it, and the state after it by the state before it."""
        codes = self.codes(sym)
        rest = sym[len(codes) * self.size:]
        w = np.arange(len(self.vectors))
        tail = []
        for s in rest[::-1]:
            tail.append(w)
            w = self._first[w, s]
        ends = []
        for code in codes[::-1]:
            ends.append(w)
            w = self.ids[w, code]
        q = np.tile(np.arange(4), (len(self.vectors), 1))
        for code, v in zip(codes, reversed(ends)):
            q = self.out[v[:, None], code, q]
        for s, v in zip(rest, reversed(tail)):
            q = self._state[v[:, None], s, q]
        return w, q


@lru_cache(maxsize=1)
def tables() -> Tables:
    return Tables()


# ---------------------------------------------------------------- segments

def skeleton(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies -> one row for equal rows of a turn, with h and what its text looks like, written."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit(" ")), F.coalesce(F.col("text").cast("string"), F.lit(" "))
    plain = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                        role.alias("role"), text.alias("text"), F.col("copies").cast("long").alias("copies"))
    h = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256))
    grouped = plain.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    initial = F.expr(f"locate(substring(role, 1, 1), '{INITIALS}') - 1")
    return C.written(grouped.select("*", h.alias("h"), (~F.col("text").rlike(NOT_BLANK)).alias("blank"),
                                    (~F.col("text").rlike(ENDS)).alias("cut"),
                                    F.when((F.length("role") == 0) | (initial < 0), 3).otherwise(initial).alias("initial")), "turns")


def _pack(batches):
    """Sorted rows of a partition -> segments: whole conversations, or parts of those at an edge or too long."""
    held, first, cut = None, True, False

    def segments(t: pa.Table, bounds: list[int], whole: list[bool]):
        offs = pa.array(np.array(bounds, dtype=np.int32))

        def listed(name):
            return pa.ListArray.from_arrays(offs, t.column(name).combine_chunks())
        return pa.RecordBatch.from_arrays(
            [t.column("conv_id").combine_chunks().take(pa.array(bounds[:-1], pa.int64())), pa.array(whole)]
            + [listed(c) for c in ("turn", "h", "copies", "sym", "ini")],
            names=["conv_id", "whole", "turn", "h", "copies", "sym", "ini"])

    for rb in batches:
        if not rb.num_rows:
            continue
        t = pa.Table.from_batches([rb])
        t = (pa.concat_tables([held, t]) if held is not None else t).combine_chunks()
        conv = t.column("conv_id").combine_chunks()
        ids, null = conv.fill_null(0).to_numpy(), conv.is_null().to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]) | (null[1:] != null[:-1])]))
        last = int(starts[-1])
        if last:                                     # all but the last conversation are complete
            whole = [True] * (len(starts) - 1)
            whole[0] = not (first or cut)
            yield segments(t.slice(0, last), starts.tolist(), whole)
            first = cut = False
        held = t.slice(last)
        while held.num_rows >= SEGMENT:
            yield segments(held.slice(0, SEGMENT), [0, SEGMENT], [False])
            held, cut = held.slice(SEGMENT), True
    if held is not None and held.num_rows:
        yield segments(held, [0, held.num_rows], [False])


def segments(turns: DataFrame) -> DataFrame:
    """The symbols of all rows in conversation order, packed into segments numbered by ``seq``, written."""
    firsts = (turns.groupBy("conv_id", "h").agg(F.min(F.struct(F.col("turn").isNotNull(), F.col("turn"))).alias("m"))
              .select(F.col("conv_id").alias("c"), F.col("h").alias("k"), F.col("m.turn").alias("t")))
    rows = turns.drop("role", "text").join(
        firsts, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("h") == F.col("k")) & F.col("turn").eqNullSafe(F.col("t")), "left")
    sym = F.when(F.col("blank") | F.col("k").isNull(), 0).otherwise(1 + F.col("initial") + F.when(F.col("cut"), 4).otherwise(0))
    ini = F.col("initial") + F.when(F.col("blank"), 4).otherwise(0)
    keys = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), F.asc("h")]
    ordered = (rows.select("conv_id", "turn", "h", "copies", sym.cast("tinyint").alias("sym"), ini.cast("tinyint").alias("ini"))
               .repartitionByRange(*keys).sortWithinPartitions(*keys))
    return C.written(ordered.mapInArrow(_pack, SEGMENTS).withColumn("seq", F.monotonically_increasing_id()), "segments")


def _lists(rb: pa.RecordBatch, name: str):
    """Each row's list as a slice of one array."""
    col = rb.column(name)
    offs, flat = col.offsets.to_numpy(), col.values
    return [flat.slice(a, b - a) for a, b in zip(offs, offs[1:])]


def _summaries(batches):
    known = tables()
    for rb in batches:
        got = []
        for sym, ini in zip(_lists(rb, "sym"), _lists(rb, "ini")):
            w, q = known.summary(sym.to_numpy())
            got.append((w.astype(np.int16).tobytes(), q.astype(np.int8).tobytes(), ini[len(ini) - 1].as_py() % 4))
        yield pa.RecordBatch.from_arrays([rb.column("conv_id"), rb.column("seq"), C.binary_array([g[0] for g in got]),
                                          C.binary_array([g[1] for g in got]), pa.array([g[2] for g in got], pa.int32())],
                                         names=["conv_id", "seq", "vectors", "states", "final"])


def _settle(t: pa.Table) -> pa.Table:
    """The summaries of one conversation -> for each segment the vector after it, the state and initial before it."""
    t = t.sort_by("seq")
    vectors = [np.frombuffer(b, np.int16) for b in t.column("vectors").to_pylist()]
    states = [np.frombuffer(b, np.int8).reshape(-1, 4) for b in t.column("states").to_pylist()]
    right, w = [], 0                                 # vector 0 stands at the end of a conversation
    for v in reversed(vectors):
        right.append(w)
        w = int(v[w])
    right.reverse()
    state, q = [], START
    for s, w in zip(states, right):
        state.append(q)
        q = int(s[w, q])
    n = t.num_rows
    final = t.column("final").to_pylist()
    return pa.table({"seq": t.column("seq"), "r": pa.array(right, pa.int32()), "q": pa.array(state, pa.int32()),
                     "prev": pa.array([None, *final[:-1]], pa.int32()), "last": pa.array([k == n - 1 for k in range(n)])})


def _trace(batches):
    known = tables()
    for rb in batches:
        if not rb.num_rows:
            continue
        whole, seq = rb.column("whole").to_pylist(), rb.column("seq").to_numpy()
        right, state = rb.column("r").to_pylist(), rb.column("q").to_pylist()
        prev, final = rb.column("prev").to_pylist(), rb.column("last").to_pylist()
        copies = _lists(rb, "copies")
        audit, before, kind, after, cost, place = [], [], [], [], [], []
        blank, duplicate, truncated, illegal = [], [], [], []
        for j, (sym, ini) in enumerate(zip(_lists(rb, "sym"), _lists(rb, "ini"))):
            sym, ini, many = sym.to_numpy(), ini.to_numpy(), copies[j].to_numpy()
            done, q = known.trace(sym, 0 if whole[j] else right[j], START if whole[j] else state[j])
            for k, (did, m) in enumerate(zip(done, many.tolist())):
                audit.append(did[0] + "D" * (m - 1))
                before.append(did[1])
                kind.append(did[2])
                cost.append(did[4] + DELETE * (m - 1))
                after.append("")
            if whole[j] or final[j]:
                after[-1] = known.end[q]
                audit[-1] += "I" * len(after[-1])
                cost[-1] += INSERT * len(after[-1])
            place.append(np.arange(len(sym)))
            gone = ini >= 4
            blank.append(np.where(gone, many, 0))
            duplicate.append(np.where(gone, 0, many - (sym > 0)))
            truncated.append((sym > 4).astype(np.int64))
            role = ini % 4
            left = np.concatenate([[-1 if whole[j] or prev[j] is None else prev[j]], role[:-1]])
            legal = (left < 0) | ((left == 0) & (role == 1)) | ((left == 1) & (role == 2)) | ((left == 2) & (role == 1))
            illegal.append(many - 1 + ~legal)
        size = [len(p) for p in place]
        owner = pa.array(np.repeat(np.arange(rb.num_rows), size))
        yield pa.RecordBatch.from_arrays([
            rb.column("conv_id").take(owner), rb.column("turn").flatten(), rb.column("h").flatten(), pa.array(np.repeat(seq, size)),
            pa.array(np.concatenate(place).astype(np.int32)), pa.array(audit, pa.string()), pa.array(before, pa.string()), pa.array(kind, pa.int32()),
            pa.array(after, pa.string()), pa.array(cost, pa.int64()), *(C.int64s(np.concatenate(x)) for x in (blank, duplicate, truncated, illegal))],
            names=["conv_id", "turn", "h", "seq", "i", "audit", "before", "kind", "after", "cost",
                   "n_blank", "n_duplicate", "n_truncated", "n_illegal"])


def repair(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies -> what is done with each row, in the order (conv_id, seq, i), written.

    audit: its letters, with those of its copies and of insertions; before, after: initials of inserted messages;
    role and text of the message that stays (null if it goes); cost; its faults.
    """
    ship_package(rows.sparkSession)
    turns = skeleton(rows)
    packed = segments(turns)
    part = packed.filter(~F.col("whole"))
    settled = C.written(part.select("conv_id", "seq", "sym", "ini")
                        .mapInArrow(_summaries, "conv_id long, seq long, vectors binary, states binary, final int")
                        .groupBy("conv_id").applyInArrow(_settle, "seq long, r int, q int, prev int, last boolean"), "settled")
    none = [F.lit(None).cast(t).alias(c) for c, t in (("r", "int"), ("q", "int"), ("prev", "int"), ("last", "boolean"))]
    ready = packed.filter("whole").select("*", *none).unionByName(part.join(settled, "seq"))
    edits = C.written(ready.mapInArrow(_trace, EDITS), "edits")
    texts = turns.select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), F.col("h").alias("k"),
                         F.col("role").alias("old"), F.col("text").alias("body"))
    joined = edits.join(texts, F.col("conv_id").eqNullSafe(F.col("c")) & F.col("turn").eqNullSafe(F.col("t")) & (F.col("h") == F.col("k")))
    role = F.when(F.col("kind") == 1, F.col("old")).when(F.col("kind") == USER, "user").when(F.col("kind") == ASSISTANT, "assistant")
    return C.written(joined.select(*edits.columns, role.alias("role"), F.when(F.col("kind") > 0, F.col("body")).alias("text")), "repaired")


def messages(repaired: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, seq, i, k (their order), role, text, inserted."""
    def made(col):
        return F.transform(F.filter(F.split(col, ""), lambda x: x != ""),
                           lambda x: F.struct(F.when(x == "u", "user").otherwise("assistant").alias("role"), F.lit("").alias("text"), F.lit(True).alias("inserted")))
    own = F.array(F.struct("role", "text", F.lit(False).alias("inserted")))
    kept = F.filter(own, lambda x: x["role"].isNotNull())
    return (repaired.select("conv_id", "seq", "i", F.posexplode(F.concat(made(F.col("before")), kept, made(F.col("after")))).alias("k", "m"))
            .select("conv_id", "seq", "i", "k", "m.role", "m.text", "m.inserted"))


# ---------------------------------------------------------------- the query

def damaged(conversations: DataFrame) -> DataFrame:
    """The rows after the damage that crc32(conv_id:turn) % 20 deals."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    rows = conversations.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"),
                                (F.crc32(key) % 20).alias("d"))
    return rows.filter("d <> 0").select(
        "conv_id", "turn", F.when(F.col("d") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("d") == 1, "").when(F.col("d") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("d") == 3, 2).otherwise(1).alias("copies"))


DIGEST = """conv_id long, gaps long, n_blank long, n_duplicate long, n_truncated long, n_illegal long, cost long, audit string,
 repaired_sha256 string"""
FAULTS = ("n_blank", "n_duplicate", "n_truncated", "n_illegal", "cost")


def _digest(batches):
    """Rows in the order of their conversations -> a row for each conversation; holds one hash and one audit."""
    conv, out = None, []

    def close():
        low, high, distinct = turns
        gaps = high - low + 1 - distinct if distinct else 0
        out.append((conv[0], gaps if gaps < 2 ** 63 else None, *sums, "".join(letters), sha.hexdigest()))

    def flush():
        cols = list(zip(*out))
        batch = pa.RecordBatch.from_arrays(
            [pa.array(c, pa.int64()) for c in cols[:7]] + [pa.array(c, pa.string()) for c in cols[7:]],
            names=["conv_id", "gaps", *FAULTS, "audit", "repaired_sha256"])
        out.clear()
        return batch

    for rb in batches:
        col = {name: rb.column(name).to_pylist() for name in ("conv_id", "turn", "audit", "before", "after", "role", "text", *FAULTS)}
        for k in range(rb.num_rows):
            if conv is None or conv[0] != col["conv_id"][k]:
                if conv is not None:
                    close()
                conv, sums, letters, sha, turns, lead = (col["conv_id"][k],), [0] * len(FAULTS), [], hashlib.sha256(), (None, None, 0), ""
            letters.append(col["audit"][k])
            sums = [a + col[name][k] for a, name in zip(sums, FAULTS)]
            turn = col["turn"][k]
            if turn is not None and turn != turns[1]:
                turns = (turn if turns[0] is None else turns[0], turn, turns[2] + 1)
            said = [(ROLES[x], "") for x in col["before"][k]]
            said += [(col["role"][k], col["text"][k])] if col["role"][k] is not None else []
            for role, text in said + [(ROLES[x], "") for x in col["after"][k]]:
                sha.update(f"{lead}{role}:{text}".encode())
                lead = "\n"
        if out:
            yield flush()
    if conv is not None:
        close()
        yield flush()


def digests(repaired: DataFrame) -> DataFrame:
    """The contract's columns for every conversation that has rows, written."""
    keys = [F.asc_nulls_first("conv_id"), F.asc("seq"), F.asc("i")]
    rows = repaired.select("conv_id", "seq", "i", "turn", "audit", "before", "after", "role", "text", *FAULTS)
    return C.written(rows.repartition("conv_id").sortWithinPartitions(*keys).mapInArrow(_digest, DIGEST), "digests")


def repair_query(spark, sf_dir: str) -> DataFrame:
    conversations = C.table(spark, sf_dir, "conversations")
    found = digests(repair(damaged(conversations))).withColumnRenamed("conv_id", "c")
    every = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    zero = [F.when(F.col("repaired_sha256").isNull(), F.lit(0)).otherwise(F.col(name)).cast("long").alias(name.removeprefix("n_"))
            for name in ("gaps", *FAULTS)]
    return every.join(found, F.col("conv_id").eqNullSafe(F.col("c")), "left").select(
        "conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
