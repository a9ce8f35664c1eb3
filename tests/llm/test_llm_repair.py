"""Conversation repair against a plain search for the cheapest, ASCII-least edits; segments, hot and awkward conversations."""
import collections
import hashlib
import random
import re
import zlib
from functools import lru_cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from hoprank.llm import repair as R

SCHEMA = "conv_id long, turn long, role string, text string"
CLASH = ("h", "copies", "sym", "ini", "seq", "i", "audit", "kind", "c", "t", "k", "d", "q", "r", "blank")


def h(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()


def brute_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        d = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if d == 0:
            continue
        text = "" if d == 1 else re.sub("[.!?]", "", text) if d == 2 else text
        out += [(conv, turn, "user" if d == 4 else role, text)] * (2 if d == 3 else 1)
    return out


def brute_repair(rows):
    """rows: role, text, must go, truncated -> cost, audit, messages."""
    n = len(rows)
    to = {"": "u", "s": "u", "u": "a", "a": "u"}

    @lru_cache(maxsize=None)
    def best(i, q, inserted):
        ways = []
        if i == n and q in ("", "a"):
            ways.append((0, "", ()))
        if inserted < 2:
            c, e, m = best(i, to[q], inserted + 1)
            ways.append((c + 3, "I" + e, ((to[q], None),) + m))
        if i < n:
            role, text, gone, late = rows[i]
            c, e, m = best(i + 1, q, 0)
            ways.append((c + 4, "D" + e, m))
            if not gone:
                r = role[:1]
                if r and (r == to[q] or (r == "s" and q == "")):
                    c, e, m = best(i + 1, r, 0)
                    ways.append((c + 3 * late, "K" + e, ((role, text),) + m))
                c, e, m = best(i + 1, to[q], 0)
                ways.append((c + 3 + 3 * late, "R" + e, (({"u": "user", "a": "assistant"}[to[q]], text),) + m))
        return min(ways, key=lambda w: w[:2], default=(10 ** 9, "", ()))
    return best(0, "", 0)


def brute(rows, damage=True):
    groups = collections.defaultdict(list)
    for r in (brute_damage(rows) if damage else rows):
        groups[r[0]].append(r[1:])
    out = {}
    for conv in {r[0] for r in rows}:
        mine = sorted(groups[conv], key=lambda r: (r[0] is not None, r[0] or 0, h(r[1], r[2])))
        seen, marked, count = set(), [], collections.Counter()
        for _, role, text in mine:
            body = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
            seen.add((role, text))
            count[fault] += 1
            marked.append((role, text, fault in ("blank", "duplicate"), fault == "truncated"))
        illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in zip(mine, mine[1:]))
        turns = {r[0] for r in mine if r[0] is not None}
        cost, audit, said = brute_repair(tuple(marked))
        body = "\n".join(f"{'user' if r == 'u' and t is None else 'assistant' if t is None else r}:{t or ''}" for r, t in said)
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, count["blank"], count["duplicate"],
                     count["truncated"], illegal, cost, audit, hashlib.sha256(body.encode()).hexdigest())
    return out


NAMES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def run(spark, rows, tmp_path, clash=True):
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    (df.withColumns({c: F.lit(7) for c in CLASH}) if clash else df).write.parquet(f"{tmp_path}/conversations.parquet")
    got = R.repair_query(spark, str(tmp_path)).collect()
    assert len({r["conv_id"] for r in got}) == len(got)
    return {r["conv_id"]: tuple(r[n] for n in NAMES) for r in got}


def random_rows(rng, n_conv, most, convs=None):
    texts = ["Yes.", "No!", "so it goes", "so it goes. \n", "", " \t", None, "é?", "…", "What is this?", "x\x85", "why.) "]
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None, "User"]
    return [(c, None if rng.random() < 0.03 else t, roles[min(rng.randrange(14), 8)] if rng.random() < 0.2 else
             ("user", "assistant")[(t + rng.randrange(5) // 4) % 2] if t or rng.random() < 0.5 else "system",
             rng.choice(texts) if rng.random() < 0.4 else f"{rng.randrange(10 ** 6)}{rng.choice(['.', '', '!'])}")
            for c in range(n_conv) for t in range(rng.randrange(1, most))]


@pytest.mark.parametrize("block", [1, 2, 4])
def test_tables_against_the_plain_search(block):
    rng, known = random.Random(block), R.Tables(block)
    assert len(known.vectors) < 200
    for n in [0, 1, 2, 3, 4, 5, 7, 8] * 25:
        sym = np.array([rng.randrange(9) for _ in range(n)], dtype=np.int8)
        rows = tuple((["s", "u", "a", "o"][(s - 1) % 4], "t", s == 0, s > 4) for s in sym)
        done, q = known.trace(sym, 0, R.START)
        cost, audit, _ = brute_repair(rows)
        end = known.end[q]
        assert (sum(d[4] for d in done) + 3 * len(end), "".join(d[0] for d in done) + "I" * len(end)) == (cost, audit), sym
        for cut in range(n + 1):                       # parts settled by their summaries
            (w, left), (_, right) = known.summary(sym[:cut]), known.summary(sym[cut:])
            v = known.summary(sym[cut:])[0][0]
            mid = left[v, R.START]
            a, m = known.trace(sym[:cut], int(v), R.START)
            b, z = known.trace(sym[cut:], 0, int(mid))
            assert m == mid and z == q == right[0, mid] and a + b == done and w[v] == known.summary(sym)[0][0]


@pytest.mark.parametrize("segment", [R.SEGMENT, 3])
def test_conversations_against_the_plain_search(spark, tmp_path, monkeypatch, segment):
    monkeypatch.setattr(R, "SEGMENT", segment)
    rng = random.Random(9)
    rows = random_rows(rng, 60, 9)
    rows += [(None, t, "user", f"n{t}.") for t in range(4)] + [(None, None, None, None)]
    rows += [(700, 0, "user", "same.")] * 9 + [(700, 1, "assistant", "same.")] * 3 + [(700, 2, "user", "same.")]      # repeated rows
    rows += [(701, 5, "user", f"tie {k}.") for k in range(6)]                                                          # ties
    rows += [(702, t, ("user", "assistant")[t % 2], "long " * 40_000 + f"{t}.") for t in range(3)]                     # very long
    rows += [(703, -2 ** 63, "user", "a."), (703, 2 ** 63 - 1, "assistant", "b.")]
    rows += [(704, t, ("user", "assistant")[(t // 2) % 2], f"{t}" + "."[: t % 3]) for t in range(120)]                 # many turns
    want = brute(rows)
    want = {c: ((None,) + v[1:] if v[0] >= 2 ** 63 else v) for c, v in want.items()}
    assert run(spark, rows, tmp_path) == want


def test_a_table_and_nothing(spark, tmp_path):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert run(spark, rows, tmp_path / "a", clash=False) == brute(rows)
    assert run(spark, [], tmp_path / "b") == {}
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    assert run(spark, [(gone, 0, "user", "all dropped.")], tmp_path / "c") == {
        gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_messages_are_the_repaired_conversations(spark):
    rng = random.Random(4)
    rows = random_rows(rng, 30, 8)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("copies", F.lit(1))
    said = collections.defaultdict(list)
    for r in R.messages(R.repair(df)).orderBy("seq", "i", "k").collect():
        said[r["conv_id"]].append((r["role"], r["text"]))
    plain = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    for conv, cells in brute(plain, damage=False).items():
        assert re.fullmatch("(s?(ua)+)?", "".join(r[0] for r, _ in said[conv]))
        assert hashlib.sha256("\n".join(f"{r}:{t}" for r, t in said[conv]).encode()).hexdigest() == cells[-1]
