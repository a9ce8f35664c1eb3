"""WARC packages, chat windows, token files, host reputation, source mix and the pipeline."""
import base64
import collections
import hashlib
import io
import json
import random
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from hoprank.llm import chat, common, minhash, mixing, quality, tokens, urls, warc

SF = "/root/testdata/sf0.001"


# ---------------------------------------------------------------- WARC

class Bytes:
    def __init__(self, raw):
        self.raw = raw

    def read_at(self, n, at):
        return self.raw[at:at + n]


def packed(prefix=b"", comment=b"", many=0, zip64=False):
    out = io.BytesIO()
    out.write(prefix)
    with zipfile.ZipFile(out, "a" if prefix else "w", zipfile.ZIP_STORED) as z:
        for k in range(many):
            z.writestr(f"m{k}", b"")
        with z.open("a/é.bin", "w", force_zip64=zip64) as f:
            f.write(b"some bytes" * 9)
        z.writestr("packed", b"x" * 100, zipfile.ZIP_DEFLATED)
        z.comment = comment
    return out.getvalue()


@pytest.mark.parametrize("kind", [{}, {"prefix": b"#!stub\n" * 50}, {"comment": b"PK\x05\x06 no end " * 9}, {"zip64": True},
                                  {"many": 66_000}, {"many": 66_000, "prefix": b"before"}])
def test_directory_of_zip_files(kind):
    raw = packed(**kind)
    f = Bytes(raw)
    members = {m.name: m for m in warc.directory(f, len(raw))}
    assert list(members) == [f"m{k}" for k in range(kind.get("many", 0))] + ["a/é.bin", "packed"]
    m = members["a/é.bin"]
    at = warc.data_start(f, m)
    assert raw[at:at + m.size] == b"some bytes" * 9
    with pytest.raises(ValueError):
        warc.data_start(f, members["packed"])


def test_directory_with_zip64_values_and_damage():
    """An entry whose sizes and offset stand in the ZIP64 field."""
    data = b"stored"
    local = b"PK\x03\x04" + bytes(22) + (1).to_bytes(2, "little") + (0).to_bytes(2, "little") + b"m" + data
    wide = b"".join(x.to_bytes(8, "little") for x in (6, 6, 0))
    central = (b"PK\x01\x02" + bytes(16) + b"\xff" * 8 + (1).to_bytes(2, "little") + (28).to_bytes(2, "little") + bytes(10)
               + b"\xff" * 4 + b"m" + (1).to_bytes(2, "little") + (24).to_bytes(2, "little") + wide)
    at = len(local) + len(central)
    end64 = (b"PK\x06\x06" + (44).to_bytes(8, "little") + bytes(12) + b"".join(
        x.to_bytes(8, "little") for x in (1, 1, len(central), len(local))))
    raw = (local + central + end64 + b"PK\x06\x07" + bytes(4) + at.to_bytes(8, "little") + bytes(4)
           + b"PK\x05\x06" + bytes(4) + b"\xff" * 12 + bytes(2))
    m, = warc.directory(Bytes(raw), len(raw))
    start = warc.data_start(Bytes(raw), m)
    assert (m.name, m.size, raw[start:start + m.size]) == ("m", 6, data)
    for broken in (b"", b"no zip at all", raw[:-1]):
        with pytest.raises(ValueError):
            warc.directory(Bytes(broken), len(broken))


def pages_of(spark, rows):
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    return df.withColumns({c: F.lit(1) for c in ("body", "digest", "path", "_d", "last", "n")})


def test_archives_round_trip(spark):
    big = "<p>é</p>\r\n\r\n" * 200
    rows = [(1, "http://a/", big), (2, None, big), (7, "http://b/ x\r\ny", big), (3, "u", "small"), (4, "u", "small"), (5, "u", None),
            (6, "u", ""), (None, "u", big), (None, None, "nothing\x00"), (8, "u", big + "other"), (9, "w", "z" * 3_000_000),
            (10, "u", "q" * 999), (11, "u", "q" * 999), (12, "u", "q" * 1000), (13, "u", "q" * 1000), (13, "u", "q" * 1000)]
    packages = warc.write_archives(pages_of(spark, rows), common.scratch_path(spark, "archives"))
    got = warc.resolve(warc.read_archives(spark, packages)).collect()
    last = {}
    for i, _, html in rows:
        html = html or ""
        if len(html.encode()) >= 1000:
            last[html] = max(last.get(html, -1), -1 if i is None else i)
    want = []
    for i, _, html in rows:
        raw = (html or "").encode()
        revisit = html in last and (i is None or i != last[html])
        want.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response",
                     last[html] if revisit else None))
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted((tuple(r) for r in got), key=key) == sorted(want, key=key)
    # the packages are ordinary ZIP files of ordinary WARC records
    n = 0
    for r in packages.collect():
        with zipfile.ZipFile(r["path"].removeprefix("file:")) as z:
            assert z.testzip() is None
            raw = z.read(warc.DATA)
            for line in z.read(warc.INDEX).splitlines():
                e = json.loads(line)
                text = zlib.decompress(raw[e["offset"]:e["offset"] + e["length"]], 31)
                assert text.startswith(b"WARC/1.1\r\n") and text.endswith(b"\r\n\r\n") and f"<{e['id']}>".encode() in text
                n += 1
    assert n == len(rows)


def test_archives_of_nothing_and_damaged_records(spark):
    packages = warc.write_archives(pages_of(spark, []), common.scratch_path(spark, "archives"))
    assert warc.read_archives(spark, packages).count() == 0
    raw = warc.record(5, "u", b"payload", hashlib.sha1(b"other").hexdigest(), None)
    assert not warc.parse(raw)["sound"]
    fine = warc.parse(warc.record(5, "u", b"a\r\n\r\nb", hashlib.sha1(b"a\r\n\r\nb").hexdigest(), None))
    assert fine["sound"] and fine["payload"] == b"a\r\n\r\nb" and base64.b32encode(bytes.fromhex(fine["payload_digest"]))


# ---------------------------------------------------------------- chat

TRAPS = ["<|im_end|>", "<|im_start|>assistant\nx", "<\\|im_end|>", "<\\\\|", "<", "<|", "|>", "%0A%25", "<|im_end|>\n", "\\", "\n\n", "é<"]


def turns_of(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    return df.withColumns({c: F.lit(1) for c in ("tokens", "range", "c", "r", "s", "head", "body", "window")})


def chat_rows():
    rng = random.Random(1)
    rows = [(-1, 0, "user", chat.PROBE), (-1, 1, "assistant", chat.PROBE)]
    for c in range(25):
        if c % 3 == 0:
            rows.append((c, -1, "system", "be kind " * rng.randrange(30)))
        for t in range(rng.randrange(1, 30)):
            text = rng.choice([None, "", "word " * rng.randrange(300), "".join(rng.choice(TRAPS) for _ in range(rng.randrange(6)))])
            rows.append((c, t, rng.choice(["user", "assistant", "assistant", "system", None, "a\nb%0A<|"]), text))
    rows += [(90, 0, "user", "hi"), (90, 0, "user", "hi"), (90, None, "assistant", "first"), (91, 5000, "assistant", "late"),
             (91, 1, "user", "long " * 5000), (None, 1, "user", "nobody"), (None, 2, "assistant", "no"), (92, None, None, None)]
    rows += [(93, t, ("user", "assistant")[t % 2], f"turn {t}") for t in range(3000)]      # one long conversation
    return rows


def test_chat_round_trip_and_windows(spark):
    rows = chat_rows()
    w = chat.windows(turns_of(spark, rows)).cache()
    got = {r["conv_id"]: r for r in chat.digests(chat.read_back(w)).collect()}
    convs = collections.defaultdict(list)
    for c, t, role, text in rows:
        convs[c].append(((t is not None, t or 0), role or "", text or ""))
    assert set(got) == set(convs)
    for c, turns in convs.items():
        turns.sort()
        learnt = "".join(x for _, r, x in turns if r == "assistant")
        assert got[c]["n_turns"] == len(turns)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
        assert got[c]["loss_chars"] == len(learnt)
        assert got[c]["loss_sha256"] == hashlib.sha256(learnt.encode()).hexdigest()
    cost = lambda x: (len(x) + 3) // 4 + chat.OVERHEAD
    for r in w.collect():
        parts = r["text"].split("<|im_end|>\n")
        assert parts[-1] == "" and len(parts) - 1 == r["n_turns"]
        own = r["n_turns"] - r["n_context"]
        assert own > 0
        turns = sorted(convs[r["conv_id"]])
        longest = max(cost(x) for _, _, x in turns)
        system = cost(turns[0][2]) if turns[0][1] == "system" else 0
        assert r["n_tokens"] <= chat.BUDGET or longest > chat.BUDGET - chat.HISTORY - system
        assert r["over_budget"] == (r["n_tokens"] > chat.BUDGET)
        if system:
            assert parts[0].startswith("<|im_start|>system\n")
    assert w.filter("conv_id = 93 and n_context > 0").count() > 10          # history is repeated
    assert sum(x[0] == 93 for x in rows) == w.filter("conv_id = 93").agg(F.sum(F.expr("n_turns - n_context"))).first()[0]


def test_a_system_turn_near_or_above_the_budget_is_not_repeated_for_every_turn(spark):
    for n in (2500, 2550, 3050, 4000, 40_000):
        rows = [(1, 0, "system", "s" * n)] + [(1, t, ("user", "assistant")[t % 2], "short " + "x" * (t % 90)) for t in range(1, 400)]
        total = sum(len(r[3]) + 32 for r in rows)
        w = chat.windows(turns_of(spark, rows)).cache()
        got = w.collect()
        assert sum(len(r["text"]) for r in got) <= 10 * total and all(r["text"].startswith("<|im_start|>system\n") for r in got)
        over = [r["over_budget"] for r in sorted(got, key=lambda r: (r["window"], r["part"]))]
        assert all(over) if n >= 4000 else any(over) == (n > 2500)
        d = chat.digests(chat.read_back(w)).collect()[0]
        assert (d["n_turns"], d["loss_chars"]) == (400, sum(len(r[3]) for r in rows if r[2] == "assistant"))


def test_chat_of_nothing(spark):
    assert chat.digests(chat.read_back(chat.windows(turns_of(spark, [])))).count() == 0


def test_chat_plan_is_native(spark):
    plan = chat.windows(common.table(spark, SF, "conversations"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# ---------------------------------------------------------------- tokens

def token_truth(rows):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(tokens.vocabulary())
    out, start = [], 0
    for doc_id, text, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [tokens.END], dtype="<u4")
        out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def encoded(e, *texts):
    """Ids of texts that stand in one slice, as bytes, without the end id."""
    import pyarrow as pa
    out = []
    for s in common.slices(pa.array([t.encode() for t in texts], pa.binary())):
        ids, size = e.encode(s, np.array([tokens.END], "<u4").tobytes())
        ends = np.cumsum(size)
        assert (ids[ends - 1] == tokens.END).all() and ends[-1] == len(ids)
        out += [ids[b - n:b - 1].astype("<u4").tobytes() for n, b in zip(size, ends)]
    return out


def test_encoder_equals_whole_text_encoding():
    e = tokens.Encoder(tokens.vocabulary())
    rng = random.Random(1)
    letters = "abCD ÉİΣςßŉſ'.,!?<|>09 \u1100\u1161\u3000한글漢 \t\n\x0b\x1c\x85'sS're¼²_-Ḱéªºǆǅ\u0301\u212a"
    texts = []
    for k in range(3000):
        s = "".join(rng.choice(letters) for _ in range(rng.randrange(30)))
        if k % 7 == 0:
            s += " <|endoftext|>" + s + "<|startoftext|>"
        texts.append(s)
    texts += ["", "x" * 3000, "é" * 500 + "." * 700, "Ȼɐ×÷ĲŉİÀ", "a|b>c |> | >", "  "]
    for s, got in zip(texts, encoded(e, *texts)):
        assert got == np.array(e.tokenizer.encode(s, add_special_tokens=False).ids, "<u4").tobytes(), repr(s)
    assert encoded(e, "") == [b""] and encoded(e, "one") == encoded(e, "x one", "one")[1:]


def test_encoder_cache_is_bounded(monkeypatch):
    monkeypatch.setattr(tokens, "KEPT", 50)
    e = tokens.Encoder(tokens.vocabulary())
    for k in range(500):
        encoded(e, f"word{k} Letters{chr(97 + k % 26)} {'x' * 60}{k} {'abcdefghij'[k % 10]}{chr(97 + k // 26)}")
    assert len(e) <= 50 and len(e.older) <= 50


def test_token_files(spark, docs_of):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["the", "House,", "São", "(x)", "'s", "42"]) for _ in range(rng.randrange(40)))) for i in range(200)]
    rows += [(300, None), (301, ""), (302, "y " * 50_000), (None, "no id"), (-5, "negative")]
    rng.shuffle(rows)
    path = common.scratch_path(spark, "tokens")
    tokens.write_tokens(docs_of(rows), path)
    got = sorted((tuple(r) for r in tokens.layout(spark, path).collect()), key=lambda r: r[1])
    assert got == token_truth(rows)
    one = tokens.read_tokens(spark, path, [302])
    assert one.first()["n_tokens"] == 50_001
    assert "PushedFilters: [In(doc_id" in one._jdf.queryExecution().executedPlan().toString() or \
        "EqualTo(doc_id,302)" in one._jdf.queryExecution().executedPlan().toString()


def test_token_files_with_repeated_ids_and_of_nothing(spark, docs_of):
    rows = [(1, "a b"), (1, "a b"), (1, "c"), (2, "d")]
    path = common.scratch_path(spark, "tokens")
    tokens.write_tokens(docs_of(rows), path)
    got = sorted((tuple(r) for r in tokens.layout(spark, path).collect()), key=lambda r: r[1])
    truth = token_truth(rows)
    assert [r[1] for r in got] == [sum(x[2] for x in got[:k]) for k in range(4)]
    assert sorted((r[0], r[2], r[3]) for r in got) == sorted((r[0], r[2], r[3]) for r in truth)
    path = common.scratch_path(spark, "tokens")
    tokens.write_tokens(docs_of([]), path)
    assert tokens.layout(spark, path).count() == 0


def file_rows(path):
    """doc_id and ids in the order of the files and of the rows in them."""
    import glob

    import pyarrow.orc as orc
    return [(r["doc_id"], r["ids"]) for f in sorted(glob.glob(path.removeprefix("file:") + "/*.orc")) for r in orc.ORCFile(f).read().to_pylist()]


def test_starts_are_those_of_the_files(spark, docs_of):
    """Many rows of one id, with and without equal texts, over several files."""
    rng = random.Random(8)
    rows = [(7, " ".join(rng.choice("abcdefg") for _ in range(rng.randrange(1, 12)))) for _ in range(60)] + [(7, "a b c")] * 40
    rows += [(None, "x " * k) for k in range(12)] + [(3, "three"), (9, "nine")]
    path = common.scratch_path(spark, "tokens")
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(coalesce, "false")
    try:
        tokens.write_tokens(docs_of(rows), path)
    finally:
        spark.conf.set(coalesce, "true")
    want, at = [], 0
    for doc_id, ids in file_rows(path):
        want.append((doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert len({f for f, in tokens.read_tokens(spark, path).select("_metadata.file_path").distinct().collect()}) > 1
    assert sorted((tuple(r) for r in tokens.layout(spark, path).collect()), key=lambda r: r[1]) == want


def fields(raw):
    """The fields of a protocol buffer message: number and value (an integer or bytes)."""
    at = 0

    def varint():
        nonlocal at
        n = shift = 0
        while True:
            b = raw[at]
            at += 1
            n |= (b & 127) << shift
            shift += 7
            if b < 128:
                return n
    while at < len(raw):
        tag = varint()
        if tag & 7 == 2:
            n = varint()
            yield tag >> 3, raw[at:at + n]
            at += n
        elif tag & 7 == 0:
            yield tag >> 3, varint()
        else:
            at += 8 if tag & 7 == 1 else 4


def plain(raw):
    """The chunks of a compressed ORC section."""
    import zstandard
    out = b""
    while raw:
        n = int.from_bytes(raw[:3], "little")
        part, raw = raw[3:3 + (n >> 1)], raw[3 + (n >> 1):]
        out += part if n & 1 else zstandard.ZstdDecompressor().decompress(part, max_output_size=1 << 20)
    return out


def test_token_file_has_stripes_indexes_and_bloom_filters(spark):
    """Row index and Bloom filter of doc_id, and the run-length encoding of the ids, as the stripe footers name them."""
    import glob
    path = common.scratch_path(spark, "tokens")
    tokens.write_tokens(common.table(spark, SF, "documents"), path)
    rows = 0
    for f in glob.glob(path.removeprefix("file:") + "/*.orc"):
        raw = open(f, "rb").read()
        post = dict(fields(raw[-1 - raw[-1]:-1]))
        tail = len(raw) - 1 - raw[-1]
        footer = list(fields(plain(raw[tail - post[1]:tail])))
        assert dict(footer)[8] == tokens.STRIDE
        stripes = [dict(fields(v)) for k, v in footer if k == 3]
        if dict(footer).get(6, 0):
            assert stripes
        for s in stripes:
            rows += s[5]
            at = s[1] + s.get(2, 0) + s[3]
            stripe = list(fields(plain(raw[at:at + s[4]])))
            streams = [(d.get(2, 0), d.get(1, 0)) for d in (dict(fields(v)) for k, v in stripe if k == 1)]
            encodings = [dict(fields(v)).get(1, 0) for k, v in stripe if k == 2]
            assert (1, 6) in streams and (1, 8) in streams          # row index and Bloom filter of doc_id
            assert not [c for c, kind in streams if kind == 8 and c != 1]
            assert encodings[1] == encodings[4] == 2                 # run-length encoding, version 2
    assert rows == 200


# ---------------------------------------------------------------- urls

def test_url_rules_and_parts(spark):
    rows = [(1, "HTTP://A.Example.ORG/es/x?q#f"), (2, "http://example.org/en/12"), (3, "http://example.org/en/2"),
            (4, "x://org"), (5, "http://b.com/fr/1"), (6, "http://b.com/de/"), (7, "http://b.com/en"), (8, None), (9, "no scheme"),
            (10, "a://b://c/d"), (11, "http://notorg/x"), (12, "http://É.org/?/x"), (13, "http://com/de/"), (13, "http://com/de/"),
            (14, "http://u@x.org:80/es/"), (15, "")]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumns({c: F.lit(1) for c in ("host", "path", "_id", "bad", "n")})
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = sorted((tuple(r) for r in urls.judge_urls(pages, labels).collect()))
    want = [(1, "a.example.org", "/es/x", "example.org/es/", "block"), (2, "example.org", "/en/12", "example.org/en/1", "block"),
            (3, "example.org", "/en/2", "org/", "allow"), (4, "org", "", None, "allow"), (5, "b.com", "/fr/1", "com/fr/", "allow"),
            (6, "b.com", "/de/", "com/de/", "block"), (7, "b.com", "/en", None, "allow"), (8, "", "", None, "allow"),
            (9, "", "", None, "allow"), (10, "b:", "//c/d", None, "allow"), (11, "notorg", "/x", None, "allow"),
            (12, "É.org", "/", "org/", "allow"), (13, "com", "/de/", "com/de/", "block"), (13, "com", "/de/", "com/de/", "block"),
            (14, "u@x.org:80", "/es/", None, "allow"), (15, "", "", None, "allow")]
    assert [r[:3] + r[4:] for r in got] == [r[:3] + r[4:] for r in want]
    assert [r[3] for r in got] == [r[3] for r in want]


def test_bad_hosts_are_blocked_and_small_ones_follow_their_domain(spark):
    pages, labels = [], []
    for i in range(600):
        host = ("bad.evil.net", "worse.evil.net", "ok.fine.net", "good.fine.com", "mixed.some.com")[i % 5]
        pages.append((i, f"http://{host}/x{i}"))
        bad = {"bad.evil.net": 1, "worse.evil.net": i % 10 < 9, "mixed.some.com": i % 4 == 0}.get(host, i % 20 == 0)
        labels.append((i, 1 - int(bad), 0))
    pages += [(1000, "http://new.evil.net/"), (1001, "http://new.fine.com/"), (1002, "http://bad.evil.net/a")]
    labels += [(1002, None, None), (0, 1, 1), (0, 1, 0), (5, None, 0)]
    p = spark.createDataFrame(pages, "page_id long, url string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r["page_id"]: r["verdict"] for r in urls.judge_urls(p, lab).collect()}
    assert len(got) == len(pages)
    assert got[0] == got[1] == got[1002] == "block" and got[2] == got[3] == got[4] == got[1001] == "allow"
    assert urls.judge_urls(p.limit(0), lab).count() == 0


def test_registered_domains(spark):
    want = {"a.b.co.uk": ("b.co.uk", "co.uk"), "co.uk": ("co.uk", "co.uk"), "x.com": ("x.com", "com"), "w.x.com.": ("x.com", "com"),
            "u@w.x.com:80": ("x.com", "com"), "10.1.2.3:8080": ("10.1.2.3", "ip"), "[::1]:80": ("[::1]", "ip"), "1.2.3.x.de": ("x.de", "de"),
            "localhost": ("localhost", "localhost"), "": ("", ""), "é.or.jp": ("é.or.jp", "or.jp"), "uk": ("uk", "uk")}
    name = urls.name_of(F.col("host"))
    got = spark.createDataFrame([(h,) for h in want], "host string").select("host", urls.registered_domain(name), urls.suffix_of(name))
    assert {r[0]: (r[1], r[2]) for r in got.collect()} == want


def test_neighbours_under_a_suffix_of_two_labels_or_of_an_address_share_nothing(spark):
    pages = [(i, f"http://w{i % 3}.{('bad', 'fine', 'new')[i % 3]}.co.uk/{i}") for i in range(300)]
    pages += [(300 + i, f"http://{('10.0.0.1', '10.9.0.1')[i % 2]}:80/{i}") for i in range(200)]
    labels = [(i, int(i % 3 > 0), 0) for i in range(300) if i % 3 < 2] + [(300 + i, int(i % 2), 0) for i in range(200)]
    got = urls.judge_urls(spark.createDataFrame(pages, "page_id long, url string"),
                          spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    blocked = {r["page_id"] for r in got if r["verdict"] == "block"}
    assert blocked == {i for i in range(300) if i % 3 == 0} | {300 + i for i in range(0, 200, 2)}


# ---------------------------------------------------------------- mix

def brute_targets(sizes):
    """The rule as it is told: share by weight, stop at three times the size, share the excess again."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        rest = total - sum(3 * sizes[s] for s in capped)
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        if not over:
            return {s: 3.0 * sizes[s] if s in capped else share[s] for s in names}
        capped |= over


def mix_rows():
    rng = random.Random(4)
    rows = []
    for k, (source, n) in enumerate((("a", 400), ("b", 30), ("c", 40), ("Z", 25), ("é", 60), (None, 30), ("tiny", 1), ("none", 2))):
        for i in range(n):
            size = 0 if source == "none" else rng.choice([3, 50, 120, 400])
            rows.append((1000 * k + i, None if size == 0 and i else "w " * size, source))
    rows += [(1, "w " * 20_000, "b"), (5000, "w w", "a"), (5000, "w w", "a"), (None, "w " * 30, "c")]
    return rows


def test_mix_targets_and_taken(spark, docs_of):
    rows = mix_rows()
    got = mixing.mix(docs_of(rows)).collect()
    assert len(got) == len(rows)
    sizes = collections.Counter()
    for _, text, source in rows:
        sizes[source] += len((text or "").split())
    want = brute_targets(sizes)
    taken = collections.Counter()
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]], abs=1e-6)
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    for s, t in want.items():
        assert abs(taken[s] - t) <= max(4 * mixing.BLOCK, 0.02 * t)
    again = mixing.mix(docs_of(rows).repartition(7)).collect()
    key = lambda r: tuple((x is None, x) for x in (r["doc_id"], r["source"], r["size"], r["taken"]))
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_schedule_is_near_its_weights_all_along(spark, docs_of):
    sources = common.written(mixing.targets(mixing.sizes(docs_of(mix_rows()))), "sources")
    share = {r["src"]: r["draws"] / r["slots"] for r in sources.collect()}
    slots = sorted(mixing.schedule(sources).collect())
    seen = collections.Counter()
    for k, r in enumerate(slots, 1):
        assert r["rank"] == seen[r["src"]]
        seen[r["src"]] += 1
        assert all(abs(seen[s] - k * p) < 6 for s, p in share.items())


def test_mix_stage_writes_the_taken_words(spark, docs_of):
    rows = [(d, t and " \n".join(f"é{d}.{i}" for i, _ in enumerate(t.split())) + "\t", s) for d, t, s in mix_rows()[:-3]]
    rows += [(5000, "same words here", "a")] * 3
    docs = docs_of(rows).withColumn("n_chars", F.length("text").cast("long"))
    out = mixing.mix_stage(spark, docs, "")
    assert out.columns == docs.columns
    given, parts, by_source = {(d, s): t for d, t, s in rows}, collections.defaultdict(list), collections.Counter()
    for r in out.collect():
        whole = given[r["doc_id"], r["source"]]
        assert r["n_chars"] == len(r["text"]) and r["text"] and whole.startswith(r["text"])
        assert r["text"] == whole or whole[len(r["text"])].isspace()
        parts[r["doc_id"], r["source"]].append(len(r["text"].split()))
        by_source[r["source"]] += parts[r["doc_id"], r["source"]][-1]
    assert sum(len(x) > len(set(x)) for x in parts.values()) > 10          # repeated
    assert sum(x and min(x) < max(x) for x in parts.values()) <= 8         # one document of a source is cut, at most
    for r in mixing.mix(docs).collect():
        if r["doc_id"] != 5000:
            assert sum(parts[r["doc_id"], r["source"]]) == r["taken"]
        elif r["target"]:
            assert abs(by_source[r["source"]] - r["target"]) <= 4 * mixing.BLOCK


def test_mix_of_nothing(docs_of):
    assert mixing.mix(docs_of([])).count() == 0
    got = mixing.mix(docs_of([(1, None), (2, "")])).collect()
    assert [(r["taken"], r["target"]) for r in got] == [(0, 0.0), (0, 0.0)]


# ---------------------------------------------------------------- pipeline

def test_pipeline_against_brute_force(spark, docs_of):
    import corpus_pipeline as P
    assert [n for n, _ in P.STAGES] == ["quality_rules", "near_duplicates", "decontamination", "mixing", "token_output"]
    docs = common.table(spark, SF, "documents")
    kept, seen = docs, []
    for name, stage in P.STAGES[:-1]:
        kept = common.written(stage(spark, kept, SF), f"test-{name}")
        assert kept.columns == docs.columns
        seen.append(kept.count())
    assert 200 >= seen[0] >= seen[1] >= seen[2] > 100
    rows = [(r["doc_id"], r["text"]) for r in kept.collect()]
    got = sorted((tuple(r) for r in P.run(spark, SF).collect()), key=lambda r: r[1])
    # the mix may take a document whole and its first words: rows of one doc_id stand in the order of their files
    assert sorted((r[0], r[2], r[3]) for r in got) == sorted((r[0], r[2], r[3]) for r in token_truth(rows))
    assert [r[0] for r in got] == sorted(r[0] for r in got)
    assert [r[1] for r in got] == [sum(r[2] for r in got[:k]) for k in range(len(got))]


def test_pipeline_stages_on_nothing(spark, docs_of):
    import corpus_pipeline as P
    docs = docs_of([], clash=False)
    for _, stage in P.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() == 0


def test_stages_keep_clean_documents(spark):
    docs = common.table(spark, SF, "documents")
    judged = {r["doc_id"]: r for r in quality.judge(docs).collect()}
    assert all(r["kept"] or r["base_failed"] or r["n_boilerplate_words"] for r in judged.values())
    near = minhash.near_duplicates(docs).collect()
    assert sum(r["kept"] for r in near) == len({r["component_id"] for r in near})


# ---------------------------------------------------------------- SQL

def test_queries_match_their_sql(spark):
    import duckdb
    import pandas as pd

    from hoprank.fixtures import TABLES
    from hoprank.llm.registry import QUERIES, SQL
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    for name, sql in SQL.items():
        s, d = QUERIES[name](spark, SF).toPandas(), con.execute(sql).df()
        s, d = (x[sorted(x.columns)].sort_values(sorted(x.columns)).reset_index(drop=True) for x in (s, d))
        pd.testing.assert_frame_equal(s, d, check_dtype=False, atol=1e-9, obj=name)
