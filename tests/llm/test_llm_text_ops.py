"""Quality rules, repeats, near-duplicates, leaks and secrets against brute force, with awkward rows."""
import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from hoprank.llm import common as C
from hoprank.llm import decontaminate, minhash, quality, repeats, secrets
from hoprank.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


AWKWARD = [(100, None), (101, ""), (102, " \n\t\x0b"), (103, "one"), (104, "é è\x85ê x y"), (105, "a " * 300),
           (None, "nothing has this id " * 3), (None, None)]


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    base = [prose(rng, n) for n in (40, 60, 80, 120, 300)]
    rows = [(i, t) for i, t in enumerate(base)]
    for i in range(20):                                     # edited copies
        w = words(base[i % 5])
        for _ in range(rng.randrange(1, 4)):
            w[rng.randrange(len(w))] = "edited"
        rows.append((10 + i, " ".join(w)))
    rows += [(40, base[0]), (41, base[0].upper()), (42, base[2] + " " + base[3]), (43, "x " + base[4][:900])]
    rows += [(44, base[1]), (44, base[1]), (44, base[3])]   # repeated rows, and an id with another text
    rows.append((45, prose(rng, 30_000, 50_000)))           # very long
    return rows + AWKWARD


# ---------------------------------------------------------------- components

def test_components_of_random_graphs(spark):
    rng = random.Random(3)
    for n, m in ((30, 20), (200, 190), (60, 200)):
        links = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] + [(5, 5), (None, 3)]
        parent = list(range(n))

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x
        for a, b in links:
            if a is not None and b is not None and a != b:
                a, b = sorted((find(a), find(b)))
                parent[b] = a
        got = {r["vertex"]: r["component"] for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
        touched = {x for a, b in links if a is not None and a != b for x in (a, b)}
        assert got == {x: find(x) for x in touched}


def test_components_of_a_long_path_and_of_nothing(spark):
    got = components(spark.range(300).selectExpr("id u", "id + 1 v")).collect()
    assert {r["component"] for r in got} == {0} and len(got) == 301
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


# ---------------------------------------------------------------- near-duplicates

def shingle_set(text):
    w = words((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_components(rows):
    ids = sorted({r[0] for r in rows if r[0] is not None})
    sets = [(r[0], shingle_set(r[1])) for r in rows if r[0] is not None]
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for k, (a, x) in enumerate(sets):
        for b, y in sets[:k]:
            both = len(x & y)
            if both and 100 * both >= 75 * (len(x) + len(y) - both):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {i: find(i) for i in ids}


def test_near_duplicates_against_brute_force(docs_of, corpus):
    want = brute_components(corpus)
    got = minhash.near_duplicates(docs_of(corpus)).collect()
    assert len(got) == len(corpus)
    assert sorted((r["doc_id"] or -1, r["n_shingles"]) for r in got) == sorted(
        (r[0] or -1, len(shingle_set(r[1]))) for r in corpus)
    for r in got:
        assert r["component_id"] == (want[r["doc_id"]] if r["doc_id"] is not None else None)
        assert r["kept"] == (r["doc_id"] == r["component_id"])


def test_a_group_of_edited_copies_links_only_where_it_should(docs_of):
    rng = random.Random(11)
    base = words(prose(rng, 150, 5000))
    rows = [(500, " ".join(base))]
    for i in range(150):
        w = list(base)
        for _ in range(rng.randrange(1, 14)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10_000)}"
        rows.append((i, " ".join(w)))
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs_of(rows)).collect()}
    assert got == brute_components(rows)
    assert 1 < len(set(got.values())) < 151


def test_near_duplicates_of_nothing(docs_of):
    assert minhash.near_duplicates(docs_of([])).count() == 0
    assert minhash.near_duplicates(docs_of([(1, None)])).first()["component_id"] == 1


def test_near_dup_stage_keeps_one_of_each_group(spark, docs_of, corpus):
    docs = docs_of(corpus)
    out = minhash.near_dup_stage(spark, docs, "")
    want = brute_components(corpus)
    assert out.columns == docs.columns
    assert sorted(r["doc_id"] or -1 for r in out.collect()) == sorted(
        i or -1 for i, *_ in corpus if i is None or want[i] == i)


# ---------------------------------------------------------------- repeats

def brute_repeats(rows, n=repeats.WINDOW):
    seen = collections.Counter(tuple(w[i:i + n]) for w in (words(r[1]) for r in rows) for i in range(len(w) - n + 1))
    out = []
    for doc_id, text, *_ in rows:
        w = words(text)
        gone = {p for i in range(len(w) - n + 1) if seen[tuple(w[i:i + n])] > 1 for p in range(i, i + n)}
        kept = " ".join(x for p, x in enumerate(w) if p not in gone)
        out.append((doc_id, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x) for x in r))


def test_repeats_against_brute_force(docs_of, corpus):
    got = [tuple(r) for r in repeats.digests(repeats.remove_repeats(docs_of(corpus))).collect()]
    assert ordered(got) == ordered(brute_repeats(corpus))


def test_repeats_with_few_words_and_periods(docs_of):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice("ab") for _ in range(rng.randrange(30, 90)))) for i in range(30)]
    rows += [(50, "x " * 35), (51, "y " * 36), (52, "z q " * 40), (53, "x " * 34)]
    got = [tuple(r) for r in repeats.digests(repeats.remove_repeats(docs_of(rows))).collect()]
    assert ordered(got) == ordered(brute_repeats(rows))
    assert repeats.remove_repeats(docs_of([])).count() == 0


def test_repeated_rows_share_one_list_of_spans(docs_of):
    rng = random.Random(12)
    rows = [(7, prose(rng, 200))] * 1000 + [(8, prose(rng, 60)), (9, None)]
    docs = docs_of(rows)
    texts = repeats._texts(docs)
    spans = repeats._with_spans(texts, repeats.repeated_spans(docs).withColumn("w", F.lit(1)), "inner")
    assert spans.select(F.max(F.size("spans"))).first()[0] <= 200
    got = repeats.remove_repeats(docs).collect()
    assert sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in got) == [(7, 200, 200, "")] * 1000 + [
        (8, 60, 0, rows[1000][1]), (9, 0, 0, "")]


# ---------------------------------------------------------------- quality

def test_quality_base_counts_against_brute_force(docs_of, corpus):
    rng = random.Random(8)
    rows = list(corpus)
    for i in range(40):
        lines = [prose(rng, rng.randrange(0, 6), 12) + rng.choice(["", "  ", "#$|<é>", "\t"]) for _ in range(12)]
        rows.append((200 + i, "\n".join(lines)))
    got = quality.judge(docs_of(rows)).collect()
    want = []
    for doc_id, text, *_ in rows:
        t, w = text or "", words(text)
        grams = collections.Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
        repeat = {p for i in range(len(w) - 4) if grams[tuple(w[i:i + 5])] > 1 for p in range(i, i + 5)}
        lines = [x for x in t.split("\n") if words(x)]
        n = len(w)
        want.append((doc_id, n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)),
                     len(repeat), n < 10 or 100 * len(repeat) > 20 * n))
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert ordered([tuple(r[c] for c in columns) for r in got]) == ordered(want)


def test_boilerplate_lines_deplete_a_document_but_copies_do_not(spark, docs_of):
    rng = random.Random(1)
    menu = [prose(rng, 9, 5000) + " page 7" for k in range(4)]
    rows = [(i, prose(rng, 40, 5000) + "\n" + "\n".join(menu), "a") for i in range(40)]
    rows.append((90, "\n".join(m.upper()[:-1] + "8" for m in menu) + "\nonly this is new", "a"))
    rows += [(200 + i, "the same text that many pages copy word by word\nand another line of it here", "a") for i in range(60)]
    rows += [(300, "\n".join(menu), "b"), (301, "\n".join(menu), None)]
    docs = docs_of(rows)
    got = {r["doc_id"]: r for r in quality.judge(docs).collect()}
    assert not got[90]["kept"] and not got[90]["base_failed"] and got[90]["n_boilerplate_words"] == 44
    assert all(got[i]["kept"] and got[i]["n_boilerplate_words"] == 44 for i in range(40))
    assert all(got[i]["kept"] for i in range(200, 260))         # exact copies are one document
    assert got[300]["kept"] and got[301]["kept"]                # other hosts
    out = quality.quality_stage(spark, docs, "")
    assert out.columns == docs.columns
    assert {r["doc_id"] for r in out.collect()} == {i for i, r in got.items() if r["kept"]}


def test_boilerplate_lines_are_cut_out_of_the_text(spark, docs_of):
    rng = random.Random(21)
    menu = ["Home | Products | Page 7", "all rights reserved by nobody 1999 é"]
    own = {i: [prose(rng, 30, 5000), "", prose(rng, 12, 5000)] for i in range(30)}
    rows = [(i, "\n".join([menu[0], t[0], t[1], menu[1].upper().replace("É", "é"), t[2], "home |  products | PAGE 8"]), "a")
            for i, t in own.items()]
    long = prose(rng, 90, 5000)
    rows += [(50, "\n".join([long, *menu, menu[0]]), "a"), (51, f"{own[4][0]}\n{menu[1]}\n", "a"),
             (52, f"{menu[0]}\r\n{own[5][0]}\r\n", "a"), (53, f"{own[6][0]}\n{menu[0]}", "b"), (54, own[7][0] + "\n", "a"),
             (None, f"{own[8][0]}\n\n{menu[0]}", "a")]
    docs = docs_of(rows).withColumn("n_chars", F.length("text").cast("long"))
    out = quality.quality_stage(spark, docs, "")
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    got = {r["doc_id"]: r for r in out.collect()}
    want = {i: "\n".join(t) for i, t in own.items()}
    want |= {50: long, 51: own[4][0] + "\n", 52: own[5][0] + "\r\n", 53: rows[33][1], 54: rows[34][1], None: own[8][0] + "\n"}
    assert {i: r["text"] for i, r in got.items()} == want
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())
    for r in quality.judge(docs).collect():                 # the counts are those of the cut
        assert r["n_words"] - r["n_boilerplate_words"] == len(words(got[r["doc_id"]]["text"]))


def test_quality_of_nothing(docs_of):
    assert quality.judge(docs_of([])).count() == 0


# ---------------------------------------------------------------- leaks

def brute_align(a, b):
    """Textbook Smith-Waterman."""
    best, up = 0, [0] * (len(b) + 1)
    for x in a:
        row = [0]
        for j, y in enumerate(b):
            row.append(max(0, up[j] + (decontaminate.MATCH if x == y else decontaminate.MISMATCH),
                           up[j + 1] - decontaminate.GAP, row[-1] - decontaminate.GAP))
        best, up = max(best, *row), row
    return best


def test_alignment_against_the_textbook():
    rng = random.Random(4)
    a = [np.array([rng.randrange(2, 9) for _ in range(rng.randrange(1, 30))], np.uint64) for _ in range(60)]
    b = [np.array([rng.randrange(2, 9) for _ in range(rng.randrange(1, 60))], np.uint64) for _ in range(60)]
    score, end = decontaminate.align(a, b)
    assert score.tolist() == [brute_align(x, y) for x, y in zip(a, b)]
    assert all(0 <= e <= len(y) for e, y in zip(end, b))


def test_leaks_exact_edited_and_none(spark, docs_of):
    rng = random.Random(6)
    items = [prose(rng, n, 3000) for n in (15, 30, 60, 200)]
    tests = spark.createDataFrame([(i, t, 1, 1) for i, t in enumerate(items)] + [(8, None, 1, 1), (9, "", 1, 1), (10, "w1 w2", 1, 1)],
                                  "item_id long, text string, th int, seg int")
    edited = words(items[2])
    for k in range(3, 60, 9):
        edited[k] = "changed"
    del edited[20:22]
    rows = [(i, prose(rng, 200, 3000)) for i in range(30)]
    rows += [(50 + i, f"{prose(rng, 50, 3000)} {t} {prose(rng, 80, 3000)}") for i, t in enumerate(items)]
    rows += [(60, prose(rng, 30, 3000) + " " + " ".join(edited)), (61, items[1].upper().replace(" ", ",  ")),
             (62, " ".join(words(items[3])[70:150])), (63, " ".join(words(items[2])[:12])), *AWKWARD]
    rows += [(70 + i, items[0] + " " + prose(rng, 20 + i, 3000)) for i in range(40)]     # a leak into many documents
    docs = docs_of(rows)
    for block in (decontaminate.BLOCK_BYTES, 300):          # one block of items, and several
        got = decontaminate.leaks(docs, tests, block_bytes=block).collect()
        assert {(r["doc_id"], r["item_id"]) for r in got} == {(50, 0), (51, 1), (52, 2), (53, 3), (60, 2), (61, 1), (62, 3),
                                                             *((70 + i, 0) for i in range(40))}
        assert all(r["score"] == 1.0 for r in got if r["doc_id"] < 60)
    assert decontaminate.leaks(docs_of([]), tests).count() == 0
    assert decontaminate.leaks(docs, tests.limit(0)).count() == 0


def test_an_edited_copy_is_found_beside_an_exact_one(spark, docs_of):
    rng = random.Random(16)
    items = [prose(rng, n, 3000) for n in (15, 30, 60)]
    edited = [" ".join("changed" if k % 5 == 4 else w for k, w in enumerate(words(t))) for t in items]
    rows = [(10 + i, f"{prose(rng, 40, 3000)} {t} {prose(rng, 40, 3000)}") for i, t in enumerate(items)]
    rows += [(20 + i, f"{prose(rng, 40, 3000)} {t} {prose(rng, 40, 3000)}") for i, t in enumerate(edited)]
    rows += [(30 + i, prose(rng, 100, 3000)) for i in range(20)]
    tests = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in decontaminate.leaks(docs_of(rows), tests).collect()}
    assert set(got) == {(d + i, i) for d in (10, 20) for i in range(3)}
    assert all((got[10 + i, i], got[20 + i, i]) == (1.0, brute_align(words(t), words(edited[i])) / (2 * len(words(t))))
               for i, t in enumerate(items))


def brute_leaks(rows, items):
    """Every text aligned with every segment of every item, and whole phrases searched."""
    code = collections.defaultdict(lambda: len(code) + 2)
    split = lambda t: [code[w] for w in re.findall(r"[a-z0-9\u0080-\U0010ffff]+", (t or "").lower())]
    texts, out = [(r[0], split(r[1])) for r in rows], {}
    for item, t in items:
        h = split(t)
        for part in np.array_split(h, -(-len(h) // decontaminate.SEGMENT)) if h else ():
            score, _ = decontaminate.align([np.array(part, np.uint64)] * len(texts),
                                           [np.array(x or [0], np.uint64) for _, x in texts])
            for (d, _), v in zip(texts, score / (2 * len(part))):
                if v >= (decontaminate.THRESHOLD if len(h) >= decontaminate.MIN_ITEM else 1):
                    out[d, item] = max(v, out.get((d, item), 0))
    return out


def test_leaks_against_every_text_with_every_item(spark, docs_of, monkeypatch):
    rng = random.Random(23)
    items = [prose(rng, n, v) for n in (8, 9, 13, 21, 40, 64, 150) for v in (9, 60, 3000)]
    items += ["w1", "w1 w2", "w5 w5 w5", "w1 w2 w3 w4 w5", "a " * 30, "a " * 200, items[5], "", None]

    def change(t):
        out, w, kind, k = [], words(t), rng.randrange(6), rng.randrange(1, 6)
        for i, x in enumerate(w):
            if kind == 0 and i % k == k - 1:
                out.append("changed")
            elif kind == 1 and i % k == k - 1:
                out += [x, "put"]
            elif kind == 2 and i % k == k - 1:
                pass
            elif kind == 3:
                out += [x] + ["in"] * rng.randrange(3)
            elif kind == 4 and rng.random() < 0.25:
                out.append(rng.choice(["new", x + " put", "", "w1 w2"]))
            else:
                out.append(x)
        return " ".join(out[:len(out) // 2] if kind == 5 else out)

    rows = [(i, prose(rng, 60, rng.choice([9, 60, 3000]))) for i in range(60)]
    rows += [(100 + i, f"{prose(rng, rng.randrange(40), 60)} {change(rng.choice(items[:21]))} {prose(rng, 20, 3000)}") for i in range(400)]
    rows += [(600, "a " * 1000), (601, "a b " * 200), (602, None), (603, ""), (604, "w1"), (605, "w5 " * 9)]
    tests = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    want = brute_leaks(rows, list(enumerate(items)))
    docs = docs_of(rows)
    for hits in (decontaminate.HITS, 7):
        monkeypatch.setattr(decontaminate, "HITS", hits)
        got = {(r["doc_id"], r["item_id"]): r["score"] for r in decontaminate.leaks(docs, tests).collect()}
        assert got == pytest.approx(want)
    with pytest.raises(ValueError):
        decontaminate.leaks(docs, tests, threshold=0.3)


def test_every_third_and_every_fourth_word_replaced(spark, docs_of):
    rng = random.Random(8)
    items = [prose(rng, n, 3000) for n in (10, 40, 64)]
    rows = [(10 * k + i, prose(rng, 30, 3000) + " " + " ".join("x" if j % k == k - 1 else w for j, w in enumerate(words(t))))
            for k in (3, 4) for i, t in enumerate(items)]
    tests = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs_of(rows), tests).collect()}
    assert got == {(10 * k + i, i) for k in (3, 4) for i in range(3)}


def test_one_word_a_million_times_and_short_items(spark, docs_of, tmp_path):
    items = [(1, "a " * 40), (2, "a " * 5000), (3, "b a"), (4, "yes"), (5, "b c d e"), (6, "a " * 5), (None, "a " * 40)]
    tests = spark.createDataFrame(items, "item_id long, text string")
    rows = [(1, "a " * 500_000), (2, "yes"), (3, "b c, D! e"), (4, "b c x d e"), (5, "b a " * 3)]
    docs = docs_of(rows)
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, tests).collect()}
    # b a b a b a: six of its words make a score of 3 a's and 2 gaps, too low for forty
    assert got == {(1, 1), (1, 2), (1, 6), (1, None), (2, 4), (3, 5), (5, 3)}
    tests.write.parquet(f"{tmp_path}/benchmark.parquet")
    assert sorted(r["doc_id"] for r in decontaminate.leak_stage(spark, docs, str(tmp_path)).collect()) == [2, 4, 5]


def test_leak_query_finds_every_whole_passage(spark):
    import duckdb
    sf = "/root/testdata/sf0.01"
    clean = lambda t: " " + " ".join(re.findall(r"[a-z0-9\u0080-\U0010ffff]+", (t or "").lower())) + " "
    docs = {i: clean(t) for i, t in duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall()}
    items = duckdb.sql(f"SELECT item_id, text FROM '{sf}/benchmark.parquet'").fetchall()
    whole = {(d, i) for i, t in items for d, x in docs.items() if clean(t) in x}
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leak_query(spark, sf).collect()}
    assert whole and whole <= got and len(got) <= 1.1 * len(whole)


# ---------------------------------------------------------------- secrets

def brute_base(text):
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in re.finditer(
        r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|"""
        r"""[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[1]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


def secret_rows():
    rng = random.Random(9)
    key = lambda n, a="ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789": "".join(rng.choice(a) for _ in range(n))
    rows = []
    for i in range(60):
        parts = [prose(rng, 10), "é" * rng.randrange(3), f"PassWord = '{key(rng.randrange(3, 12))}", f'api_key":"{key(20)}"',
                 f"AKIA{key(rng.randrange(10, 20), 'ABCDEFGH0123')}", key(rng.randrange(20, 40), "0123456789abcdef"),
                 "secret=token: short token :abcdefgh passwd=secret=token=abcdef", "ſecret=abcdefgh toKen=abcdefgh"]
        rng.shuffle(parts)
        rows.append((i, " ".join(parts)))
    return rows


def test_secret_base_spans_against_brute_force(docs_of):
    rows = secret_rows() + AWKWARD + [(70, "f" * 200_000 + " password=" + "x" * 50)]
    model = np.full(secrets.K ** 2, -1.0)                   # nothing is added
    got = secrets.find_secrets(docs_of(rows), model).collect()
    want = []
    for doc_id, text, *_ in rows:
        spans = brute_base(text)
        say = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in spans)
        want.append((doc_id, *(sum(k == x for _, k, _ in spans) for x in range(3)),
                     hashlib.sha256(say.encode()).hexdigest(), say))
    assert ordered([tuple(r) for r in got]) == ordered(want)


def test_character_models_on_held_out_strings(docs_of):
    rng = random.Random(5)
    parts = ("connection timeout seconds get user account by identifier number of elements default configuration directory "
             "internal everything maximum value index table column record write read open close").split()

    def name(rng):
        p = [rng.choice(parts) for _ in range(rng.randrange(2, 6))]
        return "_".join(p) if rng.random() < 0.5 else p[0] + "".join(x.title() for x in p[1:])
    model = secrets.train(docs_of(secret_rows() + [(100 + i, " ".join(name(rng) for _ in range(200))) for i in range(50)]))
    rng = random.Random(77)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    random_ones = ["".join(rng.choice(letters) for _ in range(32)) for _ in range(200)]
    ordinary = [name(rng) for _ in range(200)]              # held out: other seeds than in training
    docs = docs_of([(i, f"see {x} here") for i, x in enumerate(random_ones + ordinary)])
    got = {r["doc_id"]: r["spans"] for r in secrets.find_secrets(docs, model).collect()}
    found = [got[i] for i in range(200)]
    assert sum(s == "markov:4:36" for s in found) >= 180
    assert sum(got[200 + i] != "" for i in range(len(ordinary))) <= 4


def test_secrets_of_nothing(docs_of):
    assert secrets.find_secrets(docs_of([])).count() == 0


def test_slices_cut_at_rows():
    import pyarrow as pa
    col = pa.array([b"ab c", b"", b"d" * 50, b"e f"], pa.binary())
    for size in (1, 10, 1000):
        got = [w.hash[a:b].tolist() for s in C.slices(col, size) for w in [C.words(s)] for a, b in zip(w.offs, w.offs[1:])]
        assert [len(x) for x in got] == [2, 0, 1, 2]
        assert got == [w.hash[a:b].tolist() for s in C.slices(col) for w in [C.words(s)] for a, b in zip(w.offs, w.offs[1:])]


# ---------------------------------------------------------------- hashes of structured words

def thue_morse(n, zero="a", one="b"):
    return "".join(one if bin(k).count("1") % 2 else zero for k in range(n))


def test_structured_words_have_different_hashes():
    sizes = [512, 1024, 4096, 65_536, 131_072]
    texts = [f(n) for n in sizes for f in (thue_morse, lambda n: thue_morse(n, "b", "a"))]
    texts += [" ".join(t[:2048]) for t in (thue_morse(2048), thue_morse(2048, "b", "a"))]
    import pyarrow as pa
    for s in C.slices(pa.array([t.encode() for t in texts], pa.binary()), 1 << 30):
        w = C.words(s)
        one_word = w.hash[:len(sizes) * 2]
        assert len(set(one_word.tolist())) == len(sizes) * 2
        lines = quality._word_lines(s, w)[4]
        assert len(set(lines.tolist())) == len(texts)           # and lines of 2,048 words


def test_structured_words_in_the_operators(spark, docs_of):
    a, b = thue_morse(1024), thue_morse(1024, "b", "a")
    w = [f"w{k}" for k in range(17)]
    rows = [(1, " ".join([*w, a, *w])), (2, " ".join([*w, b, *w]))]           # 35 words, the middle ones differ
    assert [r["n_removed"] for r in repeats.remove_repeats(docs_of(rows)).collect()] == [0, 0]
    got = minhash.near_duplicates(docs_of([(1, a), (2, b)])).collect()
    assert all(r["kept"] for r in got)
    counts = quality.line_counts(docs_of([(1, f"{a}\n{b}")])).first()
    assert counts["n_dup_lines"] == 0 and len(counts["lines"]) == 2
