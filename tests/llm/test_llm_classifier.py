"""Rule ensemble: statistics against plain Python, rules against the forest, held-out accuracy, awkward tables."""
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hoprank.llm import classifier as K
from hoprank.llm import common as C

LABELS = "doc_id long, quality int, toxic int"
TEXTS = [None, "", " \n ", "One two, THREE! 45 é", "a b c d e " * 30, "same line\nsame line\n\nother | line.", "x" * 5000,
         "ÀÉ über 日本 $$$ !!! ...", "w " * 40_000, "\x85   mixed\tTabs\r\nand lines"]


def plain(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    n, size = len(w), [len(x) for x in w]
    chars, letters = sum(size), len(re.findall("[A-Za-z]", t))
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    win = [tuple(w[i:i + 5]) for i in range(n - 4)]
    twice = {g for g in win if win.count(g) > 1} if n < 2000 else set(win)
    covered = {i + k for i, g in enumerate(win) if g in twice for k in range(5)}
    high = sum(ord(c) > 127 for c in t)

    def per(a, b):
        return a / b if b else 0.0
    mean = per(chars, n)
    return [n, mean, max(size, default=0), per(len(re.findall("[A-Z]", t)), letters), per(letters + high, chars),
            per(len(re.findall("[0-9]", t)), chars), per(high, chars), per(len(re.findall(r"[#*$%&|<>]", t)), n),
            per(t.count("!"), n), per(len(re.findall("[.,;:?]", t)), n), per(len(set(w)), n), per(len(covered), n),
            per(len(lines) - len(set(lines)), len(lines)), per(n, len(lines)), math.sqrt(per(sum((x - mean) ** 2 for x in size), n))]


def test_statistics_against_plain_python():
    col = pa.array([(t or "").encode() for t in TEXTS], pa.binary())
    got = [np.concatenate(x) for x in zip(*[K.statistics(s) for s in C.slices(col, 4000)])]
    for k, t in enumerate(TEXTS):
        assert np.allclose([g[k] for g in got], plain(t)), t


def run(spark, docs, labels, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    return [tuple(r) for r in K.classifier_query(spark, str(tmp_path)).select("doc_id", "held_out", "score", "predicted").collect()]


def test_held_out_accuracy_and_inputs(spark, tmp_path):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    scored, model = K.classify(docs, labels)
    rows = scored.join(labels, "doc_id").select("doc_id", "held_out", "score", "predicted", "quality").collect()
    assert scored.count() == docs.count() and 1 <= len(model.rules) <= 60
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    test = [r for r in rows if r["held_out"]]
    assert len(test) > 1000 and np.mean([r["predicted"] == r["quality"] for r in test]) > 0.98
    good, bad = ([r["score"] for r in test if r["quality"] == q] for q in (1, 0))
    assert np.mean([[g > b for b in bad] for g in good]) > 0.99
    assert {n for rule, _ in model.rules for n, _, _ in rule} <= set(K.NAMES)      # statistics of the text alone


def test_labels_of_held_out_rows_change_nothing(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    other = labels.withColumn("quality", F.when(K.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    blind = docs.withColumns({"lang": F.lit("xx"), "source": F.lit(None).cast("string")})
    a, m = K.classify(docs, labels)
    b, n = K.classify(blind, other)
    assert m == n
    key = ["doc_id", "score", "predicted"]
    assert a.select(key).exceptAll(b.select(key)).isEmpty()


def test_rules_are_the_paths_and_the_expression_adds_them(spark):
    rng = np.random.default_rng(2)
    rows = [tuple(float(v) for v in rng.normal(size=len(K.NAMES))) for _ in range(400)]
    data = [(float((r[0] > 0.3 and r[4] <= 0.5) or r[7] > 1), *r) for r in rows]
    df = spark.createDataFrame(data, ["label", *K.NAMES])
    model = K.fit(df)
    got = df.select("*", model.score().alias("score")).collect()
    for r in got:
        z = model.intercept + sum(w for rule, w in model.rules if all((r[n] > t) == up for n, up, t in rule))
        assert math.isclose(r["score"], 1 / (1 + math.exp(-z)), rel_tol=1e-9)
    assert np.mean([(r["score"] >= 0.5) == r["label"] for r in got]) > 0.95
    assert K._shortened([("a", True, 1.0), ("b", False, 5.0), ("a", True, 2.0), ("b", False, 4.0)]) == (("a", True, 2.0), ("b", False, 4.0))
    assert len(model.lines()) == len(model.rules)


def test_awkward_rows(spark, docs_of, tmp_path):
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 3 != 1]
    rows = [(i, "good words stand here in a line that reads well." if k % 2 else "BAD!! BAD!! $$$ %%%") for k, i in enumerate(ids)]
    labels = [(i, k % 2, 0) for k, i in enumerate(ids)] + [(ids[0], 0, 0), (None, 1, 0), (5000, 1, 0), (ids[1], None, 0)]
    more = [(1000 + k, t) for k, t in enumerate(TEXTS)] + [(None, "no id"), (None, None), (1003, TEXTS[3]), (1003, "BAD!! BAD!!")]
    got = run(spark, docs_of(rows + more), labels, tmp_path)
    assert len(got) == len(rows) + len(more) and all(0 <= s <= 1 and p == (s >= 0.5) for _, _, s, p in got)
    by = dict((g[0], g) for g in got)
    assert [by[i][3] for i in ids] == [k % 2 for k in range(len(ids))]
    assert by[1000][2] == by[1001][2] and not by[None][1]


@pytest.mark.parametrize("labels, score", [([], 0.5), ([(1, 1, 0)], 0.999), ([(1, 0, 0), (1, 1, 1), (1, 0, 0)], 0.001)])
def test_without_two_classes(spark, docs_of, tmp_path, labels, score):
    assert zlib.crc32(b"1") % 3 != 1
    got = run(spark, docs_of([(1, "some text"), (2, None)]), labels, tmp_path)
    assert [round(g[2], 6) for g in got] == [score] * 2
    assert run(spark, docs_of([]), labels, tmp_path / "none") == []


def test_sample_is_bounded_and_repeats(spark):
    rng = np.random.default_rng(3)
    stats = spark.createDataFrame([(i, *(float(v) for v in rng.normal(size=len(K.NAMES)))) for i in range(3000)], ["doc_id", *K.NAMES])
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(3000)], LABELS)
    a, b = (sorted(r["doc_id"] for r in K.training_rows(stats.union(stats), labels, 500).collect()) for _ in range(2))
    assert a == b and 400 < len(a) < 600 and len(set(a)) == len(a)
