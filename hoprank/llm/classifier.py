"""Quality classifier: a sparse rule ensemble over text statistics, compiled to Spark column expressions.

One Arrow pass reads every whole text and writes its statistics (shares of letters,
capitals, digits and symbols, marks per word, repeats, line and word lengths).  A random forest of
shallow trees, grown on labelled rows, proposes rules: every path from a root to a node is a
conjunction of comparisons.  A lasso logistic regression over the rules' indicators
keeps a few of them.  Those become one column expression, so scoring all documents is
a projection inside generated code, without Python and without a model object.

Labels are learnt only from rows whose crc32 of the id modulo FOLDS isn't HELD_OUT, and
at most from about SAMPLE of them, taken by a hash of id and statistics when there are more.  Ids,
labels, language and source are no inputs of a score.

Defined results: a null or empty text has all statistics zero and is scored by them;
a null id is never held out and has no label; an id with several labels takes their
majority (a tie is 1), null labels are left out; rows that repeat an id are scored each
by its own text, equal ones count once in the fit.  Ties between equal rules: the shortest stays.  Very long
texts are read whole.  Without labels every score is 0.5, with labels of one class the
share of that class.  Other columns are not looked at; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import math
import operator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from . import common as C
from .quality import SYMBOLS, _lines, _repeat_words

#: Rows whose crc32 modulo FOLDS is HELD_OUT are never learnt from.
FOLDS, HELD_OUT = 3, 1
#: Labelled rows that a fit uses, about, and the forest and penalty that it uses.
SAMPLE, TREES, DEPTH, PENALTY, SEED = 200_000, 16, 3, 0.0005, 11

UPPER, LETTER, DIGIT = C._bytes(bytes(range(65, 91))), C._bytes(bytes([*range(65, 91), *range(97, 123)])), C._bytes(b"0123456789")
HIGH, SHOUT, STOP = C._bytes(bytes(range(128, 256))), C._bytes(b"!"), C._bytes(b".,;:?")
NAMES = ("words", "word_length", "longest_word", "capitals", "letters", "digits", "not_ascii", "symbols", "shouts", "stops",
         "distinct_words", "repeated_words", "repeated_lines", "line_words", "word_spread")


# ---------------------------------------------------------------- statistics

def _per(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.divide(a, b, out=np.zeros(len(a)), where=b > 0)


def statistics(s: C.Slice) -> list[np.ndarray]:
    """The statistics NAMES of each text of a slice."""
    w = C.words(s)
    n = np.diff(w.offs).astype(float)

    def count(table):
        return C.sums(table[s.buf], s.offs).astype(float)
    inside = np.zeros(len(s.buf) + 1, dtype=np.int8)
    inside[w.starts] += 1
    np.subtract.at(inside, w.ends, 1)
    points = np.concatenate([[0], np.cumsum((np.cumsum(inside)[:-1] > 0) & C.POINT[s.buf])])
    length = (points[w.ends] - points[w.starts]).astype(float) if len(w.starts) else np.zeros(0)
    chars = C.sums(length, w.offs).astype(float)
    row = np.repeat(np.arange(s.rows()), np.diff(w.offs))
    longest = np.zeros(s.rows())
    np.maximum.at(longest, row, length)
    spread = np.bincount(row, weights=(length - _per(chars, n)[row]) ** 2, minlength=s.rows())
    order = np.argsort(w.hash ^ C.mix(row.astype(np.uint64)), kind="stable")
    new = np.ones(len(order), dtype=bool)
    new[1:] = (w.hash[order][1:] != w.hash[order][:-1]) | (row[order][1:] != row[order][:-1])
    distinct = np.bincount(row[order][new], minlength=s.rows()).astype(float)
    dup = _lines(s, w)[0].astype(float)
    starts, ends = C.runs(s.buf != 10, s.offs)
    full = np.searchsorted(w.starts, ends) > np.searchsorted(w.starts, starts)
    lines = np.bincount(np.searchsorted(s.offs, starts[full], side="right") - 1, minlength=s.rows()).astype(float)
    letters, high = count(LETTER), count(HIGH & C.POINT)
    return [n, _per(chars, n), longest, _per(count(UPPER), letters), _per(letters + high, chars), _per(count(DIGIT), chars),
            _per(high, chars), _per(count(SYMBOLS), n), _per(count(SHOUT), n), _per(count(STOP), n), _per(distinct, n),
            _per(_repeat_words(w).astype(float), n), _per(dup, lines), _per(n, lines), np.sqrt(_per(spread, n))]


def _scan(batches):
    for rb in batches:
        for s in C.slices(rb.column("body")):
            yield pa.RecordBatch.from_arrays([rb.column("doc_id").slice(s.lo, s.rows()), *(pa.array(x) for x in statistics(s))],
                                             names=["doc_id", *NAMES])


def measured(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of every whole text, written once."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), C.body(F.col("text")).alias("body"))
    return C.written(rows.mapInArrow(_scan, "doc_id long, " + ", ".join(f"{n} double" for n in NAMES)), "statistics")


# ---------------------------------------------------------------- rules

#: A comparison: statistic, whether it must be above, and the threshold.
Comparison = tuple[str, bool, float]


@dataclass
class RuleModel:
    """Rules with weights, and the log-odds without any of them."""
    intercept: float = 0.0
    rules: list[tuple[tuple[Comparison, ...], float]] = field(default_factory=list)

    def score(self) -> Column:
        """The probability of label 1 as an expression of the statistics."""
        terms = [F.when(condition(r), F.lit(w)).otherwise(F.lit(0.0)) for r, w in self.rules] + [F.lit(self.intercept)]
        while len(terms) > 1:                        # a balanced sum keeps the expression shallow
            terms = [functools.reduce(operator.add, terms[i:i + 2]) for i in range(0, len(terms), 2)]
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-terms[0]))

    def lines(self) -> list[str]:
        """The rules as text, the heaviest first."""
        return [f"{w:+.3f} if " + " and ".join(f"{n} {'>' if up else '<='} {t:.4g}" for n, up, t in r)
                for r, w in sorted(self.rules, key=lambda rw: -abs(rw[1]))]


def condition(rule: tuple[Comparison, ...]) -> Column:
    return functools.reduce(operator.and_, [F.col(n) > t if up else F.col(n) <= t for n, up, t in rule])


def _shortened(path: list[Comparison]) -> tuple[Comparison, ...]:
    """A path's comparisons, the tightest for each statistic and direction, in a fixed order."""
    tight: dict[tuple[str, bool], float] = {}
    for name, up, t in path:
        old = tight.get((name, up))
        tight[name, up] = t if old is None else max(old, t) if up else min(old, t)
    return tuple((name, up, t) for (name, up), t in sorted(tight.items()))


def tree_rules(forest) -> list[tuple[Comparison, ...]]:
    """The distinct paths from the roots to every other node; of a first split one side only, as the other is its opposite."""
    found = {}

    def walk(node, path):
        if path and not (len(path) == 1 and not path[0][1]):
            found.setdefault(_shortened(path), None)
        if node.subtreeDepth() > 0:
            split = node.split()
            name, t = NAMES[split.featureIndex()], float(split.threshold())
            walk(node.leftChild(), [*path, (name, False, t)])
            walk(node.rightChild(), [*path, (name, True, t)])
    for tree in forest.trees:
        walk(tree._java_obj.rootNode(), [])
    return sorted(found, key=lambda r: (len(r), r))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == HELD_OUT, F.lit(False))


def training_rows(stats: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Distinct labelled rows that may be learnt from, with ``label``, about ``sample`` at most, written."""
    label = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality")
             .filter("doc_id is not null and quality is not null").groupBy("doc_id")
             .agg((F.avg("quality") >= 0.5).cast("double").alias("label")))
    rows = C.written(stats.filter(~held_out(F.col("doc_id"))).join(label, "doc_id").distinct(), "labelled")
    n = rows.count()
    if n <= sample:
        return rows
    keep = F.pmod(F.xxhash64("doc_id", *NAMES), F.lit(1 << 30)) < int(sample / n * (1 << 30))
    return C.written(rows.filter(keep), "sample")


def fit(rows: DataFrame) -> RuleModel:
    """Rules from a forest's paths, weights from a lasso logistic regression."""
    by = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    n = sum(by.values())
    share = by.get(1.0, 0) / n if n else 0.5
    if len(by) < 2:
        share = min(max(share, 1e-3), 1 - 1e-3)
        return RuleModel(math.log(share / (1 - share)))
    vectors = rows.select("label", array_to_vector(F.array(*NAMES)).alias("features"))
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, subsamplingRate=0.7, featureSubsetStrategy="0.5",
                                    minInstancesPerNode=max(1, min(20, n // 50)), maxMemoryInMB=64).fit(vectors)
    rules = tree_rules(forest)
    if not rules:
        return RuleModel(math.log(share / (1 - share)))
    marked = C.written(rows.select("label", *[condition(r).alias(f"r{k}") for k, r in enumerate(rules)]), "fires")
    fires = array_to_vector(F.array(*[F.col(f"r{k}").cast("double") for k in range(len(rules))]))
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=PENALTY, maxIter=100, tol=1e-7).fit(
        marked.select("label", fires.alias("features")))
    weights = lasso.coefficients.toArray()
    return RuleModel(float(lasso.intercept), [(r, float(w)) for r, w in zip(rules, weights) if w])


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[DataFrame, RuleModel]:
    """doc_id, held_out, score, predicted, the statistics, for every row of ``docs``; and the rules."""
    ship_package(docs.sparkSession)
    stats = measured(docs)
    model = fit(training_rows(stats, labels, sample))
    scored = stats.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), model.score().alias("score"), *NAMES)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), *NAMES), model


def classifier_query(spark, sf_dir: str) -> DataFrame:
    scored, _ = classify(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")
