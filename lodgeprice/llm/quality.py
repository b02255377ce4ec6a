"""Quality classifier: a sparse ensemble of conjunctive rules over text statistics.

A random forest is grown on the labelled documents' statistics; every path from
a root to a node is a rule. A lasso logistic regression keeps few of the rules
and weighs them, and the kept rules become one Spark column expression.
Both are Spark ML fits over all labelled training rows.

Defined cases: a null text counts as empty; an empty text has statistics 0 and
gets the score of the rules that hold there; without both labels the score is
the share of label 1 (0.5 without labels); a null id is not held out; repeated
rows are scored one by one; statistics are named ``st_*`` and never clash.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from . import wordhash
from .common import hidden, shown, small_batches, written

STATS = ["st_words", "st_mean_word", "st_upper", "st_digit", "st_symbol", "st_bar", "st_stop", "st_distinct",
         "st_repeat3", "st_lines", "st_line_repeat", "st_long_word"]
TREES, DEPTH, LASSO, SEED = 20, 3, 0.003, 7
TRAIN_PARTS = 16
#: Labelled rows of a training partition beyond that.
PART_ROWS = 50_000
#: Of every three ids one is held out: crc32 of the id as text, modulo 3.
FOLDS, HELD = 3, 1


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS)) == HELD, F.lit(False))


def _class(chars: str) -> np.ndarray:
    t = np.zeros(256, dtype=bool)
    t[list(chars.encode())] = True
    return t


_UPPER, _DIGIT = _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _class("0123456789")
_LETTER = _class("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
_LETTER[128:] = True
_SYMBOL, _BAR = _class("#$%&*!@^~+=<>{}[]\\/_"), _class("|")


def _per_row(flags: np.ndarray, rows: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return (total[rows[1:]] - total[rows[:-1]]).astype(float)


def text_stats(texts: pa.Array) -> np.ndarray:
    """One row of statistics per text, over the whole text."""
    w = wordhash.words(texts, lower=True)
    n = np.diff(w.first).astype(float)
    some = np.maximum(n, 1)
    letters = np.maximum(_per_row(_LETTER[w.data], w.rows), 1)
    size = w.end - w.start
    lengths = np.concatenate([[0], np.cumsum(size)])
    total = (lengths[w.first[1:]] - lengths[w.first[:-1]]).astype(float)
    chars = np.maximum(total, 1)
    by_word = lambda f: np.diff(np.concatenate([[0], np.cumsum(f)])[w.first])
    tri = wordhash.windows(w.hash, 3)
    distinct, repeat3, line_repeat = np.zeros(len(n)), np.zeros(len(n)), np.zeros(len(n))
    breaks = np.flatnonzero(w.data == 10)
    cut = np.searchsorted(breaks, w.rows)
    for i in range(len(n)):
        a, b = w.first[i], w.first[i + 1]
        if b - a:
            distinct[i] = len(np.unique(w.hash[a:b])) / (b - a)
        if b - a > 3:
            repeat3[i] = 1 - len(np.unique(tri[a:b - 2])) / (b - 2 - a)
        at = breaks[cut[i]:cut[i + 1]]
        if len(at):
            lo, hi = np.concatenate([[w.rows[i]], at + 1]), np.concatenate([at, [w.rows[i + 1]]])
            h = wordhash.hash_ranges(w.data, lo[hi > lo], hi[hi > lo])
            line_repeat[i] = 1 - len(np.unique(h)) / max(len(h), 1)
    return np.column_stack([
        np.log1p(n), total / some, _per_row(_UPPER[w.data], w.rows) / letters,
        _per_row(_DIGIT[w.data], w.rows) / chars, _per_row(_SYMBOL[w.data], w.rows) / chars,
        _per_row(_BAR[w.data], w.rows) / some, by_word(size <= 3) / some, distinct, repeat3,
        np.log1p(np.diff(cut)), line_repeat, by_word(size >= 20) / some])


def with_stats(rows: DataFrame, text: str) -> DataFrame:
    """``rows`` plus ``STATS`` of its column ``text``; no other column may be named like a statistic."""
    small_batches(rows.sparkSession)
    at = rows.columns.index(text)

    def run(batches):
        for batch in batches:
            for part in wordhash.parts(batch, batch.schema.names[at]):
                s = text_stats(part.column(at))
                yield pa.RecordBatch.from_arrays(part.columns + [pa.array(s[:, j]) for j in range(s.shape[1])],
                                                 names=part.schema.names + STATS)

    return rows.mapInArrow(run, StructType(rows.schema.fields + [StructField(s, DoubleType()) for s in STATS]))


def tree_rules(debug: str) -> list[tuple[tuple[int, bool, float], ...]]:
    """Rules of one printed decision tree: each is a path of (statistic, at most?, threshold)."""
    rules, path = [], []
    for line in debug.splitlines():
        m = re.match(r"(\s*)(?:If|Else) \(feature (\d+) (<=|>) ([-\d.eE]+)\)", line)
        if not m:
            continue
        depth = len(m[1])
        path = [p for p in path if p[0] < depth] + [(depth, int(m[2]), m[3] == "<=", float(m[4]))]
        rules.append(tuple(sorted(p[1:] for p in path)))
    return rules


def rule_column(rule) -> Column:
    """The rule as a 0/1 column."""
    held = None
    for stat, at_most, limit in rule:
        c = F.col(STATS[stat]) <= limit if at_most else F.col(STATS[stat]) > limit
        held = c if held is None else held & c
    return F.when(held, 1.0).otherwise(0.0)


def fit(train: DataFrame) -> tuple[float, list[tuple[float, tuple]]]:
    """(intercept, [(weight, rule)]) from rows with ``STATS`` and ``label`` (0 or 1)."""
    share = {r["label"]: r["count"] for r in train.groupBy("label").count().collect()}  # two rows
    n = sum(share.values())
    if len(share) < 2:
        p = min(max(share.get(1.0, 0) / n, 0.001), 0.999) if n else 0.5
        return float(np.log(p / (1 - p))), []
    # both labels weigh the same, so that 0.5 parts them
    train = train.withColumn("weight", F.when(F.col("label") == 1, n / (2 * share[1.0])).otherwise(n / (2 * share[0.0])))
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, weightCol="weight",
                                    featureSubsetStrategy="onethird", subsamplingRate=0.7)
    model = forest.fit(train.select(array_to_vector(F.array(*STATS)).alias("features"), "label", "weight"))
    rules = sorted({r for t in model.trees for r in tree_rules(t.toDebugString)})
    if not rules:
        return 0.0, []
    held = train.select(array_to_vector(F.array(*[rule_column(r) for r in rules])).alias("features"), "label", "weight")
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=LASSO, weightCol="weight", standardization=False,
                               maxIter=60).fit(held)
    return float(lasso.intercept), [(float(w), r) for w, r in zip(lasso.coefficients.toArray(), rules) if abs(w) > 1e-9]


def score_column(model) -> Column:
    """The compiled ensemble: a logistic of the weighted rules."""
    z = F.lit(model[0])
    for w, rule in model[1]:
        z = z + F.lit(w) * rule_column(rule)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def train_on(stats: DataFrame, labels: DataFrame):
    """Fit on the labelled rows that are not held out."""
    known = labels.where(F.col("quality").isin(0, 1)).select(
        F.col("doc_id").alias("lab_id"), F.col("quality").cast("double").alias("label"))
    rows = stats.where(~held_out(F.col("doc_id"))).join(known, F.col("doc_id") == F.col("lab_id"))
    # a layout of its own, so that the forest's samples don't depend on how the input was split
    parts = max(TRAIN_PARTS, -(-labels.count() // PART_ROWS))
    rows = rows.select("doc_id", *STATS, "label").repartition(parts, "doc_id").sortWithinPartitions("doc_id", *STATS, "label")
    return fit(written(rows, "quality-train"))


def score_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: ``doc_id, held_out, score, predicted``."""
    stats = written(with_stats(docs.select("doc_id", "text"), "text").drop("text"), "quality-stats")
    score = score_column(train_on(stats, labels))
    out = stats.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score.alias("score"))
    return out.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents whose score is 0.5 or more, columns unchanged."""
    known = labels.where(F.col("quality").isin(0, 1)).select("doc_id").distinct()
    learnt = docs.select("doc_id", "text").where(~held_out(F.col("doc_id"))).join(known, "doc_id", "left_semi")
    model = train_on(with_stats(learnt, "text"), labels)
    rows, names = hidden(docs, "quality_col")
    return with_stats(rows, names["text"]).where(score_column(model) >= 0.5).select(*shown(names))
