"""Quality scores by a sparse rule ensemble.

Fit.  Statistics of at most ``LABELLED`` labelled texts outside the held-out fold go
through boosted trees; every path from a root to a node becomes a conjunctive rule, and
lasso logistic regression keeps a few of them with weights.

Score.  The rules are compiled into Spark column expressions over a text's statistics,
which one pass over whole texts computes; no shuffle, and the model is part of the plan.
Ids, languages, sources and labels are never statistics.

Cases: null and empty texts have zero statistics and a score like any text's; without
labels or with one class the score is the smoothed share of good labels.  Repeated rows
score alike.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .gbt import boost, lasso_logistic
from .labelled import LABELLED, sample
from .quality_rules import counts
from .stage import folds, table

STATISTICS = ["words", "word_bytes", "symbol_rate", "capital_rate", "bang_rate", "bar_rate", "digit_rate", "repeat_share", "dup_line_share", "line_words", "short_share", "distinct_share", "upper_word_share", "stop_rate", "symbol_word_share"]
PENALTY = 0.002
_UPPER = np.isin(np.arange(256), list(range(65, 91)))
_LETTER = np.array([(65 <= c < 91) or (97 <= c < 123) or c >= 128 for c in range(256)])
_DIGIT = np.isin(np.arange(256), list(range(48, 58)))
_SYMBOL = np.isin(np.arange(256), list(b"#*$%&|<>{}[]\\^~_=+@"))


def statistics(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    c = counts(raw, offsets)
    w = K.Words(raw, offsets, K.LOWER)
    doc = np.repeat(np.arange(w.n_docs), w.count)
    words, n_bytes = np.maximum(w.count, 1), np.maximum(np.diff(offsets), 1)
    size = w.end - w.start

    def inside(flags: np.ndarray) -> np.ndarray:
        s = np.zeros(len(raw) + 1, np.int64)
        np.cumsum(flags[raw], out=s[1:])
        return s[w.end] - s[w.start]

    letters, upper, symbol = inside(_LETTER), inside(_UPPER), inside(_SYMBOL)
    per = lambda v: np.bincount(doc, v, w.n_docs)
    pairs = np.unique(K.mix(w.hashes + doc.astype(K.U) * K.U(0x9E3779B97F4A7C15)), return_index=True)[1]
    distinct = np.bincount(doc[pairs], minlength=w.n_docs)
    return np.stack([
        np.log1p(w.count), c["word_chars"] / words, c["n_symbols"] / words, w.per_doc(_UPPER[raw]) / np.maximum(w.per_doc(_LETTER[raw]), 1),
        w.per_doc((raw == 33) | (raw == 63)) / words, w.per_doc(raw == 124) / words, w.per_doc(_DIGIT[raw]) / n_bytes, c["n_repeat_words"] / words,
        c["n_dup_lines"] / np.maximum(c["n_lines"], 1), w.count / np.maximum(c["n_lines"], 1), per((size <= 3).astype(float)) / words, distinct / words,
        per(((upper == letters) & (letters > 1)).astype(float)) / words, w.per_doc((raw == 46) | (raw == 44)) / words, per((symbol > 0).astype(float)) / words,
    ], 1)


def _with_statistics(column: int, names: list[str]):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, raw, offs in K.pieces(batch.column(column)):
                x = statistics(raw, offs)
                part = batch.slice(lo, hi - lo)
                kept = [part.column(i) for i in range(part.num_columns) if i != column]
                yield pa.RecordBatch.from_arrays([*kept, *(pa.array(x[:, j]) for j in range(x.shape[1]))], names=names)

    return f


def with_statistics(rows: DataFrame, text: str = "text") -> DataFrame:
    """The rows' columns but the text, and the statistics s_<name>."""
    kept = [c for c in rows.columns if c != text]
    schema = ", ".join([*(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept), *(f"s_{s} double" for s in STATISTICS)])
    return rows.mapInArrow(_with_statistics(rows.columns.index(text), [*kept, *(f"s_{s}" for s in STATISTICS)]), schema)


@dataclass(frozen=True)
class Rule:
    """A conjunction of (statistic, is it at most the threshold?, threshold)."""

    terms: tuple[tuple[int, bool, float], ...]

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for j, below, t in self.terms:
            out &= (x[:, j] <= t) == below
        return out

    def column(self) -> Column:
        return reduce(lambda a, b: a & b, [F.col(f"s_{STATISTICS[j]}") <= F.lit(t) if below else F.col(f"s_{STATISTICS[j]}") > F.lit(t) for j, below, t in self.terms])


def paths(model) -> list[Rule]:
    """Distinct conjunctions along all paths of all trees, in order of first sight."""
    out: dict[Rule, None] = {}
    for tree in model.trees:
        stack: list[tuple[int, tuple]] = [(0, ())]
        while stack:
            node, terms = stack.pop()
            if terms:
                out.setdefault(Rule(tuple(sorted(set(terms)))))
            if tree.feature[node] >= 0:
                j, t = tree.feature[node], tree.threshold[node]
                stack += [(tree.left[node], (*terms, (j, True, t))), (tree.right[node], (*terms, (j, False, t)))]
    return list(out)


def fit(docs: DataFrame, labels: DataFrame, most: int = LABELLED) -> tuple[float, list[tuple[Rule, float]]]:
    """Intercept and the weighted rules that the lasso keeps."""
    rows = sample(docs, labels, "quality", most)
    t = with_statistics(rows).orderBy("_id").toArrow()
    x = np.stack([t.column(f"s_{s}").to_numpy() for s in STATISTICS], 1) if t.num_rows else np.zeros((0, len(STATISTICS)))
    y = t.column("y").to_numpy().astype(float)
    rules = paths(boost(x, y, n_trees=24, depth=3, rate=0.3))
    held = np.stack([r.holds(x) for r in rules], 1).astype(float) if rules else np.zeros((len(y), 0))
    b, w = lasso_logistic(held, y, PENALTY)
    return b, [(r, float(v)) for r, v in zip(rules, w, strict=True) if v]


def score(model: tuple[float, list[tuple[Rule, float]]]) -> Column:
    """The compiled ensemble over columns s_<statistic>."""
    b, rules = model
    total = reduce(lambda a, r: a + F.when(r[0].column(), F.lit(r[1])).otherwise(F.lit(0.0)), rules, F.lit(b))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of each row of docs(doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rated = with_statistics(docs).select("doc_id", score(fit(docs, labels)).alias("score"))
    return rated.select("doc_id", (folds(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
