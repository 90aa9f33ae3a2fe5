"""Toxicity scores: boosted trees over dense text features, with isotonic calibration.

Fit.  At most ``LABELLED`` labelled rows outside the held-out fold.  A lexicon grows from
them: words and word beginnings (4, 5 and 6 bytes) whose document counts, taken where the
texts are, depend on the label far beyond chance; a short list of English insults is in
it from the start.  Trees are boosted on the features below and calibrated on
out-of-fold margins.

Score.  One pass over whole texts: counts of lexicon words (also under the usual digit and
symbol spellings), their weights, their distance to the next second-person pronoun,
capitals, punctuation, obfuscated words and lengths.  No shuffle; the model is a few
hundred KB.  Ids, languages, sources and labels are never features.

Cases: null and empty texts have no words and a score like any text's; without labels or
with one class the score is the smoothed share of toxic labels.  Repeated rows score
alike; rows without an id are scored with held_out by the text 'null'.  An empty table gives
no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .gbt import boost, isotonic, sigmoid
from .labelled import LABELLED, sample
from .stage import folds, table

# Insults that seed the lexicon, and second-person words of four languages.
INSULTS = "idiot moron stupid scum loser trash worthless pathetic disgusting clown dumb imbecile filth vermin".split()
YOU = "you your yours yourself u ur du dich dir dein deine tu te toi ton ta tes vous vos votre ti tus usted ustedes vosotros su".split()

SEED_WEIGHT = 6.0
BEGINNINGS = (4, 5, 6)
#: Likelihood ratio that a lexicon entry needs, and how many entries are kept at most.
EVIDENCE = 14.0
LEXICON_MOST = 20_000
NEAR = 20

LEET = K.LOWER.copy()
for a, b in zip("013457@$", "oieasta" + "s", strict=True):
    LEET[ord(a)] = ord(b)
LEET_CUT = K.NOT_ALNUM.copy()
LEET_CUT[[ord("@"), ord("$")]] = False
_LEET_MARK = np.isin(np.arange(256), list(b"013457@$"))
_LETTER = np.array([not s for s in K.NOT_ALNUM]) & ~np.isin(np.arange(256), list(b"0123456789"))
_UPPER = np.isin(np.arange(256), list(range(65, 91)))
_BANG = np.isin(np.arange(256), list(b"!?"))
_SYMBOL = K.NOT_ALNUM & ~K.SPACE

FEATURES = ["log_hits", "hit_rate", "weight_rate", "weight_most", "seed_rate", "you_near", "you_rate", "capitals", "bangs", "symbols", "obfuscated", "stretched", "log_words", "word_bytes"]


def _known(words: list[str]) -> np.ndarray:
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    return np.unique(K.Words(data, np.array([0, len(data)]), K.LOWER, K.NOT_ALNUM).hashes)


def keys(w: K.Words) -> list[np.ndarray]:
    """Hashes of each word and of its beginnings (0 where it is shorter); beginnings are kinds of their own."""
    out = [w.hashes]
    for n in BEGINNINGS:
        end = np.minimum(w.start + n, w.end)
        h = K.mix(w.substrings(w.start, end) + K.U(n))
        h[w.end - w.start < n] = 0
        out.append(h)
    return out


def _document_keys(batch: pa.RecordBatch, text: int, want: int | None, y: int | None = None) -> Iterator[np.ndarray]:
    for lo, _, raw, offs in K.pieces(batch.column(text)):
        w = K.Words(raw, offs, K.LOWER, K.NOT_ALNUM)
        every = keys(w)
        for i in range(w.n_docs):
            if y is None or batch.column(y)[lo + i].as_py() == want:
                a, b = w.first[i], w.first[i + 1]
                yield np.unique(np.concatenate([k[a:b] for k in every]))


def _count(label: int, only):
    """Document counts of keys among rows of a label; of ``only`` those keys, if given."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, int] = {}
        for batch in batches:
            held = list(_document_keys(batch, 0, label, 1))
            if held:
                u, c = np.unique(np.concatenate(held), return_counts=True)
                if only is not None:
                    asked = np.isin(u, only.value)
                    u, c = u[asked], c[asked]
                for k, n in zip(u.tolist(), c.tolist(), strict=True):
                    total[k] = total.get(k, 0) + n
            if len(total) > 2_000_000:
                yield _pairs(total)
                total = {}
        yield _pairs(total)

    return f


def _pairs(total: dict[int, int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.array(list(total), np.uint64).view(np.int64)), pa.array(list(total.values()), pa.int64())], names=["k", "n"])


def lexicon(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys and their weights, from rows(text, y)."""
    spark = rows.sparkSession
    sizes = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    pos, neg = sizes.get(1, 0), sizes.get(0, 0)
    seeds = _known(INSULTS)
    weights = {int(k): SEED_WEIGHT for k in seeds}
    if pos and neg:
        found = rows.select("text", "y").mapInArrow(_count(1, None), "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).where(f"k <> 0 and n >= {max(3, pos // 500)}")
        t = found.orderBy(F.desc("n"), "k").limit(10 * LEXICON_MOST).toArrow()
        k = t.column("k").to_numpy().view(np.uint64)
        a = t.column("n").to_numpy().astype(float)
        only = spark.sparkContext.broadcast(k)
        t = rows.select("text", "y").mapInArrow(_count(0, only), "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toArrow()
        other = dict(zip(t.column("k").to_numpy().view(np.uint64).tolist(), t.column("n").to_pylist(), strict=True))
        b = np.array([other.get(x, 0) for x in k.tolist()], float)
        share = pos / (pos + neg)
        g = a * np.log(a / ((a + b) * share))
        good = np.flatnonzero((g >= EVIDENCE) & (a / (a + b) >= min(0.5, 3 * share)))
        good = good[np.lexsort((k[good], -g[good]))][:LEXICON_MOST]
        for i in good:
            weights[int(k[i])] = float(np.log((a[i] + 0.5) / (pos + 1)) - np.log((b[i] + 0.5) / (neg + 1)))
    known = np.array(sorted(weights), np.uint64)
    return known, np.array([weights[int(x)] for x in known])


def features(raw: np.ndarray, offsets: np.ndarray, known: np.ndarray, weights: np.ndarray) -> np.ndarray:
    w = K.Words(raw, offsets, K.LOWER, K.NOT_ALNUM)
    n_docs, n = w.n_docs, len(w.start)
    doc = np.repeat(np.arange(n_docs), w.count)
    every = keys(w)

    def look(h: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(known, h), len(known) - 1)
        return np.where(known[at] == h, weights[at], 0.0)

    weight = np.zeros(n)
    for h in every:
        np.maximum(weight, look(h), out=weight)
    seeds, you = _known(INSULTS), _known(YOU)
    seed = np.isin(every[0], seeds)
    pronoun = np.isin(every[0], you)
    words = np.maximum(w.count, 1)

    def per(values: np.ndarray, of: np.ndarray = doc) -> np.ndarray:
        return np.bincount(of, values, n_docs)

    most = np.zeros(n_docs)
    np.maximum.at(most, doc, weight)
    near = np.zeros(n_docs)
    hits, pro = np.flatnonzero(weight > 0), np.flatnonzero(pronoun)
    if len(hits) and len(pro):
        after = np.searchsorted(pro, hits)
        for side in (np.minimum(after, len(pro) - 1), np.maximum(after - 1, 0)):
            gap = np.abs(pro[side] - hits)
            ok = (doc[pro[side]] == doc[hits]) & (gap <= NEAR)
            np.maximum.at(near, doc[hits[ok]], 1.0 / (1.0 + gap[ok]))

    mark = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(_LEET_MARK[raw], out=mark[1:])
    letters = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(_LETTER[raw], out=letters[1:])
    leet = K.Words(raw, offsets, LEET, LEET_CUT)
    odd = (mark[leet.end] > mark[leet.start]) & (letters[leet.end] > letters[leet.start])
    leet_doc = np.repeat(np.arange(n_docs), leet.count)
    hidden = np.zeros(len(odd))
    hidden[odd] = look(leet.hashes[odd])
    np.maximum.at(most, leet_doc, hidden)
    n_hits = per((weight > 0).astype(float)) + per((hidden > 0).astype(float), leet_doc)
    total = per(weight) + per(hidden, leet_doc)
    same = np.zeros(len(raw), bool)
    if len(raw) > 2:
        same[2:] = (w.folded[2:] == w.folded[1:-1]) & (w.folded[1:-1] == w.folded[:-2]) & _LETTER[raw[2:]]
    n_letters = np.maximum(w.per_doc(_LETTER[raw]), 1)
    n_bytes = np.maximum(np.diff(offsets), 1)
    return np.stack([
        np.log1p(n_hits), n_hits / words, total / words, most, per(seed.astype(float)) / words, near, per(pronoun.astype(float)) / words,
        w.per_doc(_UPPER[raw]) / n_letters, w.per_doc(_BANG[raw]) / words, w.per_doc(_SYMBOL[raw]) / n_bytes, per(odd.astype(float), leet_doc) / words,
        w.per_doc(same) / words, np.log1p(w.count), n_letters / words,
    ], 1)


def _dense(model):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, weights = model.value
        for batch in batches:
            for lo, hi, raw, offs in K.pieces(batch.column(0)):
                x = features(raw, offs, known, weights)
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), pa.array(x.tolist(), pa.list_(pa.float64()))], names=["_id", "y", "x"])

    return f


def fit(docs: DataFrame, labels: DataFrame, most: int = LABELLED):
    """(lexicon keys, weights, trees, calibration) from labelled documents."""
    spark = docs.sparkSession
    rows = sample(docs, labels, "toxic", most)
    words = lexicon(rows)
    t = rows.select("text", "_id", "y").mapInArrow(_dense(spark.sparkContext.broadcast(words)), "_id long, y int, x array<double>").orderBy("_id").toArrow()
    x = np.array(t.column("x").to_pylist(), float).reshape(-1, len(FEATURES))
    y = t.column("y").to_numpy().astype(float)
    margin = np.zeros(len(y))
    fold = (K.mix(t.column("_id").to_numpy().astype(np.int64).view(np.uint64)) % K.U(5)).astype(int)
    for k in range(5):
        if (fold == k).any():
            margin[fold == k] = boost(x[fold != k], y[fold != k]).margin(x[fold == k])
    return *words, boost(x, y), isotonic(margin, y)


def predict(model, x: np.ndarray) -> np.ndarray:
    _, _, trees, (at, value) = model
    m = trees.margin(x)
    if len(at) < 2:
        return sigmoid(m)
    return np.clip(0.999 * np.interp(m, at, value) + 0.001 * sigmoid(m), 0.0, 1.0)


def _score(model):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            for lo, hi, raw, offs in K.pieces(batch.column(1)):
                s = predict(m, features(raw, offs, m[0], m[1]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(s)], names=["doc_id", "score"])

    return f


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of each row of docs(doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    out = docs.mapInArrow(_score(model), "doc_id long, score double")
    return out.select("doc_id", (folds(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def _keep(model, column: int):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            s = [predict(m, features(raw, offs, m[0], m[1])) for _, _, raw, offs in K.pieces(batch.column(column))]
            if s:
                yield batch.filter(pa.array(np.concatenate(s) < 0.5))

    return f


def pipeline_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not rejected as toxic, with all their columns."""
    model = spark.sparkContext.broadcast(fit(docs, table(spark, sf_dir, "labels")))
    return docs.mapInArrow(_keep(model, docs.columns.index("text")), docs.schema)
