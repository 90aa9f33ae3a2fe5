"""Soft-membership mixing: document rates that meet domain token targets.

1.  A multinomial model of hashed words, fitted on about ``LABELLED`` rows whose domain
    is known, gives every document posteriors over the domains.
2.  Targets: tokens by domain, from weights (default: the square root of each domain's
    own expected share, which lifts small domains).  With ``repeat`` (default) the total is
    the least for which no domain shrinks, and rates are 1 at least, so every document
    stays; else the total is the corpus's own, and rates are 0 at least.
3.  Rates from there minimise the squared misses of expected domain totals,
    sum_d rate_d tokens_d p_dk against target_k, by projected gradient steps from rate 1.
    They have no upper bound unless ``most`` sets one; what domains of too few tokens then
    lack of their target shows in the report.
    A step moves a rate by its document's posteriors times a vector of K numbers, so an
    iteration is one pass of sums over (tokens, posteriors); rates are never stored
    between passes, and the driver holds K numbers a step.

All known domains take part.  A document holds K posteriors and a pass sums K * K numbers
a task, so the cost grows with the square of the number of domains.

Cases: null and empty texts have no words: their posteriors are the classifier's prior
and they weigh nothing.  Without known domains there is one domain, and all rates are 1.
A domain without tokens has no target.  Repeated rows are rated alike, and rows are told
apart by doc_id and text, so those without a doc_id, or with another row's, have copies of
their own; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .stage import staged, table

LABELLED = 8_000
HASHED = 1 << 12
STEPS = 60
TOLERANCE = 1e-4
#: Steps end when so many of them have not lessened the largest miss by a hundredth.
STALLED = 4


def _bags(batch: pa.RecordBatch, text: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, last row, document, hashed word, its share) of each piece, and counts of words."""
    for lo, hi, raw, offs in K.pieces(batch.column(text)):
        w = K.Words(raw, offs, K.LOWER, K.NOT_ALNUM)
        doc = np.repeat(np.arange(w.n_docs), w.count)
        yield lo, hi, w.count.astype(np.int64), doc, (w.hashes & K.U(HASHED - 1)).astype(np.int64)


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word counts of the sample by domain."""
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        for lo, hi, n, doc, word in _bags(batch, 0):
            names = batch.column(1).slice(lo, hi - lo).to_pylist()
            for k in set(names):
                own = np.array([x == k for x in names])
                total[k] = total.get(k, 0) + np.bincount(word[own[doc]], minlength=HASHED)
    for k, v in total.items():
        has = np.flatnonzero(v)
        yield pa.RecordBatch.from_arrays([pa.array([k] * len(has), pa.string()), pa.array(has.astype(np.int64)), pa.array(v[has].astype(np.int64))], names=["domain", "word", "n"])


def classifier(docs: DataFrame, domain: Column, most: int = LABELLED) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Domains, log weights (word x domain) and log priors of a multinomial model of words."""
    known = docs.where(domain.isNotNull()).select("text", domain.cast("string").alias("domain"), F.xxhash64("doc_id", "text").alias("h"))
    counted = known.groupBy("domain").agg(F.count("*").alias("n")).collect()
    if not counted:
        return ["all"], np.zeros((HASHED, 1)), np.zeros(1)
    names = sorted(r["domain"] for r in counted)
    total = sum(r["n"] for r in counted)
    # hashes are spread over all 64-bit integers, so a threshold gives about ``most`` rows without a sort
    limit = min(2**63 - 1, int(min(1.0, most / total) * 2**64) - 2**63)
    t = known.where(F.col("h") <= F.lit(limit)).select("text", "domain").mapInArrow(_totals, "domain string, word long, n long")
    c = np.ones((HASHED, len(names))) * 0.5
    place = {k: i for i, k in enumerate(names)}
    sums = t.groupBy("domain", "word").agg(F.sum("n").alias("n")).toArrow()
    seen = sums.column("domain").combine_chunks().dictionary_encode()
    column = np.array([place[k] for k in seen.dictionary.to_pylist()], np.int64)[seen.indices.to_numpy()]
    c[sums.column("word").to_numpy(), column] += sums.column("n").to_numpy()
    rows = {r["domain"]: r["n"] for r in counted}
    prior = np.array([rows[k] for k in names], float)
    return names, np.log(c / c.sum(0)), np.log(prior / prior.sum())


def _posteriors(model):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, weight, prior = model.value
        for batch in batches:
            for lo, hi, n, doc, word in _bags(batch, 1):
                # mean log-likelihood ratio, sharpened up to 30 words' evidence: longer texts are not more certain than that
                logit = np.stack([np.bincount(doc, weight[word, k], hi - lo) for k in range(weight.shape[1])], 1)
                logit = logit / np.maximum(n, 1)[:, None] * np.minimum(n, 30)[:, None] + prior
                p = np.exp(logit - logit.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(n), pa.array(p.tolist(), pa.list_(pa.float64()))], names=["row", "n_tokens", "p"])

    return f


def _sums(k: int, low: float, most: float):
    """Of a task, sums of rate x tokens x posterior at domain, and of tokens x the posteriors' products where the rate is at no bound."""
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, a = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            n, r = batch.column(0).to_numpy(zero_copy_only=False).astype(float), batch.column(2).to_numpy(zero_copy_only=False)
            p = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(n), k)
            t += (r * n) @ p
            a += (p * np.where(((r > low) | (low > 0)) & (r < most), n, 0.0)[:, None]).T @ p
        every = np.concatenate([t, a.ravel()])
        some = np.flatnonzero(every)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(every[some])], names=["place", "v"])

    return f


def _dot(step: np.ndarray) -> Column:
    return sum((F.col("p")[k] * F.lit(float(v)) for k, v in enumerate(step)), F.lit(0.0))


def _rate(steps: list[np.ndarray], low: float, most: float) -> Column:
    """The rate after all steps, each cut to the bounds."""
    return F.aggregate(F.array(*[F.array(*[F.lit(float(v)) for v in s]) for s in steps]), F.lit(1.0), lambda r, s: F.least(F.lit(most), F.greatest(F.lit(low), r - F.aggregate(F.zip_with(F.col("p"), s, lambda a, b: a * b), F.lit(0.0), lambda x, y: x + y)))) if steps else F.lit(1.0)


def targets_of(natural: np.ndarray, weights: np.ndarray | None, repeat: bool) -> np.ndarray:
    """Target tokens by domain."""
    w = np.sqrt(natural) if weights is None else np.where(natural > 0, weights, 0.0)
    if not w.sum():
        return natural
    share = w / w.sum()
    live = share > 0
    return share * (np.max(natural[live] / share[live]) if repeat else natural.sum())


def rates(docs: DataFrame, domain: str = "lang", weights: dict[str, float] | None = None, repeat: bool = True, most: float = float("inf")) -> tuple[DataFrame, dict]:
    """Rows (key, doc_id, n_tokens, p, rate), and domains, targets and totals reached.  ``key`` is ``row_key``'s."""
    spark = docs.sparkSession
    model = classifier(docs, docs[domain])
    names = model[0]
    rows = docs.select(F.struct(F.col("doc_id").cast("long").alias("doc_id"), row_key(docs).alias("key")).alias("row"), F.col("text").cast("string").alias("text"))
    rows = rows.mapInArrow(_posteriors(spark.sparkContext.broadcast(model)), "row struct<doc_id:long,key:long>, n_tokens long, p array<double>")
    rows = staged(rows.select("row.key", "row.doc_id", "n_tokens", "p"), "posteriors")
    k, low = len(names), 1.0 if repeat else 0.0

    def totals(steps: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        sums = np.zeros(k + k * k)
        parts = rows.select("n_tokens", "p", _rate(steps, low, most).alias("r")).mapInArrow(_sums(k, low, most), "place int, v double").groupBy("place").agg(F.sum("v").alias("v")).toArrow()
        sums[parts.column("place").to_numpy()] = parts.column("v").to_numpy()
        return sums[:k], sums[k:].reshape(k, k)

    natural, curve = totals([])
    target = targets_of(natural, None if weights is None else np.array([weights.get(n, 0.0) for n in names]), repeat)
    steps: list[np.ndarray] = []
    reached, best, stalled = natural, np.inf, 0
    for _ in range(STEPS):
        miss = reached - target
        worst = np.max(np.abs(miss) / np.maximum(target, 1))
        best, stalled = (worst, 0) if worst < 0.99 * best else (best, stalled + 1)
        if worst <= TOLERANCE or stalled == STALLED:
            break
        # gradient in the metric that the curvature of the rates still above 0 gives
        steps.append(np.linalg.lstsq(curve + np.eye(len(names)) * (1e-9 * max(curve.trace(), 1.0)), miss, rcond=None)[0])
        reached, curve = totals(steps)
    out = rows.withColumn("rate", _rate(steps, low, most))
    return out, {"domains": names, "natural": natural, "target": target, "reached": reached, "steps": steps}


def row_key(docs: DataFrame) -> Column:
    """A hash of a row's doc_id and text."""
    doc_id = docs["doc_id"].cast("long")
    return F.xxhash64(doc_id.isNull(), doc_id, docs["text"].cast("string"))


def copies(rate: Column, key: Column) -> Column:
    """Whole copies of a document: the rate's whole part, and one more with the fraction's probability by a hash of the key."""
    u = (F.xxhash64(key, F.lit("mix")).bitwiseAND(F.lit((1 << 40) - 1))) / F.lit(float(1 << 40))
    return (F.floor(rate) + F.when(u < rate - F.floor(rate), 1).otherwise(0)).cast("long")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, report = rates(table(spark, sf_dir, "documents"))
    domain = F.array(*[F.lit(n) for n in report["domains"]])[F.array_position("p", F.array_max("p")).cast("int") - 1]
    return out.select("doc_id", "n_tokens", domain.alias("domain"), F.round(F.array_max("p"), 9).alias("posterior"), F.round("rate", 9).alias("rate"), copies(F.col("rate"), F.col("key")).alias("copies"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """Documents, with all their columns, in their number of copies (0 is possible without ``repeat``)."""
    out, _ = rates(docs, **options)
    spare = "_" * (1 + max(map(len, docs.columns)))  # longer than any column of docs
    key, times, one = f"{spare}id", f"{spare}copies", f"{spare}one"
    want = out.groupBy(F.col("key").alias(key)).agg(F.max(copies(F.col("rate"), F.col("key"))).alias(times)).where(F.col(times) != 1)
    joined = docs.join(want, row_key(docs) == want[key], "left").withColumn(times, F.coalesce(F.col(times), F.lit(1)).cast("int"))
    return joined.withColumn(one, F.explode(F.array_repeat(F.lit(1), F.col(times)))).select(*(f"`{c}`" for c in docs.columns))


def pipeline_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in their number of copies; every document stays at least once."""
    return mixed(docs)
