"""Document quality rules and host-level verdicts.

Counts of each whole text come from one vectorised pass (16-odd passes over bytes, no
string per word) and are written as a small table.  A rule's failures are summed by
host (partial sums before the shuffle, so a host with a third of all rows is no
burden), each host's rate is shrunk towards an empirical beta prior fitted by the
beta-binomial moments of all hosts, and a host whose shrunk rate exceeds ``HOST_LIMIT`` for
some rule fails with all its documents.  Verdicts join back by host; only failed
hosts are joined.

Cases: null or empty texts have no words and fail the base rule.  Documents without a
source have no host verdict.  Repeated rows keep one result row each; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .stage import staged, table

MIN_WORDS = 20
REPEAT_PERCENT = 30
WINDOW = 8
SYMBOLS = np.isin(np.arange(256), list(b"#*$%&|<>"))
HOST_LIMIT = 0.5
#: The prior weighs so many documents at least, so that no single page fails its host, and at most.
PRIOR_LEAST = 2.0
PRIOR_MOST = 1000.0

_COUNTS = "doc_id long, host string, n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long"


def _repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key: does it occur elsewhere too, does it occur earlier."""
    order = np.argsort(keys, kind="stable")
    same = np.zeros(len(keys) + 1, bool)
    same[1:-1] = keys[order][1:] == keys[order][:-1]
    twice = np.zeros(len(keys), bool)
    later = np.zeros(len(keys), bool)
    twice[order] = same[1:] | same[:-1]
    later[order] = same[:-1]
    return twice, later


def counts(raw: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    w = K.Words(raw, offsets)
    n = len(raw)
    doc = np.repeat(np.arange(w.n_docs), w.count)
    h, whole = K.windows(w.hashes, w.first, WINDOW)
    at = np.flatnonzero(whole)
    twice, _ = _repeated(K.mix(h[at] + doc[at].astype(K.U) * K.U(0x9E3779B97F4A7C15)))
    cover = np.zeros(len(doc) + 1, np.int64)
    np.add.at(cover, at[twice], 1)
    np.add.at(cover, at[twice] + WINDOW, -1)
    repeat = np.bincount(doc, np.cumsum(cover)[:-1] > 0, w.n_docs).astype(np.int64) if len(doc) else np.zeros(w.n_docs, np.int64)

    breaks = np.flatnonzero(raw == 10)
    start = np.unique(np.concatenate([offsets[:-1], breaks + 1]))
    start = start[start < n]
    line_doc = np.searchsorted(offsets, start, "right") - 1
    stop = np.minimum(np.append(start[1:], n), offsets[line_doc + 1])
    stop = np.where((stop > start) & (raw[np.maximum(stop, 1) - 1] == 10), stop - 1, stop) if len(start) else stop
    worded = np.searchsorted(w.start, stop) > np.searchsorted(w.start, start)
    start, stop, line_doc = start[worded], stop[worded], line_doc[worded]
    _, later = _repeated(K.mix(w.substrings(start, stop) + line_doc.astype(K.U) * K.U(0x9E3779B97F4A7C15)))
    return {
        "n_words": w.count.astype(np.int64),
        "word_chars": w.per_doc(w.inside & ((raw & 0xC0) != 0x80)),
        "n_symbols": w.per_doc(SYMBOLS[raw]),
        "n_lines": np.bincount(line_doc, minlength=w.n_docs).astype(np.int64),
        "n_dup_lines": np.bincount(line_doc[later], minlength=w.n_docs).astype(np.int64),
        "n_repeat_words": repeat,
    }


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, raw, offs in K.pieces(batch.column(2)):
            c = counts(raw, offs)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), *(pa.array(x) for x in c.values())], names=["doc_id", "host", *c])


def rules() -> dict[str, Column]:
    """Failures of a document, by rule."""
    return {
        "base": F.expr(f"n_words < {MIN_WORDS} or 100 * n_repeat_words > {REPEAT_PERCENT} * n_words"),
        "symbols": F.expr("10 * n_symbols > n_words"),
        "word_length": F.expr("n_words > 0 and (word_chars < 3 * n_words or word_chars > 12 * n_words)"),
        "dup_lines": F.expr("10 * n_dup_lines > 3 * n_lines"),
    }


def judged(docs: DataFrame) -> DataFrame:
    """Counts, base_failed, host_failed and kept for each row of docs(doc_id, source, text)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("host"), F.col("text").cast("string").alias("text"))
    made = staged(rows.mapInArrow(_count, _COUNTS), "counts")
    names = list(rules())
    hosts = made.where("host is not null").groupBy("host").agg(F.count("*").alias("n"), *(F.sum(c.cast("long")).alias(k) for k, c in rules().items()))
    # moments of the beta-binomial: pairs of documents of one host fail together more often than chance has it
    m = hosts.agg(F.sum("n").alias("n"), F.sum(F.col("n") * (F.col("n") - 1)).alias("pairs"), *(x for k in names for x in (F.sum(k).alias(f"k_{k}"), F.sum(F.col(k) * (F.col(k) - 1)).alias(f"both_{k}")))).first()
    bad = F.lit(False)
    for k in names:
        mean = (m[f"k_{k}"] or 0) / m["n"] if m["n"] else 0.0
        joint = m[f"both_{k}"] / m["pairs"] if m["pairs"] else mean * mean
        rho = (joint - mean * mean) / (mean * (1 - mean)) if 0 < mean < 1 else 0.0
        weight = min(PRIOR_MOST, max(PRIOR_LEAST, 1 / rho - 1)) if rho > 0 else PRIOR_MOST
        bad = bad | ((F.col(k) + F.lit(mean * weight)) / (F.col("n") + F.lit(weight)) > F.lit(HOST_LIMIT))
    failed = hosts.where(bad).select("host", F.lit(True).alias("host_failed"))
    return (
        made.join(failed, "host", "left")
        .withColumn("base_failed", rules()["base"])
        .withColumn("host_failed", F.coalesce("host_failed", F.lit(False)))
        .withColumn("kept", ~F.col("base_failed") & ~F.col("host_failed"))
    )


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "host_failed")


SQL = rf"""
WITH w AS (
  SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
t AS (SELECT doc_id, unnest(words) AS x, generate_subscripts(words, 1) AS i FROM w),
g AS (SELECT doc_id, i, {" || ' ' || ".join(["x", *(f"lead(x, {k}) OVER o" for k in range(1, WINDOW))])} AS gram FROM t WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
h AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM g WHERE gram IS NOT NULL),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM h, (SELECT unnest(range(0, {WINDOW})) AS k) WHERE c > 1 GROUP BY doc_id),
c AS (
  SELECT w.doc_id, source, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) AS BIGINT) AS n_lines,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN r ON r.doc_id = w.doc_id),
f AS (
  SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words AS base_failed, 10 * n_symbols > n_words AS f2,
    n_words > 0 AND (word_chars < 3 * n_words OR word_chars > 12 * n_words) AS f3, 10 * n_dup_lines > 3 * n_lines AS f4 FROM c),
s AS (
  SELECT source, rule, count(*) AS n, sum(CASE WHEN failed THEN 1 ELSE 0 END) AS k
  FROM (SELECT source, 1 AS rule, base_failed AS failed FROM f UNION ALL SELECT source, 2, f2 FROM f UNION ALL SELECT source, 3, f3 FROM f UNION ALL SELECT source, 4, f4 FROM f)
  WHERE source IS NOT NULL GROUP BY source, rule),
p AS (SELECT rule, sum(k) / sum(n) AS m, CASE WHEN sum(n * (n - 1)) > 0 THEN sum(k * (k - 1)) / sum(n * (n - 1)) ELSE (sum(k) / sum(n)) * (sum(k) / sum(n)) END AS j FROM s GROUP BY rule),
o AS (SELECT rule, m, CASE WHEN m > 0 AND m < 1 THEN (j - m * m) / (m * (1 - m)) ELSE 0.0 END AS rho FROM p),
q AS (SELECT rule, m, CASE WHEN rho > 0 THEN least({PRIOR_MOST}, greatest({PRIOR_LEAST}, 1 / rho - 1)) ELSE {PRIOR_MOST} END AS a FROM o),
b AS (SELECT DISTINCT source AS bad FROM s JOIN q ON q.rule = s.rule WHERE (k + m * a) / (n + a) > {HOST_LIMIT})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND bad IS NULL AS kept, bad IS NOT NULL AS host_failed
FROM f LEFT JOIN b ON bad = source
"""
