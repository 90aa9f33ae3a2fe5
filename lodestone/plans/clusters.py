"""Fingerprints, near pairs, and clusters in order of arrival."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import arrivals, groups
from ..operators.staging import staged
from ..sources import ROLE_SQL, table, verdicts
from . import query

# the fingerprint bit by bit, in plain SQL
_SIMHASH = r"""g AS (SELECT doc_id, unnest(list_distinct(CASE WHEN length(x) >= 3 THEN list_transform(range(1, length(x) - 1), lambda i: substr(x, i, 3)) WHEN x <> '' THEN [x] ELSE [CAST(NULL AS VARCHAR)] END)) AS g
  FROM (SELECT doc_id, regexp_replace({text}, '[\s\x0b　]+', '', 'g') AS x FROM documents) d),
s AS (SELECT doc_id, """ + " | ".join(f"CASE WHEN 2 * coalesce(sum((h >> {i}) & 1), 0) > count(h) THEN CAST({1 << i} AS UBIGINT) ELSE CAST(0 AS UBIGINT) END" for i in range(64)) + r""" AS u
  FROM (SELECT doc_id, CAST('0x' || left(md5(g), 16) AS UBIGINT) AS h FROM g) b GROUP BY doc_id)"""
WHOLE_SQL = _SIMHASH.replace("{text}", "coalesce(text, '')")
SIMHASH_SQL = _SIMHASH.replace("{text}", "left(coalesce(text, ''), 8000)")
_SIGNED = "CAST(CASE WHEN u >= 9223372036854775808 THEN CAST(u AS HUGEINT) - 18446744073709551616 ELSE u END AS BIGINT)"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    return d.withColumn("at", F.struct("id")).withColumn("title", F.substring(F.substring_index("text", "\n", 1), 1, 40))


@query("simhash64", f"WITH {WHOLE_SQL} SELECT doc_id, {_SIGNED} AS simhash FROM s")
def simhash64(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-9, FN-10: votes of the 64 bits over every distinct piece of the whole text."""
    return arrivals.simhashes(_documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")


@query("near_dup_pairs", f"""WITH {WHOLE_SQL}
SELECT x.doc_id AS a, y.doc_id AS b, CAST(bit_count(xor(x.u, y.u)) AS INT) AS distance FROM s x JOIN s y ON x.doc_id < y.doc_id AND bit_count(xor(x.u, y.u)) <= 6""")
def near_dup_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-11, JN-17: all pairs of documents within 6 bits.  Those with the same simhash are compared with others as one, and become pairs at the end."""
    h = staged(simhash64(spark, sf_dir).where("doc_id IS NOT NULL"), "fingerprints")
    kinds = h.groupBy("simhash").agg(F.min("doc_id").alias("at"), F.count("*").alias("n"))
    each = kinds.select("simhash", "at")
    near = arrivals.met(each, each).where((F.col("x.simhash") < F.col("y.simhash")) & (arrivals.distance("x", "y") <= arrivals.MOST))
    links = near.select(F.col("x.simhash").alias("u"), F.col("y.simhash").alias("v"), arrivals.distance("x", "y").alias("distance")).distinct()
    links = links.union(kinds.where("n > 1").select("simhash", "simhash", F.lit(0)))
    held = groups.blocks(h, ["simhash"], "doc_id")
    return groups.expanded(links, held, {"u": "simhash"}, {"v": "simhash"}, F.col("u") == F.col("v")).select("a", "b", "distance")


# the loop over arrivals, one step a row: rows before it that are near, and those of them that represent
_LOOP = """p AS MATERIALIZED (SELECT x.n, list(y.n) FILTER (y.n < x.n AND {near}) AS near FROM r x JOIN r y ON y.n <= x.n GROUP BY x.n),
w(n, reps) AS (SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[]) UNION ALL SELECT p.n, CASE WHEN len(list_intersect(w.reps, coalesce(p.near, []))) > 0 THEN w.reps ELSE list_append(w.reps, p.n) END FROM w JOIN p ON p.n = w.n + 1),
e AS MATERIALIZED (SELECT unnest(reps) AS n FROM (SELECT reps FROM w ORDER BY n DESC LIMIT 1) z)"""
_CLUSTER = "'sc-' || left(lpad(lower(to_hex({u})), 16, '0'), 12)"
_LONG = "abs(x.chars - y.chars) <= 0.5 * greatest(x.chars, y.chars) AND bit_count(xor(x.u, y.u)) <= 6"


@query("first_fit_clusters", f"""WITH RECURSIVE {SIMHASH_SQL},
r AS MATERIALIZED (SELECT row_number() OVER (ORDER BY doc_id) AS n, doc_id, length(text) AS chars, u FROM documents JOIN s USING (doc_id) JOIN labels USING (doc_id) WHERE length(text) >= 300 AND {ROLE_SQL} <> 'REJECT'),
{_LOOP.format(near=_LONG)},
b AS (SELECT x.n, x.doc_id, min(y.n) AS rep FROM r x JOIN r y ON y.n <= x.n AND {_LONG} JOIN e ON e.n = y.n GROUP BY x.n, x.doc_id)
SELECT b.doc_id, {_CLUSTER.format(u="r.u")} AS cluster_id, r.doc_id AS representative FROM b JOIN r ON r.n = b.rep""")
def first_fit_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DD-3, WN-6: admitted documents of 300 characters and more, clustered in order of arrival (of doc_id), first fit."""
    admitted = verdicts(spark, sf_dir).where("role <> 'REJECT'").select(F.col("doc_id").alias("id"))
    return arrivals.first_fit(_documents(spark, sf_dir).join(admitted, "id", "left_semi")).withColumnRenamed("id", "doc_id")


_TITLES = "CASE WHEN length(t) > 1 THEN list_distinct(list_transform(range(1, length(t)), lambda i: substr(t, i, 2))) ELSE [t] END"
_CONF = "((1 - bit_count(xor(x.u, y.u)) / 7.0::DOUBLE) * 0.6::DOUBLE + len(list_intersect(x.ts, y.ts)) / len(list_distinct(list_concat(x.ts, y.ts)))::DOUBLE * 0.4::DOUBLE)"
_FITS = f"{_LONG} AND {_CONF} >= 0.55::DOUBLE"


@query("best_fit_clusters", f"""WITH RECURSIVE {SIMHASH_SQL},
r AS MATERIALIZED (SELECT row_number() OVER (ORDER BY doc_id) AS n, doc_id, chars, u, {_TITLES} AS ts FROM (SELECT doc_id, length(text) AS chars, u, left(split_part(text, chr(10), 1), 40) AS t FROM documents JOIN s USING (doc_id) WHERE length(text) >= 300) k),
{_LOOP.format(near=_FITS)},
b AS (SELECT x.n, x.doc_id, x.u, arg_min(y.n, (-{_CONF}, y.n)) AS rep, max({_CONF}) AS c FROM r x JOIN r y ON y.n < x.n AND {_FITS} JOIN e ON e.n = y.n WHERE x.n NOT IN (SELECT n FROM e) GROUP BY x.n, x.doc_id, x.u)
SELECT b.doc_id, {_CLUSTER.format(u="r.u")} AS cluster_id, r.doc_id AS representative, round(c, 2) AS confidence, 'simhash64+title' AS method FROM b JOIN r ON r.n = b.rep
UNION ALL SELECT doc_id, {_CLUSTER.format(u="u")}, doc_id, 1.0, 'new-cluster' FROM r JOIN e ON e.n = r.n""")
def best_fit_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DD-2, WN-4: each document of 300 characters and more joins the most confident earlier cluster, or opens one.

    The streaming form, ``streaming.clusters``, gives the same rows batch by batch.
    """
    return arrivals.best_fit(arrivals.fingerprinted(_documents(spark, sf_dir)))[0].select(F.col("id").alias("doc_id"), "cluster_id", "representative", "confidence", "method")
