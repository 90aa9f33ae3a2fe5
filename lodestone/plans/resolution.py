"""Mentions and entities made from vectors and part names, and their resolution.

Vectors with even ids are entities, those with odd ids mentions; every other mention is moved close to the entity
before it and has its type.  Labels are types, part names are names; judges answer by arithmetic on ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import resolution as R
from ..sources import table
from . import query

DESCENDING = [0, 1, 2]
_WRONG = "words that no text holds"


def _mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    before = v.select((F.col("vec_id") + 1).alias("vec_id"), F.col("embedding").alias("other"), F.col("label").alias("other_label"))
    names = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("vec_id"), "p_name")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), "text")
    close = (F.col("vec_id") % 4 == 1) & F.col("other").isNotNull()
    moved = F.when(close, F.zip_with("embedding", "other", lambda a, b: 0.15 * a.cast("double") + 0.85 * b.cast("double"))).otherwise(F.col("embedding").cast("array<double>"))
    return v.where("vec_id % 2 = 1").join(before, "vec_id", "left").join(names, "vec_id", "left").join(docs, "vec_id", "left").select(F.col("vec_id").alias("mention"), F.col("p_name").alias("name"), F.when(close, F.col("other_label")).otherwise(F.col("label")).alias("type"), moved.alias("vector"), "text")


def _entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("vec_id"), "p_name")
    return table(spark, sf_dir, "embeddings").where("vec_id % 2 = 0").join(names, "vec_id", "left").select(F.col("vec_id").alias("entity"), F.col("p_name").alias("name"), F.col("label").alias("type"), F.col("embedding").cast("array<double>").alias("vector"))


def _aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third entity is also called as the part five after its own."""
    return _entities(spark, sf_dir).where("entity % 6 = 0").select("entity").join(table(spark, sf_dir, "part").select((F.col("p_partkey") - 5).alias("entity"), F.concat(F.lit(" "), F.upper("p_name")).alias("alias")), "entity")


_SAME = "CASE WHEN (mention + entity) % 5 IN (0, 1) THEN 'same' ELSE 'different' END"
_RELATION = "CASE mention % 5 WHEN 0 THEN 'historical_name_of' WHEN 1 THEN 'successor_of' WHEN 2 THEN 'predecessor_of' WHEN 3 THEN 'NO_RELATION' ELSE 'kin' END"
_DOT = "list_inner_product({a}, {b})"
_MADE = f"""m AS MATERIALIZED (SELECT v.vec_id AS mention, lower(trim(p_name)) AS n, CASE WHEN v.vec_id % 4 = 1 AND o.embedding IS NOT NULL THEN o.label ELSE v.label END AS type, text, CASE WHEN v.vec_id % 4 = 1 AND o.embedding IS NOT NULL THEN
    list_transform(list_zip(v.embedding, o.embedding), lambda z: 0.15::DOUBLE * z[1]::DOUBLE + 0.85::DOUBLE * z[2]::DOUBLE) ELSE v.embedding::DOUBLE[] END AS x
  FROM embeddings v LEFT JOIN embeddings o ON o.vec_id = v.vec_id - 1 LEFT JOIN part ON p_partkey = v.vec_id LEFT JOIN documents ON doc_id = v.vec_id WHERE v.vec_id % 2 = 1),
e AS MATERIALIZED (SELECT vec_id AS entity, lower(trim(p_name)) AS n, label AS type, embedding::DOUBLE[] AS y FROM embeddings LEFT JOIN part ON p_partkey = vec_id WHERE vec_id % 2 = 0),
c AS MATERIALIZED (SELECT mention, entity, c, row_number() OVER (PARTITION BY mention ORDER BY round(c, 9) DESC, entity) AS r FROM (SELECT mention, entity, {_DOT.format(a='x', b='y')} / (sqrt({_DOT.format(a='x', b='x')}) * sqrt({_DOT.format(a='y', b='y')})) AS c FROM m JOIN e ON m.type = e.type) k WHERE c >= 0.8)"""


@query("similar_entities", f"WITH {_MADE} SELECT mention, entity, round(c, 6) AS score FROM c WHERE r <= 3")
def similar_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN-5: the three most similar entities of a mention's type with a cosine of 0.80 and more."""
    return R.similar(_mentions(spark, sf_dir), _entities(spark, sf_dir)).select("mention", "entity", F.round("score", 6).alias("score"))


@query("entity_resolution", f"""WITH {_MADE},
al AS (SELECT mention, min(e.entity) AS entity FROM e JOIN part ON p_partkey = e.entity + 5 JOIN m ON m.type = e.type AND m.n = lower(trim(p_name)) WHERE e.entity % 6 = 0 GROUP BY mention),
p AS (SELECT mention, entity, 'exact' AS stage FROM m JOIN e USING (type, n) UNION ALL SELECT mention, entity, 'alias' FROM al WHERE NOT EXISTS (SELECT 1 FROM m JOIN e USING (type, n) WHERE m.mention = al.mention)
  UNION ALL SELECT mention, entity, 'embedding' FROM c WHERE r <= 3 AND mention NOT IN (SELECT mention FROM al) AND NOT EXISTS (SELECT 1 FROM m JOIN e USING (type, n) WHERE m.mention = c.mention)),
d AS (SELECT m.*, (SELECT min(stage) FROM p WHERE p.mention = m.mention) AS stage, (SELECT count(*) FROM p WHERE p.mention = m.mention AND {_SAME} = 'same') AS hits, (SELECT min(entity) FROM p WHERE p.mention = m.mention AND {_SAME} = 'same') AS hit,
  (SELECT entity FROM c WHERE c.mention = m.mention AND r = 1) AS related FROM m),
f AS (SELECT *, hits = 0 AND stage IS NOT NULL AND type IN (0, 1, 2) AND related IS NOT NULL AS descends, {_RELATION} AS rel, CASE WHEN mention % 7 = 0 THEN '{_WRONG}' ELSE substr(text, 11, 24) END AS quote FROM d),
g AS (SELECT *, CASE WHEN descends THEN CASE WHEN rel = 'kin' THEN 'UNRESOLVED' ELSE rel END END AS relation FROM f),
h AS (SELECT *, CASE WHEN relation IN ('historical_name_of', 'successor_of', 'predecessor_of') THEN coalesce(length(quote) > 0 AND contains(text, quote), false) WHEN relation IS NOT NULL THEN false END AS proven FROM g)
SELECT mention, coalesce(stage, 'no-match') AS stage, CASE WHEN hits = 1 THEN 'MERGED' WHEN hits > 1 THEN 'UNRESOLVED' ELSE 'NEW' END AS status, CASE WHEN hits = 1 THEN hit END AS entity, relation, CASE WHEN relation IS NOT NULL THEN related END AS related, proven,
  CASE WHEN relation IN ('NO_RELATION', 'UNRESOLVED') THEN 0.2::DOUBLE WHEN proven THEN 0.6::DOUBLE WHEN relation IS NOT NULL THEN 0.35::DOUBLE END AS confidence FROM h""")
def entity_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DD-6, DD-7, DD-8: the funnel of names, aliases and vectors, the judge's verdicts, and descent proven by quotes."""
    mentions, entities = _mentions(spark, sf_dir), _entities(spark, sf_dir)
    near = R.staged(R.similar(mentions, entities), "similar")
    pairs = R.staged(R.funnel(mentions, entities, _aliases(spark, sf_dir), near), "funnel")
    verdicts = pairs.select("mention", "entity", F.expr(_SAME).alias("verdict"))
    asked = near.join(mentions.select("mention", "text"), "mention")
    relations = asked.select("mention", "entity", F.expr(_RELATION).alias("relation"), F.when(F.col("mention") % 7 == 0, _WRONG).otherwise(F.substring("text", 11, 24)).alias("quote"))
    return R.decide(mentions, pairs, verdicts, near, relations, DESCENDING)
