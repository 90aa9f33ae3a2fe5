"""Graph files written and read, a vocabulary applied to a store, and resources taken through stages."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import seeds as S
from ..operators.staging import shared_dir
from ..sources import ROLE_SQL, graphml, table, verdicts
from ..streaming import stages
from . import query
from .validation import made


def _new(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/lodestone/{name}-{uuid.uuid4().hex}"


#: Elements of a file: an XML file is read by one task.
FILE_ROWS = 250_000
#: Declared attributes: key, of what, name, type.
_KEYS = [("d0", "node", "entity_type", "string"), ("d1", "node", "balance", "double"), ("d7", "edge", "weight", "long"), ("d9", "edge", "keywords", "string")]


def _written(spark: SparkSession, sf_dir: str) -> str:
    """Suppliers and parts as nodes, lines between them as edges, in GraphML as Spark's XML writer makes it."""
    def data(**values) -> object:
        return F.array(*(F.struct(v.alias("_VALUE"), F.lit(k).alias("_key")) for k, v in values.items()))

    kind = F.when(F.col("p_size") > 5, F.col("p_type"))
    nodes = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("_id"), data(d0=F.lit(" supplier <of> & more"), d1=F.col("s_acctbal").cast("string")).alias("data"))
    nodes = nodes.unionByName(table(spark, sf_dir, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("_id"), F.when(kind.isNull(), data(d1=F.lit("none"))).otherwise(data(d0=kind, d1=F.lit("none"))).alias("data")))
    lines = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.count("*").cast("string").alias("n"))
    edges = lines.select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("_source"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("_target"), data(d7=F.col("n")).alias("data"))
    path = _new(spark, "graph")
    for name, rows in (("key", spark.createDataFrame(_KEYS, "_id string, _for string, `_attr.name` string, `_attr.type` string")), ("node", nodes), ("edge", edges)):
        rows.write.format("xml").option("rootTag", "graphml").option("rowTag", name).option("maxRecordsPerFile", FILE_ROWS).save(f"{path}/{name}s")
    return f"{path}/*"


@query("graphml_import", """SELECT 'node' AS kind, 's' || s_suppkey AS a, NULL AS b, ' supplier <of> & more' AS label, s_acctbal AS number FROM supplier UNION ALL SELECT 'node', 'p' || p_partkey, NULL, CASE WHEN p_size > 5 THEN p_type END, NULL FROM part
  UNION ALL SELECT 'edge', 's' || l_suppkey, 'p' || l_partkey, NULL, CAST(count(*) AS DOUBLE) FROM lineitem GROUP BY l_suppkey, l_partkey""")
def graphml_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-6: a graph file read back with the types that it declares; what isn't of its type is null."""
    path = _written(spark, sf_dir)
    n, e = graphml.nodes(spark, path), graphml.edges(spark, path)
    return n.select(F.lit("node").alias("kind"), F.col("id").alias("a"), F.lit(None).cast("string").alias("b"), F.col("entity_type").alias("label"), F.col("balance").alias("number")).unionByName(
        e.select(F.lit("edge").alias("kind"), F.col("source").alias("a"), F.col("target").alias("b"), F.col("keywords").alias("label"), F.col("weight").cast("double").alias("number")))


# customers as a tree, a cycle and an orphan: the seed, what is stored, and old names
_SEED = "SELECT 'c' || CAST(c_custkey AS STRING) AS name, CASE WHEN c_custkey IN (11, 12) THEN 'c' || CAST(23 - c_custkey AS STRING) WHEN c_custkey = 14 THEN 'gone' WHEN c_custkey > 0 THEN 'c' || CAST(CAST(floor(c_custkey / 3) AS BIGINT) AS STRING) END AS parent, c_mktsegment AS description FROM customer WHERE c_custkey % 10 <> 9 OR c_custkey < 60 "
_STORED = "SELECT CASE WHEN c_custkey % 13 = 5 THEN 'old' ELSE 'c' END || CAST(c_custkey AS STRING) AS name, CASE WHEN c_custkey > 0 THEN 'c' || CAST(CAST(floor(c_custkey / 3) AS BIGINT) AS STRING) END AS parent, CASE WHEN c_custkey % 4 = 0 THEN 'before' ELSE c_mktsegment END AS description FROM customer WHERE c_custkey % 7 <> 2 "
_RENAMES = "SELECT 'old' || CAST(c_custkey AS STRING) AS old, 'c' || CAST(c_custkey AS STRING) AS new FROM customer WHERE c_custkey % 13 = 5 OR c_custkey % 13 = 6 "


@query("seed_apply", f"""WITH RECURSIVE s AS MATERIALIZED ({_SEED}), l AS (SELECT name, 0 AS level FROM s WHERE parent IS NULL UNION ALL SELECT s.name, level + 1 FROM s JOIN l ON s.parent = l.name), a AS ({_STORED}),
m AS (SELECT CASE WHEN a.name LIKE 'old%' THEN 'c' || substr(a.name, 4) ELSE a.name END AS name, CASE WHEN a.name LIKE 'old%' THEN a.name END AS was, parent, description FROM a)
SELECT coalesce(s.name, m.name) AS name, CASE WHEN s.name IS NULL THEN 'DELETE' WHEN level IS NULL THEN 'REFUSE' WHEN m.name IS NULL THEN 'INSERT' WHEN s.parent IS DISTINCT FROM m.parent OR s.description IS DISTINCT FROM m.description THEN 'UPDATE' WHEN was IS NOT NULL THEN 'RENAME' ELSE 'KEEP' END AS action, level, was
FROM s LEFT JOIN l ON l.name = s.name FULL JOIN m ON m.name = s.name""")
def seed_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-7, SNK-9: the plan by which a vocabulary replaces what is stored, carried out on a store."""
    store = _new(spark, "vocabulary")
    S.swap(made(spark, sf_dir, _STORED), store)
    return S.apply(made(spark, sf_dir, _SEED), store, made(spark, sf_dir, _RENAMES))


@query("resource_stages", rf"""WITH r AS (SELECT doc_id AS resource, text FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE {ROLE_SQL} <> 'REJECT')),
c AS (SELECT resource, i AS part, substr(text, i * 1200 + 1, 1200) AS chunk FROM r, range(0, 200) t(i) WHERE i * 1200 < length(text)),
k AS (SELECT * FROM c WHERE length(chunk) >= 60 AND len(regexp_extract_all(chunk, '[。！？.!?\n]')) / length(chunk) >= 0.005),
q AS (SELECT *, list_filter(list_transform(string_split_regex(chunk, '[。！？!?.\n]'), lambda x: trim(x, ' ')), lambda x: length(x) >= 20)[1] AS quote FROM k)
SELECT d.doc_id AS resource, CASE WHEN d.doc_id NOT IN (SELECT resource FROM r) THEN 'PENDING' WHEN d.doc_id NOT IN (SELECT resource FROM k) THEN 'GATED' WHEN d.doc_id NOT IN (SELECT resource FROM q WHERE quote IS NOT NULL) THEN 'CHUNK_GATED' ELSE 'DONE' END AS stage,
  (SELECT count(*) FROM q WHERE q.resource = d.doc_id AND quote IS NOT NULL) AS claims, (SELECT count(*) FROM q WHERE q.resource = d.doc_id AND contains(chunk, quote)) AS exact FROM documents d""")
def resource_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AD-7: all documents as one batch; the stage that each reached, its claims and those bound as written."""
    store = _new(spark, "stages")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("resource"), "text")
    judged = verdicts(spark, sf_dir).select(F.col("doc_id").alias("resource"), "role")
    out = stages.advance(docs, 0, store, stages.knowledge_stages(judged))
    claims = out.groupBy("resource").agg(F.count("*").alias("claims"), F.count_if(F.col("match") == "EXACT").alias("exact"))
    reached = stages.log(spark, store).where("result = 'PASS'").groupBy("resource").agg(F.max_by("stage", "position").alias("stage"))
    return docs.select("resource").join(reached, "resource", "left").join(claims, "resource", "left").select("resource", F.coalesce("stage", F.lit("PENDING")).alias("stage"), F.coalesce("claims", F.lit(0)).alias("claims"), F.coalesce("exact", F.lit(0)).alias("exact"))
