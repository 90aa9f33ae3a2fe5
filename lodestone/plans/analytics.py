"""Graph, vector, validation and streaming queries over the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import graph, retrieval
from ..sources import table
from ..streaming import windows
from . import query

_EDGES = "(SELECT DISTINCT l_suppkey AS a, l_partkey + 1000000 AS b FROM lineitem)"
_BFS = f"""WITH RECURSIVE e AS MATERIALIZED (SELECT a, b FROM {_EDGES} x UNION SELECT b, a FROM {_EDGES} y),
r AS (SELECT CAST(1 AS BIGINT) AS node, 0 AS hop UNION SELECT CAST(b AS BIGINT), hop + 1 FROM r JOIN e ON a = node WHERE hop < 3)
SELECT node, min(hop) AS hop FROM r GROUP BY node"""


def _all_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("a"), (F.col("l_partkey") + 1000000).alias("b"))


@query("bfs_neighborhood", _BFS)
@query("bfs_neighborhood_all", _BFS)
def bfs_neighborhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RT-9, JN-16 over all part-supplier edges."""
    start = spark.range(1, 2).select(F.col("id").alias("node"))
    return graph.neighbourhood(_all_edges(spark, sf_dir), start, 3).select(F.col("node").cast("long").alias("node"), "hop")


@query("graph_components")
def graph_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RT-10 over all part-supplier edges; tested against union-find."""
    return graph.components(_all_edges(spark, sf_dir))


#: Edges beside the tree of nations: a cycle of three with a tail, one of one, and a chain.
TANGLED = [(-1, -2), (-2, -3), (-3, -1), (-4, -1), (-5, -5), (-6, -7), (-7, -8)]


@query("cycle_check", f"""WITH RECURSIVE e AS (SELECT CAST(n_nationkey AS BIGINT) AS a, CAST(n_regionkey + 1000 AS BIGINT) AS b FROM nation UNION ALL SELECT * FROM (VALUES {", ".join(map(str, TANGLED))}) v(a, b)),
w AS (SELECT a AS s, b AS spot, 1 AS n FROM e UNION ALL SELECT s, b, n + 1 FROM w JOIN e ON a = spot WHERE spot <> s AND n < 100) SELECT DISTINCT s AS node FROM w WHERE spot = s""")
def cycle_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RT-11: nodes on cycles of the nation-to-region tree and of literal edges."""
    e = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("a"), (F.col("n_regionkey") + 1000).cast("long").alias("b"))
    return graph.cycles(e.union(spark.createDataFrame(TANGLED, "a long, b long")))


_DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE)))"


@query("embedding_topk", f"""WITH p AS (SELECT a.vec_id AS a, b.vec_id AS b, {_DOT.format(a='a.embedding', b='b.embedding')} / (sqrt({_DOT.format(a='a.embedding', b='a.embedding')}) * sqrt({_DOT.format(a='b.embedding', b='b.embedding')})) AS c
  FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0)
SELECT a, b, r FROM (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY round(c, 9) DESC, b) AS r FROM p) x WHERE r <= 3""")
def embedding_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-15: a stated query set (ids divisible by 100) against all vectors of its label."""
    v = table(spark, sf_dir, "embeddings")
    a = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("a"), "label", F.col("embedding").alias("x"))
    p = v.select(F.col("vec_id").alias("b"), "label", F.col("embedding").alias("y")).join(a, "label").where("a <> b")
    w = Window.partitionBy("a").orderBy(F.desc(F.round(F.col("c"), 9)), "b")
    return p.select("a", "b", retrieval.cosine(F.col("x"), F.col("y")).alias("c")).withColumn("r", F.row_number().over(w)).where("r <= 3").select("a", "b", "r")


@query("mmr_select")
def mmr_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN-7, RT-7: the 64 longest first lines of each seed (language), then the diverse choice; tested against a plain loop."""
    d = table(spark, sf_dir, "documents").select(F.col("lang").alias("seed"), F.col("doc_id").alias("id"), F.col("source").alias("cluster"), F.substring_index("text", "\n", 1).alias("text"))
    best = d.withColumn("score", F.length("text")).withColumn("r", F.row_number().over(Window.partitionBy("seed").orderBy(F.desc("score"), "id"))).where("r <= 64").drop("r")
    return retrieval.mmr(best)


@query("stream_daily_counts", "SELECT event_type, CAST(date_trunc('day', ts) AS TIMESTAMP) AS start, count(*) AS n FROM events GROUP BY 1, 2")
def stream_daily_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SM-5, SM-6: the table form of the stream, which tests hold equal."""
    return windows.window_counts(table(spark, sf_dir, "events")).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("ingest_batch", "SELECT min(doc_id) AS id, sha256(text) AS text_hash FROM documents GROUP BY sha256(text)")
def ingest_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SM-1: one micro-batch against an empty store."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.concat(F.lit("doc:"), F.col("doc_id")).alias("url"), F.sha2("text", 256).alias("text_hash"))
    return windows.ingest_new(d, d.limit(0)).select("id", "text_hash")
