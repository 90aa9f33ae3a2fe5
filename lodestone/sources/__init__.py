"""Tables of a folder, and the roles they play.

Every role is a narrow projection, so column pruning and filters reach the scans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in TABLES:
        raise ValueError(f"no table {name}")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """subject, predicate, object, at, resource: one row a statement."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("subject"), F.col("l_returnflag").alias("predicate"), F.col("l_suppkey").alias("object"), F.col("l_shipdate").alias("at"), F.col("l_orderkey").alias("resource"), F.col("l_linenumber").alias("line"))


def clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """resource, cluster (null where a resource is in none), priority."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("resource"), F.col("o_custkey").alias("cluster"), F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status"))


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entity_id, name, type of customers, suppliers, parts, nations and regions."""
    def of(name: str, key: str, label: str, kind: str) -> DataFrame:
        return table(spark, sf_dir, name).select(F.concat(F.lit(f"{kind}:"), F.col(key).cast("string")).alias("entity_id"), F.col(label).alias("name"), F.lit(kind).alias("type"))

    out = of("customer", "c_custkey", "c_name", "customer")
    for x in (("supplier", "s_suppkey", "s_name", "supplier"), ("part", "p_partkey", "p_name", "part"), ("nation", "n_nationkey", "n_name", "nation"), ("region", "r_regionkey", "r_name", "region")):
        out = out.unionByName(of(*x))
    return out


ENTITIES_SQL = """(SELECT 'customer:' || c_custkey AS entity_id, c_name AS name, 'customer' AS type FROM customer UNION ALL SELECT 'supplier:' || s_suppkey, s_name, 'supplier' FROM supplier
  UNION ALL SELECT 'part:' || p_partkey, p_name, 'part' FROM part UNION ALL SELECT 'nation:' || n_nationkey, n_name, 'nation' FROM nation UNION ALL SELECT 'region:' || r_regionkey, r_name, 'region' FROM region)"""


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, role: CORE, CONTEXT or REJECT from the labels; documents without a label are rejected."""
    d = table(spark, sf_dir, "documents").select("doc_id")
    return d.join(table(spark, sf_dir, "labels"), "doc_id", "left").select("doc_id", role(F.col("quality"), F.col("toxic")).alias("role"))


def role(quality: Column, toxic: Column) -> Column:
    return F.when((quality == 1) & (toxic == 0), "CORE").when((quality == 1) & (toxic == 1), "CONTEXT").otherwise("REJECT")


ROLE_SQL = "CASE WHEN quality = 1 AND toxic = 0 THEN 'CORE' WHEN quality = 1 AND toxic = 1 THEN 'CONTEXT' ELSE 'REJECT' END"
