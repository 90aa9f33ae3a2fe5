"""Verification of synthesised structures against the quotes they cite."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The fields a structure of each kind must support, and those without which it stays a candidate.
REQUIRED = {
    "PROCESS": ["time", "origin", "destination", "actors", "mechanism", "outcomes"],
    "TRADITION": ["origin_time_place", "core_practices", "carriers", "development"],
    "FLOW": ["origin", "destination", "content"],
}
KEY = {"PROCESS": ["time"], "TRADITION": ["core_practices"], "FLOW": ["origin", "destination", "content"]}
#: Lists whose entries count together: the kind they belong to and the valid entries they need.
LISTS = {"stages": ("PROCESS", 2), "regional_variants": ("TRADITION", 1)}
COVERAGE = 0.85
RESOURCES = 2


def verify(objects: DataFrame, items: DataFrame, bundle: DataFrame) -> DataFrame:
    """object, kind, supported, coverage, resources, decision of each of objects(object, kind).

    items(object, item, field, value, quotes): an object's fields and entries of its lists;
    bundle(object, n, resource): quote Qn of the object's bundle.  A field is supported by a value and a
    valid quote; a list by enough entries of that sort.  Quotes that no bundle has count for nothing.
    """
    spark = objects.sparkSession
    rules = spark.createDataFrame([(k, f, f in KEY[k]) for k, fs in REQUIRED.items() for f in fs], "kind string, field string, key boolean")
    lists = spark.createDataFrame([(f, k, n) for f, (k, n) in LISTS.items()], "field string, of string, least int")
    sizes = spark.createDataFrame([(k, len(v), len(KEY[k])) for k, v in REQUIRED.items()], "kind string, required int, keys int")
    cited = items.select("object", "item", F.explode("quotes").alias("quote")).join(bundle.select("object", F.concat(F.lit("Q"), "n").alias("quote"), "resource"), ["object", "quote"])
    valid = cited.groupBy("object", "item").agg(F.collect_set("resource").alias("resources"))
    every = items.join(valid, ["object", "item"], "left").join(objects, "object").join(F.broadcast(lists), "field", "left")
    every = every.withColumn("ok", (F.trim(F.coalesce("value", F.lit(""))) != "") & F.col("resources").isNotNull())
    fields = every.where("of is null").select("object", "kind", "field", "ok", "resources")
    entries = every.where("of = kind and ok").groupBy("object", "kind", "field").agg(F.count("*").alias("n"), F.first("least").alias("least"), F.array_distinct(F.flatten(F.collect_list("resources"))).alias("resources")).where("n >= least")
    known = fields.join(F.broadcast(rules), ["kind", "field"], "left")
    support = known.where("ok and key is not null").select("object", "field", "key").distinct().union(entries.select("object", "field", F.lit(False)))
    count = support.groupBy("object").agg(F.count("*").alias("supported"), F.count_if("key").alias("keys_held"))
    sources = fields.select("object", F.explode("resources").alias("r")).union(entries.select("object", F.explode("resources"))).groupBy("object").agg(F.countDistinct("r").alias("resources"))
    out = objects.join(F.broadcast(sizes), "kind").join(count, "object", "left").join(sources, "object", "left").na.fill(0, ["supported", "keys_held", "resources"])
    coverage = F.col("supported") / F.col("required")
    decision = (
        F.when((F.col("kind") == "FLOW") & (F.col("keys_held") < F.col("keys")), "REJECT").when(F.col("keys_held") < F.col("keys"), "CANDIDATE")
        .when((F.col("resources") >= RESOURCES) & (coverage >= COVERAGE), "ADMITTED").when(F.col("resources") >= 1, "SUPPORTED").otherwise("CANDIDATE")
    )
    return out.select("object", "kind", "supported", F.round(coverage, 3).alias("coverage"), "resources", decision.alias("decision"))
