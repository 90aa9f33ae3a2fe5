"""GraphML files, read by Spark's XML source: nodes and edges with the attributes that the file declares."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_KEY = "_id string, _for string, `_attr.name` string, `_attr.type` string"
_DATA = "data array<struct<_VALUE string, _key string>>"
#: Declared types and what their texts are read as; texts that aren't such become null.
TYPES = {"int": "int", "long": "bigint", "float": "double", "double": "double", "boolean": "boolean"}


def keys(spark: SparkSession, path: str) -> list[tuple[str, str, str, str]]:
    """(id, node or edge, name, type) of the declared attributes: a file's head, a handful of rows."""
    rows = spark.read.format("xml").option("rowTag", "key").schema(_KEY).load(path).distinct().collect()
    return sorted((r["_id"], r["_for"], r["_attr.name"], r["_attr.type"]) for r in rows if r["_id"] and r["_attr.name"])


def _elements(spark: SparkSession, path: str, tag: str, own: dict[str, str]) -> DataFrame:
    schema = ", ".join([*(f"{c} string" for c in own), _DATA])
    rows = spark.read.format("xml").option("rowTag", tag).option("ignoreSurroundingSpaces", "false").schema(schema).load(path)
    said = F.map_from_entries(F.transform(F.filter(F.coalesce("data", F.array().cast("array<struct<_VALUE:string,_key:string>>")), lambda d: d["_key"].isNotNull()), lambda d: F.struct(d["_key"], d["_VALUE"])))
    named = {}
    for key, of, name, kind in keys(spark, path):
        if of in (tag, "all"):
            named.setdefault(name, []).append(F.element_at("_said", key).try_cast(TYPES.get(kind, "string")))
    rows = rows.select(*(F.col(c).alias(n) for c, n in own.items()), said.alias("_said"))
    return rows.select(*own.values(), *(F.coalesce(*v).alias(n) for n, v in named.items() if n not in own.values()))


def nodes(spark: SparkSession, path: str) -> DataFrame:
    """id and the declared node attributes of each node; missing and empty ones are null."""
    return _elements(spark, path, "node", {"_id": "id"})


def edges(spark: SparkSession, path: str) -> DataFrame:
    """source, target and the declared edge attributes of each edge."""
    return _elements(spark, path, "edge", {"_source": "source", "_target": "target"})
