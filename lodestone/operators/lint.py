"""Checks of a vocabulary of trees and typed relations, and of chains from knowledge to its source."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import graph

# Types of units, relations between them, and those that carry water on.
TYPES = ["Basin", "MainStem", "RiverSection", "Tributary", "Lake", "Wetland", "Delta", "Plain", "MountainRegion", "Valley", "SubBasin", "WaterTransportCorridor"]
RELATIONS = ["tributary_of", "flows_into", "part_of_basin", "upstream_of", "downstream_of", "hydrologically_connects", "passes_through", "adjacent_basin"]
DOWNSTREAM = ["tributary_of", "flows_into"]


def findings(nodes: DataFrame, relations: DataFrame, banned: list[str], narrative: str) -> DataFrame:
    """code, place, subject of everything wrong in nodes(kind, id, name, parent, description, type) and relations(a, relation, b), which
    name nodes by id.

    duplicate_id: an id with several nodes.  duplicate_name: a name of a kind with several ids, and a relation told twice.
    missing_metadata: no name, description or type.  illegal_child_type: a type or relation that isn't registered, a banned name.
    narrative_leak: a name that tells a story.  type_collision: a name of several kinds.  dangling_parent: a parent, or an end of a
    relation, that is no node.  cycle: a node on a cycle of parents.  hydro_topology: a relation with itself, a node on a cycle of
    downstream relations (of several from one node the least end counts), and, among nodes that relations could name, none that does
    (kinds without any relation aren't asked).  untyped_relation: a relation without a name.  self_parent: a node that is its own parent."""
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    ids = nodes.where("id IS NOT NULL").select("id").distinct()
    ends = relations.select(F.col("a").alias("id")).union(relations.select(F.col("b"))).distinct()

    def rows(df: DataFrame, code: str, place: str | Column, subject: str | Column) -> DataFrame:
        place = F.lit(place) if isinstance(place, str) else place
        return df.select(F.lit(code).alias("code"), place.alias("place"), (F.col(subject) if isinstance(subject, str) else subject).cast("string").alias("subject"))

    told = F.concat_ws(" ", F.coalesce("a", F.lit("?")), F.coalesce("relation", F.lit("?")), F.coalesce("b", F.lit("?")))
    parents = nodes.where("parent IS NOT NULL AND parent <> id").join(ids.withColumnRenamed("id", "_p"), F.col("parent") == F.col("_p"), "left_semi").groupBy(F.col("id").alias("a")).agg(F.min("parent").alias("b"))
    down = relations.where(F.col("relation").isin(DOWNSTREAM) & (F.col("a") != F.col("b"))).groupBy("a").agg(F.min("b").alias("b"))
    kinds = nodes.join(ends, "id", "left_semi").select("kind").distinct()
    found = [
        rows(nodes.groupBy("id").count().where("count > 1"), "duplicate_id", "nodes", "id"),
        rows(nodes.where("name IS NOT NULL").groupBy("kind", "name").agg(F.countDistinct("id").alias("n")).where("n > 1"), "duplicate_name", F.col("kind"), "name"),
        rows(relations.groupBy("a", "relation", "b").count().where("count > 1"), "duplicate_name", "relations", told),
        rows(nodes.where(blank("name") | blank("description") | blank("type")), "missing_metadata", F.col("kind"), "id"),
        rows(nodes.where(~blank("type") & ~F.col("type").isin(TYPES) | F.coalesce(F.col("name").isin(banned), F.lit(False))), "illegal_child_type", F.col("kind"), "id"),
        rows(relations.where(~blank("relation") & ~F.col("relation").isin(RELATIONS)), "illegal_child_type", "relations", told),
        rows(nodes.where(F.col("name").rlike(narrative)), "narrative_leak", F.col("kind"), "id"),
        rows(nodes.where("name IS NOT NULL").groupBy("name").agg(F.countDistinct("kind").alias("n")).where("n > 1"), "type_collision", "nodes", "name"),
        rows(nodes.where("parent IS NOT NULL").join(ids.withColumnRenamed("id", "_p"), F.col("parent") == F.col("_p"), "left_anti"), "dangling_parent", F.col("kind"), "id"),
        rows(ends.where("id IS NOT NULL").join(ids, "id", "left_anti"), "dangling_parent", "relations", "id"),
        rows(graph.cycles(parents), "cycle", "nodes", "node"),
        rows(nodes.where("parent = id"), "self_parent", F.col("kind"), "id"),
        rows(relations.where("a = b"), "hydro_topology", "self", told),
        rows(graph.cycles(down), "hydro_topology", "cycle", "node"),
        rows(nodes.join(kinds, "kind", "left_semi").join(ends, "id", "left_anti"), "hydro_topology", "untouched", "id"),
        rows(relations.where(blank("relation")), "untyped_relation", "relations", told),
    ]
    return reduce(DataFrame.unionByName, found).distinct()


def chains(nodes: DataFrame, chunks: DataFrame, docs: DataFrame, resources: DataFrame) -> DataFrame:
    """node, refs, missing_chunk, missing_doc, missing_resource, closed, reason of nodes(node, source), where a source names chunks between
    ``;`` or ``<SEP>``; chunks(chunk, doc), docs(doc, path), resources(path).

    A node is closed if one of its references leads to a resource; the reason of the others is the furthest level that one of them
    reached: no reference, no chunk, no document or no resource."""
    refs = nodes.select("node", F.explode(F.filter(F.transform(F.split(F.coalesce("source", F.lit("")), ";|<SEP>"), lambda x: F.trim(x)), lambda x: x != "")).alias("chunk"))
    led = refs.join(chunks.dropDuplicates(["chunk"]).select("chunk", "doc", F.lit(True).alias("has_chunk")), "chunk", "left").join(docs.dropDuplicates(["doc"]).select("doc", "path", F.lit(True).alias("has_doc")), "doc", "left").join(resources.select("path").distinct().withColumn("has_resource", F.lit(True)), "path", "left")
    has = {c: F.coalesce(F.col(f"has_{c}"), F.lit(False)) for c in ("chunk", "doc", "resource")}
    level = F.when(has["resource"], 4).when(has["doc"], 3).when(has["chunk"], 2).otherwise(1)
    by = led.groupBy("node").agg(
        F.count("*").alias("refs"), F.count_if(~has["chunk"]).alias("missing_chunk"), F.count_if(has["chunk"] & ~has["doc"]).alias("missing_doc"), F.count_if(has["doc"] & ~has["resource"]).alias("missing_resource"), F.max(level).alias("level"))
    zero = F.lit(0)
    out = nodes.select("node").distinct().join(by, "node", "left")
    reason = F.when(F.col("level").isNull(), "no reference").when(F.col("level") == 1, "no chunk").when(F.col("level") == 2, "no document").when(F.col("level") == 3, "no resource")
    return out.select("node", *(F.coalesce(c, zero).alias(c) for c in ("refs", "missing_chunk", "missing_doc", "missing_resource")), F.coalesce(F.col("level") == 4, F.lit(False)).alias("closed"), reason.alias("reason"))
