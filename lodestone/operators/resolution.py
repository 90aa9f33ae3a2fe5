"""Resolution of mentions to known entities: exact names, aliases, similar vectors, and lines of descent.

A mention takes the first stage that has candidates.  A judge says of each pair whether they are the same:
one merges, several stay unresolved, none makes a new entity, for which the most similar one of its type may
be a predecessor.  Judges answer from outside, so the funnel gives pairs first and decides on verdicts.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from .retrieval import cosine
from .staging import staged

#: Similar entities of a mention, their least cosine, pivots of the index (a bound on what the driver holds), and rows of either side that meet in one task.
MOST, LEAST, PIVOTS, TILE = 3, 0.80, 64, 4096
#: Cosines closer than this are left to the exact expression.
CLOSE = 1e-7
# Relations of descent that a quote must prove.
DESCENT = ["historical_name_of", "successor_of", "predecessor_of"]


def _angles(pivots: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(id, angles to all pivots) of (id, vector); a zero vector has cosine 0 with all."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if n:
                x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(n, -1)
                size = np.linalg.norm(x, axis=1)
                a = np.arccos(np.clip((x / np.where(size > 0, size, 1.0)[:, None]) @ pivots.T, -1, 1))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * len(pivots)), pa.array(a.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["id", "angles"])

    return f


def _vectors(column: pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length as rows of unit length; zero vectors stay."""
    x = column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)
    size = np.linalg.norm(x, axis=1)
    return x / np.where(size > 0, size, 1.0)[:, None]


def _closest(most: int, least: float) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """mention, entity, w, v of the pairs of a tile that may be among the ``most`` closest of their mention."""

    def f(m: pa.Table, e: pa.Table) -> pa.Table:
        rows, cols = [np.empty(0, int)], [np.empty(0, int)]
        if m.num_rows and e.num_rows:
            a, b = _vectors(m["w"]), _vectors(e["v"])
            for at in range(0, len(a), 256):
                c = a[at:at + 256] @ b.T
                bound = np.partition(c, -most, axis=1)[:, -most] if c.shape[1] > most else np.full(len(c), least)
                i, j = np.nonzero(c >= np.maximum(bound, least)[:, None] - CLOSE)
                rows.append(i + at)
                cols.append(j)
        i, j = pa.array(np.concatenate(rows)), pa.array(np.concatenate(cols))
        return pa.table({"mention": m["mention"].take(i), "entity": e["entity"].take(j), "w": m["w"].take(i), "v": e["v"].take(j)})

    return f


def similar(mentions: DataFrame, entities: DataFrame, most: int = MOST, least: float = LEAST) -> DataFrame:
    """mention, entity, score: of each mention(mention, type, vector) the ``most`` entities(entity, type, vector) of its
    type with the greatest cosine, ``least`` at least; the lesser id of equals.  Exact.

    Entities are kept in blocks by their nearest pivot.  Angles obey the triangle inequality, so a block whose angles
    to the pivot are all further from the mention's than the angle of ``least`` has no answer, nor has an entity in
    the block.  What is left is compared tile by tile: at most about ``TILE`` mentions with as many entities of a block, as a
    product of matrices whose best pairs are scored exactly.  Of equal vectors of a type the ``most`` least ids are enough.
    Null vectors and types, and vectors with null components, have no similar ones."""
    spark = mentions.sparkSession
    whole = F.expr("vector IS NOT NULL AND type IS NOT NULL AND size(vector) > 0 AND NOT exists(vector, x -> x IS NULL)")
    m, e = mentions.where(whole), entities.where(whole)
    same = Window.partitionBy("type", "vector").orderBy("entity")
    e = staged(e.select("entity", "type", F.col("vector").cast("array<double>").alias("vector")).withColumn("nth", F.row_number().over(same)).where(F.col("nth") <= most).drop("nth"), "entities")
    first = e.orderBy(F.xxhash64("entity"), "entity").limit(min(PIVOTS, 1 + e.count() // TILE)).collect()
    if not first:
        return spark.createDataFrame([], "mention long, entity long, score double")
    p = np.array([r["vector"] for r in first], float)
    p = p / np.maximum(np.linalg.norm(p, axis=1), 1e-300)[:, None]
    reach = math.acos(least) + 1e-9

    def angled(rows: DataFrame, key: str) -> DataFrame:
        return rows.select(F.col(key).cast("long"), F.col("vector").cast("array<double>")).mapInArrow(_angles(p), "id long, angles array<double>").withColumnRenamed("id", f"_{key}")

    block = F.array_position("angles", F.array_min("angles")).cast("int") - 1
    placed = staged(e.join(angled(e, "entity"), F.col("entity") == F.col("_entity")).select("entity", "type", F.col("vector").alias("v"), block.alias("block"), F.array_min("angles").alias("angle")), "entity-blocks")
    tiles = lambda n: F.ceil(F.col(n) / TILE).cast("int")
    blocks = placed.groupBy("type", "block").agg(F.min("angle").alias("lo"), F.max("angle").alias("hi"), F.count("*").alias("held"))
    many = m.groupBy("type").agg(F.count("*").alias("asking"))
    blocks = staged(blocks.join(many, "type").select("type", "block", "lo", "hi", tiles("held").alias("slices"), tiles("asking").alias("parts")), "blocks")
    asked = m.join(angled(m, "mention"), F.col("mention") == F.col("_mention")).select("mention", "type", F.col("vector").cast("array<double>").alias("w"), "angles").join(F.broadcast(blocks), "type")
    asked = asked.withColumn("own", F.get("angles", F.col("block"))).where((F.col("own") <= F.col("hi") + reach) & (F.col("own") >= F.col("lo") - reach))
    tile = ["type", "block", "slice", "part"]
    asked = asked.select(F.col("mention").cast("long").alias("mention"), "w", "type", "block", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), F.pmod(F.xxhash64("mention"), "parts").cast("int").alias("part"))
    held = placed.join(F.broadcast(blocks), ["type", "block"]).select(F.col("entity").cast("long").alias("entity"), "v", "type", "block", F.pmod(F.xxhash64("entity"), "slices").cast("int").alias("slice"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    kept = asked.groupBy(*tile).cogroup(held.groupBy(*tile)).applyInArrow(_closest(most, least), "mention long, entity long, w array<double>, v array<double>")
    pairs = kept.select("mention", "entity", cosine(F.col("w"), F.col("v")).alias("score")).where(F.col("score") >= least)
    best = Window.partitionBy("mention").orderBy(F.desc(F.round("score", 9)), "entity")
    return pairs.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= most).select("mention", "entity", "score")


def folded(name: Column) -> Column:
    return F.lower(F.trim(name))


def funnel(mentions: DataFrame, entities: DataFrame, aliases: DataFrame, near: DataFrame) -> DataFrame:
    """mention, entity, stage, score: the pairs that a judge must answer.  ``near`` are ``similar``'s rows."""
    m = mentions.select("mention", "type", folded(F.col("name")).alias("n"))
    e = entities.select("entity", "type", folded(F.col("name")).alias("n"))
    exact = m.join(e, ["type", "n"]).select("mention", "entity", F.lit("exact").alias("stage"), F.lit(1.0).alias("score"))
    named = aliases.select(F.col("entity"), folded(F.col("alias")).alias("n")).join(e.select("entity", "type"), "entity")
    alias = m.join(named, ["type", "n"]).groupBy("mention").agg(F.min("entity").alias("entity")).select("mention", "entity", F.lit("alias").alias("stage"), F.lit(0.95).alias("score"))
    alias = alias.join(exact.select("mention"), "mention", "left_anti")
    vector = near.select("mention", "entity", F.lit("embedding").alias("stage"), "score")
    vector = vector.join(exact.select("mention").union(alias.select("mention")), "mention", "left_anti")
    return exact.unionByName(alias).unionByName(vector)


def decide(mentions: DataFrame, pairs: DataFrame, verdicts: DataFrame, near: DataFrame, relations: DataFrame, descending: list) -> DataFrame:
    """mention, stage, status, entity, relation, related, proven, confidence.

    ``verdicts`` (mention, entity, verdict); a missing one isn't ``same``.  Status: MERGED into the one entity that is the same,
    UNRESOLVED where several are, else NEW (in the surveyed code a plain new entity fell through to unresolved; that isn't kept).
    New entities of the ``descending`` types with a similar one get the judge's relation (mention, entity, relation, quote):
    one of ``DESCENT`` counts as proven where its quote binds in the mention's text; other answers are NO_RELATION or UNRESOLVED."""
    judged = pairs.join(verdicts, ["mention", "entity"], "left")
    same = F.col("verdict") == "same"
    found = judged.groupBy("mention").agg(F.first("stage").alias("stage"), F.count_if(F.coalesce(same, F.lit(False))).alias("hits"), F.min(F.when(same, F.col("entity"))).alias("hit"))
    closest = near.groupBy("mention").agg(F.min_by("entity", F.struct(-F.round("score", 9), F.col("entity"))).alias("related"))
    answer = relations.select("mention", F.col("entity").alias("related"), F.when(F.col("relation").isin([*DESCENT, "NO_RELATION"]), F.col("relation")).otherwise("UNRESOLVED").alias("relation"), "quote")
    rows = mentions.select("mention", "type", "text").join(found, "mention", "left").join(closest, "mention", "left").join(answer, ["mention", "related"], "left")
    status = F.when(F.col("hits") == 1, "MERGED").when(F.col("hits") > 1, "UNRESOLVED").otherwise("NEW")
    descends = (F.col("status") == "NEW") & F.col("stage").isNotNull() & F.col("type").isin(descending) & F.col("related").isNotNull()
    rows = rows.withColumn("status", status).withColumn("relation", F.when(descends, F.coalesce("relation", F.lit("UNRESOLVED"))))
    proven = F.col("relation").isin(DESCENT) & text.bind(F.col("quote"), F.col("text")).isin("EXACT", "NORMALIZED")
    return rows.withColumn("proven", F.when(F.col("relation").isNotNull(), proven)).select(
        "mention", F.coalesce("stage", F.lit("no-match")).alias("stage"), "status", F.when(F.col("hits") == 1, F.col("hit")).alias("entity"), "relation", F.when(F.col("relation").isNotNull(), F.col("related")).alias("related"), "proven",
        F.when(F.col("relation").isin(DESCENT), F.when(F.col("proven"), 0.6).otherwise(0.35)).when(F.col("relation").isNotNull(), 0.2).alias("confidence"))
