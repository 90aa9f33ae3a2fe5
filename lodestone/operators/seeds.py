"""A controlled vocabulary applied to what is stored: renames, upserts in order of levels, deletes of what is stale."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .staging import staged


def manifest(seed: DataFrame) -> str:
    """SHA-256 of a seed whatever its order of rows and columns: of rows as canonical JSON, summed up by the
    first two digits of their hashes, then together."""
    row = F.to_json(F.struct(*sorted(seed.columns)), {"ignoreNullFields": "false"})
    hashes = seed.select(F.sha2(row, 256).alias("h"))
    parts = hashes.groupBy(F.substring("h", 1, 2).alias("p")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("h"))
    return parts.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "h"))), lambda x: x["h"]), ""), 256)).first()[0]


def levels(nodes: DataFrame) -> DataFrame:
    """name, parent, level of nodes(name, parent): 0 without a parent, else one below the parent's; null for nodes on or under a cycle,
    or under a parent that isn't there.  One join a level."""
    waiting = staged(nodes.select("name", "parent"), "waiting")
    last = staged(waiting.where("parent IS NULL").select("name", "parent", F.lit(0).alias("level")), "level")
    found, level = last, 0
    while not last.isEmpty():
        level += 1
        last = staged(waiting.join(last.select(F.col("name").alias("_p")).distinct(), F.col("parent") == F.col("_p"), "left_semi").select("name", "parent", F.lit(level).alias("level")), "level")
        found = found.unionByName(last)
    return found.unionByName(waiting.join(found.select("name").distinct(), "name", "left_anti").select("name", "parent", F.lit(None).cast("int").alias("level")))


def plan(seed: DataFrame, actual: DataFrame, renames: DataFrame) -> DataFrame:
    """name, action, level, was: what applying seed(name, parent, description) to actual(name, parent, description) does, with renames(old, new).

    A stored old name becomes the new one, unless that is stored already; then the old row goes.  After that a name is inserted, updated where
    parent or description differ, kept, or deleted where the seed has it no more.  Parents come before children: rows are applied in order of
    ``level``; those without one are REFUSED and nothing stored of them changes."""
    known = actual.select("name").distinct()
    move = renames.join(known.withColumnRenamed("name", "new"), "new", "left_anti").join(known.withColumnRenamed("name", "old"), "old", "left_semi").groupBy("old").agg(F.min("new").alias("new"))
    move = move.groupBy("new").agg(F.min("old").alias("old"))
    stored = actual.join(move, F.col("name") == F.col("old"), "left").select(F.coalesce("new", "name").alias("name"), F.col("old").alias("was"), "parent", "description")
    parents = move.select(F.col("old").alias("_o"), F.col("new").alias("_n"))
    stored = stored.join(parents, F.col("parent") == F.col("_o"), "left").select("name", "was", F.coalesce("_n", "parent").alias("parent"), "description", F.lit(True).alias("stored"))
    wanted = seed.join(levels(seed).select(F.col("name").alias("_name"), "level"), F.col("name") == F.col("_name")).select(F.col("name").alias("want"), F.col("parent").alias("want_parent"), F.col("description").alias("want_description"), "level")
    both = wanted.join(stored, F.col("want") == F.col("name"), "full")
    same = F.col("want_parent").eqNullSafe(F.col("parent")) & F.col("want_description").eqNullSafe(F.col("description"))
    action = F.when(F.col("want").isNull(), "DELETE").when(F.col("level").isNull(), "REFUSE").when(F.col("stored").isNull(), "INSERT").when(~same, "UPDATE").when(F.col("was").isNotNull(), "RENAME").otherwise("KEEP")
    return both.select(F.coalesce("want", "name").alias("name"), action.alias("action"), "level", "was")


def applied(seed: DataFrame, actual: DataFrame, actions: DataFrame) -> DataFrame:
    """The rows after a plan: the seed's, but what was stored under a refused name."""
    done = seed.join(actions.where("action IN ('INSERT', 'UPDATE', 'RENAME', 'KEEP')").select("name"), "name", "left_semi")
    return done.unionByName(actual.join(actions.where("action = 'REFUSE'").select("name"), "name", "left_semi").select(*done.columns))


def current(spark: SparkSession, store: str) -> DataFrame | None:
    """The table that the store's pointer names; None where there is none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{store}/CURRENT")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.parquet(f"{store}/{spark.read.text(f'{store}/CURRENT').first()[0]}")


def swap(rows: DataFrame, store: str) -> str:
    """Write rows beside what is stored, then point to them by one rename: readers see the old table or the new one, whole."""
    spark = rows.sparkSession
    version = f"v-{uuid.uuid4().hex}"
    rows.write.parquet(f"{store}/{version}")
    spark.createDataFrame([(version,)], "value string").coalesce(1).write.text(f"{store}/next-{version}")
    jvm = spark._jvm.org.apache.hadoop.fs
    fs = jvm.Path(store).getFileSystem(spark._jsc.hadoopConfiguration())
    part = next(x.getPath() for x in fs.listStatus(jvm.Path(f"{store}/next-{version}")) if x.getPath().getName().startswith("part-") and x.getLen())
    pointer, old = jvm.Path(f"{store}/CURRENT"), jvm.Path(f"{store}/PREVIOUS")
    if fs.exists(pointer):
        fs.delete(old, False)
        fs.rename(pointer, old)
    fs.rename(part, pointer)
    fs.delete(jvm.Path(f"{store}/next-{version}"), True)
    return version


def apply(seed: DataFrame, store: str, renames: DataFrame, dry_run: bool = False) -> DataFrame:
    """The plan; without ``dry_run`` it is carried out."""
    actual = current(seed.sparkSession, store)
    actual = seed.limit(0) if actual is None else actual.select(*seed.columns)
    actions = staged(plan(seed, actual, renames), "seed-plan")
    if not dry_run:
        swap(applied(seed, actual, actions), store)
    return actions


