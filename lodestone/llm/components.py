"""Connected components by alternating large-star and small-star steps.

Each step keeps the graph's components and is a few grouped minima and equi-joins,
so nothing of a component is gathered in one task; the number of rounds grows with
the logarithm of the largest component.  Every round is a written table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stage import staged


#: Keys of more rows are joined by a broadcast; there are ``HOT_KEYS`` of them at most.
HOT_ROWS = 1024
HOT_KEYS = 100_000


def with_few(rows: DataFrame, few: DataFrame, key: str, n: int) -> DataFrame:
    """The n rows joined with few(key, d, further columns), where d counts a key's rows.

    Rows of keys of many rows stay where they are, so no task gets them all."""
    if n <= HOT_ROWS:
        return rows.join(few, key)
    most = max(HOT_ROWS, n // HOT_KEYS)
    hot = staged(few.where(F.col("d") > most), "hot")
    if not hot.limit(1).count():
        return rows.join(few, key)
    cold = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(few.where(F.col("d") <= most), key)
    return cold.unionByName(rows.join(F.broadcast(hot), key))


def _large_star(e: DataFrame, n_edges: int) -> DataFrame:
    both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("d"))
    return with_few(both, least, "u", 2 * n_edges).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(e: DataFrame, n_edges: int) -> DataFrame:
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("d"))
    near = with_few(down, least, "u", n_edges).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return near.union(least.select("u", F.col("m").alias("v")))


def _mark(e: DataFrame) -> tuple:
    r = e.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
    return tuple(r)


def connected_components(edges: DataFrame) -> DataFrame:
    """edges: u, v long, any order, repeats and loops allowed; nulls are no edges.

    Returns node, root: root is the smallest node of its component; nodes without
    an edge to another node are absent; without edges the result is empty.
    """
    e = staged(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = _mark(e)
    while before[0]:
        large = _large_star(e, before[0]).where("u <> v").distinct()
        if before[0] > HOT_ROWS:
            large = staged(large, "large")
        e = staged(_small_star(large, before[0]).where("u <> v").distinct(), "stars")
        after = _mark(e)
        if after == before:
            break
        before = after
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
