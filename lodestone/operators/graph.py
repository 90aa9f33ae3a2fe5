"""Graph operators as bounded loops of joins over edges(a, b)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import released, staged


def neighbourhood(edges: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """node, hop of all nodes within ``depth`` hops of start(node), by the least hop.

    Edges count both ways.  Every hop is one join of the frontier with the edges and an
    anti-join with what is known; null ends are no edges.  Only what was reached is made distinct,
    so repeated edges may come in and no table of all edges is held.
    """
    both = edges.select("a", "b").union(edges.select("b", "a")).where("a is not null and b is not null")
    known = start.select("node", F.lit(0).alias("hop")).distinct()
    frontier = known
    for hop in range(1, depth + 1):
        reached = frontier.join(both, frontier.node == both.a).select(F.col("b").alias("node")).distinct()
        frontier = staged(reached.join(known.select("node"), "node", "left_anti").withColumn("hop", F.lit(hop)), "frontier")
        known = known.union(frontier)
    return known


def components(edges: DataFrame) -> DataFrame:
    """node, root (its component's least node) by minimum labels with a jump to the label's label.

    Rounds go on until nothing changes; each is a staged table, and doubles the distance that a label has come.
    Repeated edges may come in; no table of all edges is held."""
    both = staged(edges.select("a", "b").union(edges.select("b", "a")).where("a is not null and b is not null"), "edges")
    label = staged(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("root")), "labels")
    while True:
        near = both.join(label.select("node", "root"), both.b == F.col("node")).groupBy("a").agg(F.min("root").alias("m"))
        new = label.select("node", "root").join(near, F.col("node") == near.a, "left").select("node", F.least("root", F.coalesce("m", "root")).alias("root"), F.col("root").alias("old"))
        jump = new.select(F.col("node").alias("at"), F.col("root").alias("next"))
        new = staged(new.join(jump, new.root == jump["at"], "left").select("node", F.least("root", F.coalesce("next", "root")).alias("root"), "old"), "labels")
        released(label)
        label = new
        if new.where("root <> old").isEmpty():
            return label.select("node", "root")


def cycles(parents: DataFrame) -> DataFrame:
    """node of every node on a cycle of child-to-parent edges(a, b), each child with one parent.

    Pointers double, a staged table a round, until they pass as many steps as there are nodes: what is still inside is
    on, or leads into, a cycle; nodes that such pointers end at are on one."""
    hop = staged(parents.select("a", "b").where("a is not null and b is not null"), "parents")
    n, step = hop.count(), 1
    while step <= n:
        nxt = hop.select(F.col("a").alias("b"), F.col("b").alias("c"))
        new = staged(hop.join(nxt, "b").select("a", F.col("c").alias("b")), "parents")
        released(hop)
        hop, step = new, 2 * step
        if hop.isEmpty():
            break
    return hop.select(F.col("b").alias("node")).distinct()
