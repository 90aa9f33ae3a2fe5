"""All pairs of members of linked groups, which no task holds as a whole.

Members are put into blocks of bounded size, links meet as pairs of blocks, and these are dealt out evenly before
a pair becomes a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Members of a block, as a mean; a task holds the rows of a pair of blocks, the square of it, at once.
BLOCK = 512


def blocks(members: DataFrame, keys: list[str], member: str) -> DataFrame:
    """keys, part, parts, held: members in blocks of about ``BLOCK``."""
    counts = members.groupBy(*keys).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    dealt = members.join(counts, keys).select(*keys, F.col(member), "parts", F.pmod(F.xxhash64(member), "parts").cast("int").alias("part"))
    return dealt.groupBy(*keys, "part").agg(F.first("parts").alias("parts"), F.collect_list(member).alias("held"))


def expanded(links: DataFrame, held: DataFrame, left: dict[str, str], right: dict[str, str], same: Column) -> DataFrame:
    """a, b and the columns of ``links`` for each pair of a member of the left group and one of the right, a < b; ``left`` and
    ``right`` name the keys of ``held`` by columns of ``links``.  Where ``same`` (both are one group) each pair comes once."""
    columns, tasks = links.columns, int(links.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    x = held.select(*(F.col(k).alias(c) for c, k in left.items()), F.col("held").alias("_x"))
    y = held.select(*(F.col(k).alias(c) for c, k in right.items()), F.col("held").alias("_y"))
    met = links.withColumn("_same", same).join(x, list(left)).join(y, list(right)).select(*columns, "_same", "_x", "_y")
    rows = met.repartition(tasks).select(*columns, "_same", "_y", F.explode("_x").alias("_a")).select(*columns, "_same", "_a", F.explode("_y").alias("_b"))
    rows = rows.where("_a < _b OR (NOT _same AND _a > _b)")
    return rows.select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b"), *columns)
