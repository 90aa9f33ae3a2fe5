"""Vector and ranking operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; a zero norm counts as 1."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = lambda x: F.when(dot(x, x) == 0, 1.0).otherwise(F.sqrt(dot(x, x)))
    return dot(a, b) / (norm(a) * norm(b))


def trigrams(text: Column) -> Column:
    """64-bit hashes of the distinct trigrams of the text without white space; a shorter text is its own."""
    def of(c: Column) -> Column:
        return F.when(F.size(c) >= 3, F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(c) - 3), lambda i: F.xxhash64(F.concat(*(F.get(c, i + j) for j in range(3))))))).otherwise(F.array(F.xxhash64(F.array_join(c, ""))))

    # the characters are bound as a lambda's variable, so they are made once a text
    return F.get(F.transform(F.array(F.split(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", ""), "")), of), F.lit(0))


def mmr(rows: DataFrame, most: int = 8, similar: float = 0.72, refill: int = 6) -> DataFrame:
    """seed, rank, id: a diverse choice within seed(seed, id, cluster, score, text) groups of bounded size, by falling score.

    A row is passed over if its cluster has max(3, most // 4) chosen ones, or if its trigrams have a
    Jaccard similarity above ``similar`` with a chosen row's; the last two places don't ask for that.
    If fewer than min(most, refill) are chosen, the best rows fill up.  Ties go to the least id.
    Callers rank rows first and pass 64 a seed at most; each seed's rows are folded as one array."""
    item = F.struct((-F.col("score")).alias("below"), F.col("id"), F.col("cluster"), trigrams(F.col("text")).alias("said"))
    groups = rows.groupBy("seed").agg(F.array_sort(F.collect_list(item)).alias("g"))

    def near(i: Column, j: Column) -> Column:
        a, b = F.get("g", i)["said"], F.get("g", j)["said"]
        m, n = F.size(a), F.size(b)
        common = F.size(F.array_intersect(a, b))
        return (F.least(m, n) / F.greatest(m, n) > similar) & (common / (m + n - common) > similar)

    def step(chosen: Column, i: Column) -> Column:
        same = F.size(F.filter(chosen, lambda j: F.get("g", j)["cluster"].eqNullSafe(F.get("g", i)["cluster"])))
        fits = (F.size(chosen) < most) & (same < max(3, most // 4)) & ((F.size(chosen) >= most - 2) | ~F.exists(chosen, lambda j: near(i, j)))
        return F.when(fits, F.array_append(chosen, i)).otherwise(chosen)

    chosen = F.aggregate(F.sequence(F.lit(0), F.size("g") - 1), F.array().cast("array<int>"), step)
    best = F.sequence(F.lit(0), F.least(F.lit(most), F.size("g")) - 1)
    picked = groups.withColumn("chosen", chosen)
    picked = picked.withColumn("chosen", F.when(F.size("chosen") < min(most, refill), F.slice(F.array_sort(F.array_union("chosen", best)), 1, most)).otherwise(F.col("chosen")))
    return picked.select("seed", F.posexplode(F.transform("chosen", lambda i: F.get("g", i)["id"])).alias("rank", "id"))
