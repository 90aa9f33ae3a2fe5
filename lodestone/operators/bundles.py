"""Evidence bundles: passages of whole texts around terms, channels merged by what they say, a hybrid score,
a diverse choice, and numbered blocks.  Seeds are a stated, small set and are sent to all tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import gates, scoring
from .retrieval import mmr

#: Characters around a hit, of a bucket that gives one passage, passages a resource, resources a seed, normalised characters of a passage and of a quote at least.
AROUND, BUCKET, PASSAGES, RESOURCES, LEAST_PASSAGE, LEAST_QUOTE = 110, 400, 2, 14, 30, 12
#: Quotes that are scored, and characters of a numbered block.
POOL, SHOWN = 64, 420
# Words that hint at fields, and years.
HINTS = {
    "time": ["年", "世纪", "时期", "朝"], "origin": ["起源", "源于", "始于", "发源"], "destination": ["传入", "传至", "抵达", "流向"], "mechanism": ["因为", "由于", "推动", "促进"], "carriers": ["传承", "工匠", "移民", "商人"], "outcomes": ["影响", "形成", "结果"],
}
YEAR = r"(公元前?\s*[0-9]+|[0-9]{3,4})"


def passages(seeds: DataFrame, resources: DataFrame) -> DataFrame:
    """seed, resource, n, quote of seeds(seed, terms) and resources(resource, title, query, text).

    Resources whose title or query holds a term, those with the longest titles first, are read whole.  Of the hits
    of a text, in order of terms and places, the first in each bucket of ``BUCKET`` characters counts; its
    passage is what stands ``AROUND`` characters on both sides, if ``LEAST_PASSAGE`` normalised characters remain."""
    title, asked = F.lower(F.coalesce("title", F.lit(""))), F.lower(F.coalesce("query", F.lit("")))
    held = F.exists("terms", lambda t: F.contains(title, F.lower(t)) | F.contains(asked, F.lower(t)))
    best = Window.partitionBy("seed").orderBy(F.desc(F.length(F.coalesce("title", F.lit("")))), "resource")
    readable = resources.where("text <> ''").select("resource", "title", "query")
    chosen = readable.join(F.broadcast(seeds.select("seed", "terms")), held).withColumn("r", F.row_number().over(best)).where(F.col("r") <= RESOURCES).select("seed", "resource", "terms")
    texts = resources.select("resource", "text").join(F.broadcast(chosen), "resource")
    by_term = texts.select("seed", "resource", F.posexplode(F.filter("terms", lambda t: t != "")).alias("t", "term"), "text")
    pieces = by_term.select("seed", "resource", "t", "term", F.posexplode(F.split("text", F.concat(F.lit("\\Q"), F.col("term"), F.lit("\\E")), F.lit(-1))).alias("i", "piece"), F.length("text").alias("chars"))
    so_far = Window.partitionBy("seed", "resource", "t").orderBy("i")
    last = Window.partitionBy("seed", "resource", "t")
    hits = pieces.select("seed", "resource", "t", "i", F.max("i").over(last).alias("last"), F.length("term").alias("size"), (F.sum(F.length("piece")).over(so_far) + F.col("i") * F.length("term")).alias("at")).where("i < last")
    first = hits.groupBy("seed", "resource", F.floor(F.col("at") / BUCKET).alias("bucket")).agg(F.min(F.struct("t", "at", "size")).alias("h")).select("seed", "resource", "h.*")
    start, end = F.greatest(F.col("at") - AROUND, F.lit(0)), F.least(F.col("at") + F.col("size") + AROUND, F.length("text"))
    cut = F.regexp_replace(F.substr("text", (start + 1).cast("int"), (end - start).cast("int")), r"^\s+|\s+$", "")
    quoted = first.join(F.broadcast(chosen.select("resource").distinct()).join(resources.select("resource", "text"), "resource"), "resource").select("seed", "resource", "t", "at", cut.alias("quote"))
    order = Window.partitionBy("seed", "resource").orderBy("t", "at")
    kept = quoted.where(F.length(gates.norm_key(F.col("quote"))) >= LEAST_PASSAGE).withColumn("n", F.row_number().over(order))
    return kept.where(F.col("n") <= PASSAGES).select("seed", "resource", "n", "quote")


def pooled(quotes: DataFrame) -> DataFrame:
    """The first ``POOL`` different quotes of a seed, with all their channels: of quotes(seed, channel, position, place, quote, ...), where
    ``position`` orders channels and ``place`` quotes within one, equal ones (by their normal form) are the first of them."""
    others = [c for c in quotes.columns if c not in ("seed", "channel", "position", "place")]
    rows = quotes.withColumn("key", gates.norm_key(F.col("quote"))).where(F.length("key") >= LEAST_QUOTE)
    merged = rows.groupBy("seed", "key").agg(F.min(F.struct("position", "place", *others)).alias("q"), F.array_sort(F.collect_set(F.struct("position", "channel"))).alias("c"))
    rows = merged.select("seed", "key", F.transform("c", lambda x: x["channel"]).alias("channels"), "q.*")
    first = Window.partitionBy("seed").orderBy("position", "place", "key")
    return rows.withColumn("place", F.row_number().over(first)).where(F.col("place") <= POOL).drop("position")


def score(pool: DataFrame, seeds: DataFrame) -> DataFrame:
    """``pool`` with its score in ten-thousandths, from quote, authority, cluster, and semantic (a cosine, null for none known).

    A quote whose resource is in a cluster of sources counts as independent (in the surveyed code the test could never be true)."""
    rows = pool.join(F.broadcast(seeds.select("seed", "terms", "fields")), "seed")
    quote = F.coalesce("quote", F.lit(""))
    hints = F.create_map(*(x for k, v in HINTS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    fields = F.size(F.filter(F.coalesce("fields", F.array().cast("array<string>")), lambda f: F.coalesce(F.exists(F.element_at(hints, f), lambda h: F.contains(quote, h)), F.lit(False))))
    terms = F.size(F.filter("terms", lambda t: F.contains(quote, t)))
    length = F.length(gates.norm_key(quote))
    parts = (
        0.30 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("semantic", F.lit(0.5)))) + 0.20 * F.least(F.lit(1.0), 0.25 * fields + 0.15 * terms) + 0.15 * scoring.authority_weight(F.upper("authority"))
        + 0.15 * F.when(F.col("cluster").isNotNull(), 1.0).otherwise(0.55) + 0.10 * F.when(length > 220, 0.6).when(length >= 30, 1.0).otherwise(0.3) + 0.05 * F.when(quote.rlike(YEAR), 1.0).otherwise(0.4) + 0.05 * F.when(quote.rlike(gates.DISPUTE), 1.0).otherwise(0.6))
    return rows.withColumn("score", F.round(10000 * parts).cast("int")).drop("terms", "fields")


def bundle(scored: DataFrame, most: int = 40) -> DataFrame:
    """seed, id (Q0, Q1, ...), quote cut to ``SHOWN`` characters, resource, channels, score: the diverse choice of a seed's pool, numbered.
    Quotes of resources in no cluster are their resource's own cluster; ties go to the earlier place."""
    unit = F.coalesce(F.concat(F.lit("cluster "), F.col("cluster").cast("string")), F.concat(F.lit("resource "), F.col("resource").cast("string")))
    chosen = mmr(scored.select("seed", F.col("place").cast("long").alias("id"), unit.alias("cluster"), "score", F.col("quote").alias("text")), most)
    text = F.regexp_replace("quote", r"^\s+|\s+$", "")
    shown = F.when(F.length(text) > SHOWN, F.concat(F.substring(text, 1, SHOWN), F.lit("…"))).otherwise(text)
    return chosen.withColumnRenamed("id", "place").join(scored, ["seed", "place"]).select("seed", F.concat(F.lit("Q"), F.col("rank").cast("string")).alias("id"), shown.alias("quote"), "resource", "channels", "score")
