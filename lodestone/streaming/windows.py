"""Streaming forms: event-time counts with a watermark, and two-key ingest in micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def window_counts(events: DataFrame, width: str = "1 day", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """event_type, window start and count; works on streams (append after the watermark) and tables alike."""
    ts = F.col("ts").cast("timestamp")
    rows = events.select(ts.alias("ts"), "event_type")
    if rows.isStreaming:
        rows = rows.withWatermark("ts", late)
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return rows.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n")).select("event_type", F.col("w.start").alias("start"), "n")


def session_counts(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """user_id, session start and its events."""
    rows = events.select(F.col("ts").cast("timestamp").alias("ts"), "user_id")
    if rows.isStreaming:
        rows = rows.withWatermark("ts", late)
    return rows.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def ingest_new(batch: DataFrame, known: DataFrame) -> DataFrame:
    """Rows of a micro-batch (id, url, text_hash) that neither key knows, the least id of equals: for foreachBatch."""
    fresh = batch.join(known.select("text_hash").distinct(), "text_hash", "left_anti").join(known.select("url").distinct(), "url", "left_anti")
    by_text = fresh.groupBy("text_hash").agg(F.min(F.struct("id", "url")).alias("r")).select("text_hash", "r.id", "r.url")
    return by_text.groupBy("url").agg(F.min(F.struct("id", "text_hash")).alias("r")).select("r.id", "url", "r.text_hash")
