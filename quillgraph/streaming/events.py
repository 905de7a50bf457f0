"""Structured Streaming forms of the event operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, ts: str = "ts", key: str = "event_type", size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events of each key and tumbling window; rows later than ``late`` are dropped."""
    counted = events.withWatermark(ts, late).groupBy(F.window(ts, size).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("w.start").alias("start"), key, "n")


def sessions(events: DataFrame, ts: str = "ts", key: str = "user_id", gap: str = "6 hours", late: str = "10 minutes") -> DataFrame:
    """Sessions of each key by a gap (an addition: Spark's session windows)."""
    met = events.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return met.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")


def first_turns(turns: DataFrame, ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """Online exact turn dedup: the first of equal normalised texts in a conversation."""
    norm = F.trim(F.regexp_replace(F.lower("text"), r"\s+", " "))
    return turns.withColumn("hash", F.sha2(norm, 256)).withWatermark(ts, late).dropDuplicatesWithinWatermark(["conv_id", "hash"]).drop("hash")


def last_operations(batch: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last operation of each key in a micro-batch, for index maintenance in ``foreachBatch``."""
    others = [c for c in batch.columns if c not in keys]
    best = batch.groupBy(*keys).agg(F.max_by(F.struct(*others), F.col(order)).alias("r"))
    return best.select(*keys, *[F.col(f"r.{c}").alias(c) for c in others])


def paired_calls(started: DataFrame, completed: DataFrame, key: str = "call_id", within: str = "1 hour") -> DataFrame:
    """Starts joined with their completions within a time, as a stream-stream join."""
    s = started.withWatermark("started_at", within)
    c = completed.withColumnRenamed(key, "done_id").withWatermark("completed_at", within)
    on = (F.col(key) == F.col("done_id")) & (F.col("completed_at") >= F.col("started_at")) & (F.col("completed_at") <= F.col("started_at") + F.expr(f"interval {within}"))
    return s.join(c, on).drop("done_id")
