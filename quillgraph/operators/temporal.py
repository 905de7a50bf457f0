"""As-of predicates, timelines, ledgers, sessions and event statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def valid_at(valid_from: Column, valid_until: Column, at: str | Column) -> Column:
    """Both bounds count; a missing bound is open."""
    t = F.to_timestamp(F.lit(at)) if isinstance(at, str) else at
    return (valid_from.isNull() | (valid_from <= t)) & (valid_until.isNull() | (valid_until >= t))


def asof_many(points: DataFrame, intervals: DataFrame, key: str) -> DataFrame:
    """For each (key, t) the intervals of the key that hold at t."""
    return points.join(intervals, key).filter(valid_at(F.col("valid_from"), F.col("valid_until"), F.col("t")))


def timeline(relations: DataFrame, keys: list[str]) -> DataFrame:
    """``pos`` of each relation in its key's timeline; open starts last."""
    w = Window.partitionBy(*keys).orderBy(F.asc_nulls_last("valid_from"), "dst", "line")
    return relations.withColumn("pos", F.row_number().over(w))


def regressions(ledger: DataFrame, keys: list[str], field: str, *order: str) -> DataFrame:
    """Rows whose value was left earlier and comes back: it equals an earlier value of the key, but not the last one."""
    w = Window.partitionBy(*keys).orderBy(*order)
    placed = ledger.withColumn("place", F.row_number().over(w)).withColumn("last_value", F.lag(field).over(w))
    first = placed.withColumn("first", F.min("place").over(Window.partitionBy(*keys, field)))
    return first.filter((F.col("first") < F.col("place")) & (F.col(field) != F.col("last_value"))).drop("place", "first", "last_value")


def sessions(events: DataFrame, key: str, ts: str, gap: str) -> DataFrame:
    """Adds ``session_no`` to events: a new session after a gap of more than ``gap``."""
    w = Window.partitionBy(key).orderBy(ts, "event_id")
    new = F.coalesce(F.col(ts) > F.lag(ts).over(w) + F.expr(f"interval {gap}"), F.lit(True))
    return events.withColumn("new", new.cast("int")).withColumn("session_no", F.sum("new").over(w).cast("bigint")).drop("new")


def rolling_success(calls: DataFrame, key: str, ok: Column, last: int) -> DataFrame:
    """Success rate of each key over its last calls."""
    w = Window.partitionBy(key).orderBy(F.desc("ts"), F.desc("event_id"))
    recent = calls.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= last)
    return recent.groupBy(key).agg(F.count(F.lit(1)).alias("calls"), F.round(F.avg(ok.cast("double")), 6).alias("success_rate"))
