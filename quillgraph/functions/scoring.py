"""Scoring formulas as columns; every clock is an argument."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hours_since(ts: Column, now: str) -> Column:
    seconds = F.unix_micros(F.to_timestamp(F.lit(now)).cast("timestamp")) - F.unix_micros(ts.cast("timestamp"))
    return seconds / 3_600_000_000


def recency(ts: Column, now: str, half_life: float = 24.0) -> Column:
    """2 ** (-hours / half_life) within 0..1; 0 without a time."""
    raw = F.exp(-F.ln(F.lit(2.0)) * hours_since(ts, now) / half_life)
    return F.coalesce(F.least(F.greatest(raw, F.lit(0.0)), F.lit(1.0)), F.lit(0.0))


def decay(ts: Column, importance: Column, now: str, half_life: float = 168.0) -> Column:
    """Decay factor: a longer half-life the more important."""
    life = half_life * (1 + F.coalesce(importance, F.lit(5.0)) / 10)
    return F.exp(-F.ln(F.lit(2.0)) * F.greatest(hours_since(ts, now), F.lit(0.0)) / life)


def effective_importance(ts: Column, importance: Column, confirmations: Column, accesses: Column, now: str) -> Column:
    """Importance (5 if missing) times decay and strength, within 0.1..10."""
    base = F.coalesce(importance, F.lit(5.0))
    strength = 1 + 0.1 * F.coalesce(confirmations, F.lit(0)) + 0.01 * F.coalesce(accesses, F.lit(0))
    return F.least(F.greatest(base * decay(ts, importance, now) * strength, F.lit(0.1)), F.lit(10.0))


def freshness(ts: Column, ttl_ms: Column, confidence: Column, now: str) -> Column:
    """0.6 time + 0.4 confidence; time falls to 0 over the ttl, or halves each 168 hours."""
    age = hours_since(ts, now)
    by_ttl = F.greatest(F.lit(0.0), 1 - age * 3_600_000 / ttl_ms)
    by_half = F.exp(-F.ln(F.lit(2.0)) * age / 168)
    return 0.6 * F.when(ttl_ms.isNotNull(), by_ttl).otherwise(by_half) + 0.4 * F.coalesce(confidence, F.lit(1.0))


def salience(importance: Column, recent: Column, frequency: Column, context: Column, novelty: Column) -> Column:
    """Weights 0.25, 0.25, 0.2, 0.2 and 0.1 (fixed values)."""
    return 0.25 * importance + 0.25 * recent + 0.2 * frequency + 0.2 * context + 0.1 * novelty


def reliability(confidence: Column, confirmations: Column, days: Column) -> Column:
    return 0.6 * confidence + 0.3 * (1 - 1 / (1 + confirmations / 5)) - 0.1 * F.least(F.lit(0.3), days / 300)
