"""Validation rules as columns: a message where a rule is broken, else null."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rule(ok: Column, message: str) -> Column:
    return F.when(~F.coalesce(ok, F.lit(False)), F.lit(message))


def required(c: str) -> Column:
    return rule(F.col(c).isNotNull() & (F.trim(F.col(c).cast("string")) != ""), f"{c} is required")


def length(c: str, least: int = 0, most: int = 2**31 - 1) -> Column:
    return rule(F.length(c).between(least, most), f"{c} must have {least} to {most} characters")


def between(c: str, least: float, most: float) -> Column:
    return rule(F.col(c).between(least, most), f"{c} must be {least} to {most}")


def pattern(c: str, regex: str) -> Column:
    return rule(F.col(c).rlike(regex), f"{c} has the wrong form")


def email(c: str) -> Column:
    return pattern(c, r"^[^\s@]+@[^\s@]+\.[^\s@]+$")


def iso_date(c: str) -> Column:
    return rule(F.try_to_timestamp(F.col(c)).isNotNull(), f"{c} is no ISO date")


def one_of(c: str, values: list[str]) -> Column:
    return rule(F.col(c).isin(values), f"{c} must be one of {', '.join(values)}")


def problems(df: DataFrame, *rules: Column) -> DataFrame:
    """Adds ``problems``, the messages of all broken rules."""
    return df.withColumn("problems", F.array_compact(F.array(*rules)))


def transition_allowed(old: Column, new: Column, legal: dict[str, list[str]]) -> Column:
    """Whether a state may follow another; a missing state is ``published``."""
    o = F.coalesce(old, F.lit("published"))
    return reduce(lambda a, b: a | b, ((o == s) & new.isin(t) for s, t in legal.items()), F.lit(False))
