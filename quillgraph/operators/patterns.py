"""Templates of texts that differ in a few places, by an equi-join on masked keys.

A text gives a key for each choice of places that may differ, with those places masked.
Texts with one key agree everywhere else, so they meet by grouping on keys: no pairs are
made, and a template that many texts share is summed up in tasks before it is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MASK = "{X}"


def _masks(n: Column, most: int) -> Column:
    """All sets of one to ``most`` places (at most half of ``n``), each ascending."""
    places = F.sequence(F.lit(0), n - 1)
    out = F.transform(places, lambda i: F.array(i))
    if most == 2:
        later = lambda i: F.when(i < n - 1, F.transform(F.sequence(i + 1, n - 1), lambda j: F.array(i, j))).otherwise(F.array().cast("array<array<int>>"))
        out = F.when(n >= 4, F.concat(out, F.flatten(F.transform(places, later)))).otherwise(out)
    return out


def masked(texts: DataFrame, max_variables: int = 2, max_tokens: int = 32) -> DataFrame:
    """A row for each distinct text and choice of places: ``ord, text, tokens, mask, key``."""
    if max_variables not in (1, 2):
        raise ValueError("one or two places may differ")
    tokens = F.filter(F.split("text", r"\s+"), lambda t: t != "")
    once = texts.filter("text is not null").groupBy("text").agg(F.min("ord").alias("ord")).select("ord", "text", tokens.alias("tokens"))
    short = once.filter(F.size("tokens").between(2, max_tokens))
    rows = short.select("ord", "text", "tokens", F.explode(_masks(F.size("tokens"), max_variables)).alias("mask"))
    return rows.withColumn("key", _shown(F.transform("tokens", F.lower)))


def _shown(tokens: Column) -> Column:
    return F.array_join(F.transform(tokens, lambda t, i: F.when(F.array_contains(F.col("mask"), i), F.lit(MASK)).otherwise(t)), " ")


def templates(texts: DataFrame, min_occurrences: int = 2, max_variables: int = 2, max_tokens: int = 32) -> DataFrame:
    """Templates of ``ord, text``: ``pattern, mask, key, occurrences, confidence``.

    A template has fixed tokens and one or two places that differ, not more of these than
    fixed ones; two texts at least differ in all of its places (case aside).  All distinct
    texts that match it are its occurrences; ``confidence`` is their share of all rows.
    ``pattern`` has the tokens as the first text (by ``ord``) writes them.  Texts of one
    token or of more than ``max_tokens`` have none; null and empty texts have none either,
    but count as rows, as repeated texts do.
    """
    rows = masked(texts, max_variables, max_tokens)
    at = lambda k: F.lower(F.get("tokens", F.get("mask", F.lit(k))))
    found = rows.groupBy("mask", "key").agg(
        F.count(F.lit(1)).alias("occurrences"), F.min_by(_shown(F.col("tokens")), "ord").alias("pattern"), F.count_distinct(at(0)).alias("first"), F.count_distinct(at(1)).alias("second")
    )
    # Of texts that have two first and two second values some two differ in both.
    real = found.filter((F.col("first") > 1) & ((F.size("mask") == 1) | (F.col("second") > 1)) & (F.col("occurrences") >= min_occurrences))
    total = texts.agg(F.count(F.lit(1)).alias("total"))
    return real.crossJoin(F.broadcast(total)).select("pattern", "mask", "key", "occurrences", F.least(F.lit(1.0), F.col("occurrences") / F.col("total")).alias("confidence"))


def matches(texts: DataFrame, found: DataFrame, max_variables: int = 2, max_tokens: int = 32) -> DataFrame:
    """``pattern, ord, variables`` of each distinct text that matches a template; the text's first ``ord``."""
    rows = masked(texts, max_variables, max_tokens)
    met = rows.join(found.select("mask", "key", "pattern"), ["mask", "key"])
    return met.select("pattern", "ord", F.transform("mask", lambda i: F.get("tokens", i)).alias("variables"))
