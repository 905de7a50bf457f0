"""Reads over memory records: sessions, plans, decisions, heuristics, turns, roles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def stale(last_seen: Column, now: str, after: str = "1 hour") -> Column:
    """Nothing was seen for longer than ``after``."""
    return last_seen < F.to_timestamp(F.lit(now)) - F.expr(f"interval {after}")


def newest(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """The newest record of each key."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n")


def chain(records: DataFrame, start: str, max_depth: int = 100) -> DataFrame:
    """Follows ``previous`` from a record back: ``id, steps``; cycles end the walk."""
    from .graph import bfs

    edges = records.select(F.col("id").alias("src"), F.col("previous").alias("dst")).filter("dst is not null")
    begin = records.sparkSession.createDataFrame([(start,)], "node string")
    return bfs(edges, begin, max_depth, "outgoing").select(F.col("node").alias("id"), F.col("depth").alias("steps"))


def observation_score(text: Column, category: Column) -> Column:
    """Mean of length, capitalised words, specificity and category (fixed weights)."""
    words = F.split(text, r"\s+")
    capital = F.size(F.filter(F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda w: w.rlike("^[A-Z][a-z]")))
    date = text.rlike(r"(?i)\d{4}[-/]\d{1,2}[-/]\d{1,2}|\b(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\b")
    parts = [F.least(F.lit(1.0), F.length(text) / 80), F.least(F.lit(1.0), capital * F.lit(0.3)), F.when(text.rlike(r"\d"), 0.4).otherwise(0.0) + F.when(date, 0.4).otherwise(0.0), F.when(category, 0.6).otherwise(0.0)]
    return sum(parts[1:], parts[0]) * 0.25


def rules_pass(conditions: list[Column], every: bool = True) -> Column:
    """AND or OR of conditions; none is a pass."""
    if not conditions:
        return F.lit(True)
    out = F.coalesce(conditions[0], F.lit(False))
    for c in conditions[1:]:
        c = F.coalesce(c, F.lit(False))
        out = out & c if every else out | c
    return out


def promotion_priority(marked: Column, confidence: Column, confirmations: Column, accesses: Column, least_confidence: float = 0.8, least_confirmations: int = 2) -> Column:
    """100 if marked, and 50, 10 and 1 for each unit where thresholds are met; null for others."""
    meets = (confidence >= least_confidence) & (confirmations >= least_confirmations)
    total = F.when(marked, 100.0).otherwise(0.0) + F.when(meets, confidence * 50 + confirmations * 10 + accesses).otherwise(0.0)
    return F.when(marked | meets, total)


def heuristic_matches(heuristics: DataFrame, situation: str, least: float = 0.1) -> DataFrame:
    """``id, score``: Jaccard of the words times confidence."""
    words = T.tokenize_alphanumeric(F.lit(situation))
    score = T.jaccard(F.array_distinct(T.tokenize_alphanumeric(F.col("condition"))), F.array_distinct(words)) * F.col("confidence")
    return heuristics.select("id", F.round(score, 6).alias("score")).filter(F.col("score") >= least)


def role_allows(requests: DataFrame, assignments: DataFrame, matrix: DataFrame, default_role: str) -> DataFrame:
    """``request, allowed``: some unexpired role of the agent, or the default role, has the permission in scope.

    A role's scope is a prefix of the resource; all are equi-joins on agent, role and permission.
    """
    held = requests.join(assignments, "agent").filter(F.startswith("resource", F.coalesce("scope", F.lit(""))) & (F.col("expires").isNull() | (F.col("expires") > F.col("at"))))
    roles = held.select("request", "role", "permission").unionByName(requests.join(assignments.select("agent").distinct(), "agent", "left_anti").select("request", F.lit(default_role).alias("role"), "permission"))
    yes = roles.join(matrix, ["role", "permission"]).select("request").distinct().withColumn("allowed", F.lit(True))
    return requests.select("request").join(yes, "request", "left").select("request", F.coalesce("allowed", F.lit(False)).alias("allowed"))


def visible(agent: str, org: str, teams: list[str]) -> Column:
    """Own, public, of the same organisation, or of one of the teams."""
    return (
        (F.col("owner") == agent) | (F.col("visibility") == "public") | ((F.col("visibility") == "org") & (F.col("org") == org))
        | ((F.col("visibility") == "team") & F.col("team").isin(teams))
    )


def excluded(text: Column, phrases: list[str]) -> Column:
    """A phrase of the block list occurs, without case; never in a null text."""
    out = F.lit(False)
    for p in phrases:
        out = out | F.coalesce(F.contains(F.lower(text), F.lit(p.lower())), F.lit(False))
    return out


def inverse_pairs(relations: DataFrame) -> DataFrame:
    """Pairs of relations that run both ways: ``a, b`` with a < b."""
    # One grouping by the two ends, summed up in tasks first: no join of all relations with themselves.
    ends = relations.filter("src <> dst").groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
    return ends.agg(F.bool_or(F.col("src") < F.col("dst")).alias("up"), F.bool_or(F.col("src") > F.col("dst")).alias("down")).filter("up and down").select("a", "b")


def broken_links(log: DataFrame, order: str, line: Column) -> DataFrame:
    """Rows of a hash chain whose ``prev_hash`` is not the hash of the line before, within each ``shard``."""
    w = Window.partitionBy("shard").orderBy(order)
    return log.withColumn("want", F.lag(F.sha2(line, 256)).over(w)).filter(F.col("want").isNotNull() & ~F.col("prev_hash").eqNullSafe(F.col("want"))).drop("want")


def transcript_messages(text: Column) -> Column:
    """Messages of a transcript whose speakers are ``Name:`` at line starts: array of (speaker, message)."""
    found = F.regexp_extract_all(text, F.lit(r"(?m)^([A-Z]\w*):"), F.lit(1))
    bodies = F.slice(F.split(text, r"(?m)^[A-Z]\w*:"), 2, F.size(found))
    return F.zip_with(found, bodies, lambda s, m: F.struct(s.alias("speaker"), F.trim(m).alias("message")))
