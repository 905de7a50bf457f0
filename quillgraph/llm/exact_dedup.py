"""Exact deduplication with DataFrame functions only.

Rows are grouped by a 128-bit hash of their normalised text together with the text
itself, so Spark's grouping compares the bytes of all rows of one hash; two texts
that share a hash form two groups.  The grouping sums within each task before it
shuffles, so a group of any size sends one row from each task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written

#: A run of blanks that is not a single space already; it becomes one space.
_BLANK_RUN = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    """The text with each run of ``[\\x20\\x09-\\x0D]`` as one space; null is empty."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), _BLANK_RUN, " ")


def content_hash(norm: Column) -> Column:
    """128 bits of a normalised text."""
    return F.unhex(F.md5(norm))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_of: Callable[[Column], Column] = content_hash) -> DataFrame:
    """The group of every row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    ``keep_id`` is the smallest id of the rows with an equal normalised text; null ids
    lose to others, and a group of null ids only has a null ``keep_id``.  Null and
    empty texts are one group.  Rows that repeat an id and a text are counted each and
    are all marked ``kept`` if their id stays; ``drop_exact`` keeps one of them.  An
    empty table gives an empty result.  Other columns are not carried.

    Plan: one aggregation shuffles each distinct text once from each task.  Its small
    result (hash, id, count) is written to the shared folder and joined to the rows'
    hashes; AQE splits a hot hash.  Only if a hash has two different texts, its rows
    are joined by their texts.
    """
    rows = docs.select(docs[id_col].alias("doc_id"), normalised(docs[text_col]).alias("norm")).select("doc_id", "norm", hash_of(F.col("norm")).alias("hash"))
    texts = rows.groupBy("hash", "norm").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    groups = written(texts.groupBy("hash").agg(F.count(F.lit(1)).alias("texts"), F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size")), "exact-groups")
    keyed = rows.select("doc_id", "hash", F.sha2("norm", 256).alias("text_sha256"))
    found = keyed.join(groups.filter("texts = 1").drop("texts"), "hash").drop("hash")
    clashes = groups.filter("texts > 1").select("hash")
    if not clashes.isEmpty():
        apart = rows.join(clashes, "hash", "left_semi").join(texts.join(clashes, "hash", "left_semi"), ["hash", "norm"])
        found = found.unionByName(apart.select("doc_id", F.sha2("norm", 256).alias("text_sha256"), "keep_id", "group_size"))
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_of: Callable[[Column], Column] = content_hash) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Of rows with an equal normalised text, one with the smallest id stays (null ids lose
    to others; of rows that repeat that id, or have null ids only, the one whose columns
    have the least hash).  Null and empty texts are one group.

    Plan: one aggregation, in which a task sends one row of each of its texts; the text
    goes along a second time only where normalising changed it.
    """
    norm = normalised(docs[text_col])
    others = [c for c in docs.columns if c != text_col]
    kept = F.struct(F.when(~norm.eqNullSafe(docs[text_col]), F.struct(docs[text_col].alias("text"))).alias("differs"), *[docs[c].alias(f"c{i}") for i, c in enumerate(others)])
    order = F.struct(docs[id_col].isNull(), docs[id_col], F.xxhash64(*[docs[c] for c in docs.columns]))
    rows = docs.select(norm.alias("norm"), hash_of(norm).alias("hash"), kept.alias("row"), order.alias("order"))
    best = rows.groupBy("hash", "norm").agg(F.min_by("row", "order").alias("row"))
    text = F.when(F.col("row.differs").isNotNull(), F.col("row.differs.text")).otherwise(F.col("norm")).cast(docs.schema[text_col].dataType)
    return best.select(*[text.alias(c) if c == text_col else F.col(f"row.c{others.index(c)}").alias(c) for c in docs.columns])
