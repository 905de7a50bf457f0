"""Chains of records that each point at one other, for all records at once.

Pointers double each round: after r rounds a record knows the 2^r-th one behind it, so the
rounds are logarithmic in the longest chain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import forget, written


def first_links(relations: DataFrame, kind: str) -> DataFrame:
    """``node, next``: of each node's relations of a type (``src, dst, relation_type, ord``) to another node the first one."""
    some = relations.filter((F.col("relation_type") == kind) & (F.col("src") != F.col("dst")))
    return some.groupBy(F.col("src").alias("node")).agg(F.min_by("dst", F.struct("ord", "dst")).alias("next"))


#: Records of a chain in one array; longer chains go on as rows.
_ARRAY = 64


def _walks(ends: DataFrame, reach: int) -> tuple[DataFrame, bool]:
    """``node, walk``: the next ``reach`` records (a power of two) of each node, fewer where the chain ends; and whether any has so many.

    In a cycle a walk goes on round it.  Each doubling puts the walk of the last record
    behind that of a node; rows are one for each node, whatever their number of records.
    """
    walks, size = written(ends.select("node", F.array("next").alias("walk")), "walks"), 1
    while size < reach:
        full = walks.filter(F.size("walk") == size).withColumn("far", F.element_at("walk", -1))
        if full.isEmpty():
            return walks, False
        other = walks.select(F.col("node").alias("far"), F.col("walk").alias("more"))
        longer = full.join(other, "far", "left").select("node", F.when(F.col("more").isNull(), F.col("walk")).otherwise(F.concat("walk", "more")).alias("walk"))
        after = written(walks.filter(F.size("walk") < size).unionByName(longer), "walks")
        forget(walks)
        walks, size = after, 2 * size
    return walks, not walks.filter(F.size("walk") == size).isEmpty()


def chains(links: DataFrame, max_length: int | None = None) -> DataFrame:
    """``start, place, node``: the records behind each ``node``, nearest first (place 1), along ``next``.

    A chain ends where there is no next record, before it would come to one that it has
    met (its start too), and after ``max_length``.  ``node`` must be distinct; links of
    null nodes or to null ones are none.  A row for each record of each chain is the result;
    up to 64 of them are one array until then, so that rounds shuffle no row for each.
    """
    ends = links.filter("node is not null and next is not null").select("node", "next")
    reach = _ARRAY
    while max_length is not None and reach >= 2 * max_length and reach > 1:
        reach //= 2
    walks, full = _walks(ends, reach)
    # What comes after the first repeat in a walk has been met, too.
    own = F.array_distinct(F.concat(F.array("node"), "walk"))
    if max_length is not None:
        own = F.slice(own, 1, max_length + 1)
    rows = walks.select(F.col("node").alias("start"), F.posexplode(own).alias("place", "node")).filter("place > 0").withColumn("place", F.col("place").cast("bigint"))
    if not full or (max_length is not None and reach >= max_length):
        return rows
    met = written(rows, "chains")
    jump = written(walks.filter(F.size("walk") == reach).select("node", F.element_at("walk", -1).alias("far")), "chain-jumps")
    forget(walks)
    while max_length is None or reach < max_length:
        further = met.join(jump, "node").filter(F.col("far") != F.col("start")).select("start", (F.col("place") + reach).alias("place"), F.col("far").alias("node"))
        if max_length is not None:
            further = further.filter(F.col("place") <= max_length)
        # In a cycle the first place of a record counts; a later one would only be met again.
        all_ = met.withColumn("old", F.lit(True)).unionByName(further.withColumn("old", F.lit(False)))
        after = written(all_.groupBy("start", "node").agg(F.min("place").alias("place"), F.max("old").alias("old")), "chains")
        grown = not after.filter("not old").isEmpty()
        other = jump.select(F.col("node").alias("far"), F.col("far").alias("beyond"))
        longer = written(jump.join(other, "far").select("node", F.col("beyond").alias("far")), "chain-jumps")
        for done in (met, jump):
            forget(done)
        met, jump, reach = after.select("start", "place", "node"), longer, 2 * reach
        met._written_to = after._written_to
        if not grown:
            break
    forget(jump)
    return met


def roots(met: DataFrame) -> DataFrame:
    """``start, root, length`` of chains: the last record of each."""
    return met.groupBy("start").agg(F.max_by("node", "place").alias("root"), F.max("place").alias("length"))


def failure_lessons(failures: DataFrame, content: DataFrame, causes: DataFrame, max_length: int = 5) -> DataFrame:
    """``node, root, length, description, lesson`` of failed episodes (column ``node``), by the chain of their causes.

    ``content`` is ``node, content``; a null content is the node's name.  ``causes`` are
    ``node, next``.  Without a cause the root is null and the length 0.
    """
    known = content.select("node", F.coalesce("content", F.col("node").cast("string")).alias("content"))
    found = roots(chains(causes.join(known.select(F.col("node").alias("next")), "next", "left_semi"), max_length))
    rows = failures.select("node").join(known, "node").join(found.withColumnRenamed("start", "node"), "node", "left")
    rows = rows.join(known.select(F.col("node").alias("root"), F.col("content").alias("cause")), "root", "left")
    text: Column = F.col("content")
    some = F.col("root").isNotNull()
    description = F.when(some, F.concat(F.lit("Failure: "), text, F.lit(" (root cause: "), F.col("cause"), F.lit(")"))).otherwise(F.concat(F.lit("Failure: "), text))
    lesson = F.when(some, F.concat(F.lit('To prevent "'), text, F.lit('", address root cause: "'), F.col("cause"), F.lit('"'))).otherwise(F.concat(F.lit("Avoid: "), text))
    return rows.select("node", "root", F.coalesce("length", F.lit(0)).cast("bigint").alias("length"), description.alias("description"), lesson.alias("lesson"))
