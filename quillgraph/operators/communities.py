"""Communities of a graph by Louvain's method, as joins of community totals.

All nodes propose their best move at once.  A sweep takes a set of them whose gains are
sure to add up to a rise: a community only sends or only receives nodes (by the best
proposal that touches it), and a proposal must be worth more than it could lose if all
others into its target, or out of its source, were made as well; the best one of both its
communities is always made.  So modularity never falls, no two neighbours swap places,
and every sweep with a proposal makes a move.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import forget, written


def _level(edges: DataFrame, nodes: DataFrame, m2: float, sweeps: int, tolerance: float) -> tuple[DataFrame, bool]:
    """``node, community`` after the local moves of one level, and whether there were any.

    ``edges`` are ``a, b, w`` in both directions without self-loops, ``nodes`` ``node, k``
    with all weight at a node, its self-loops twice.
    """
    now, moved = written(nodes.withColumn("community", F.col("node")), "louvain"), False
    for _ in range(sweeps):
        totals = now.groupBy(F.col("community").alias("c")).agg(F.sum("k").alias("total"))
        at = now.select(F.col("node").alias("b"), F.col("community").alias("c"))
        links = edges.join(at, "b").groupBy("a", "c").agg(F.sum("w").alias("links"))
        near = links.join(now, links["a"] == now["node"]).join(totals, "c")
        own = F.col("c") == F.col("community")
        gain = F.col("links") - (F.col("total") - F.when(own, F.col("k")).otherwise(0.0)) * F.col("k") / m2
        best = near.groupBy("node", "community", "k").agg(
            F.max(F.when(own, gain)).alias("linked"), F.max(F.when(~own, F.struct(gain.alias("gain"), F.xxhash64("c").alias("h"), F.col("c").alias("c")))).alias("best")
        )
        # Without a link into its own community a node's staying is worth what its total costs.
        home = best.join(totals.withColumnRenamed("c", "community"), "community")
        stay = F.coalesce("linked", -(F.col("total") - F.col("k")) * F.col("k") / m2)
        delta = F.col("best.gain") - stay
        wanted = home.filter((F.col("best.gain") > 1e-12) & (delta > 1e-12)).select("node", "k", F.col("community").alias("source"), F.col("best.c").alias("target"), delta.alias("delta"))
        wanted = written(wanted.withColumn("rank", F.struct("delta", F.xxhash64("node").alias("h"), "node")), "louvain-moves")
        touched = wanted.select(F.explode(F.array(F.struct(F.col("source").alias("c"), F.lit(False).alias("into")), F.struct(F.col("target").alias("c"), F.lit(True).alias("into")))).alias("t"), "rank")
        roles = touched.groupBy("t.c").agg(F.max_by("t.into", "rank").alias("receives"), F.max("rank").alias("first"))
        able = (
            wanted.join(roles.select(F.col("c").alias("source"), F.col("first").alias("s_first"), (~F.col("receives")).alias("sends")), "source")
            .join(roles.select(F.col("c").alias("target"), F.col("first").alias("t_first"), "receives"), "target")
            .filter("sends and receives")
        )
        able = written(able, "louvain-able")
        into, out = able.groupBy("target").agg(F.sum("k").alias("in_k")), able.groupBy("source").agg(F.sum("k").alias("out_k"))
        sure = F.col("delta") - (F.col("in_k") + F.col("out_k") - 2 * F.col("k")) * F.col("k") / m2 > 1e-12
        first = (F.col("rank") == F.col("s_first")) & (F.col("rank") == F.col("t_first"))
        made = able.join(into, "target").join(out, "source").filter(sure | first).select("node", F.col("target").alias("to"), "delta")
        after = written(now.join(made, "node", "left").select("node", "k", F.coalesce("to", "community").alias("community"), "delta"), "louvain")
        risen = after.agg(F.sum("delta")).first()[0]
        for old in (now, wanted, able):
            forget(old)
        now = after.drop("delta")
        now._written_to = after._written_to
        if risen is None:
            break
        moved = True
        if 2 * risen / m2 < tolerance:
            break
    return now.select("node", "community"), moved


def louvain(nodes: DataFrame, relations: DataFrame, sweeps: int = 50, tolerance: float = 1e-6) -> tuple[DataFrame, list[float]]:
    """``node, community`` (the least node of it), and the modularity after each level.

    Relations are undirected and count as often as they occur, self-loops too; those with
    an end that is no node are left out.  Isolated nodes are communities of their own;
    without relations all nodes are, with no level.  Null nodes take no part.
    """
    names = written(nodes.select("node").filter("node is not null").distinct(), "louvain-nodes")
    known = relations.select("src", "dst").join(names.select(F.col("node").alias("src")), "src", "left_semi").join(names.select(F.col("node").alias("dst")), "dst", "left_semi")
    pairs = written(known.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.count(F.lit(1)).cast("double").alias("w")), "louvain-pairs")
    m2 = 2.0 * (pairs.agg(F.sum("w")).first()[0] or 0.0)
    belongs, found = names.withColumn("community", F.col("node")), []
    while m2:
        weight = pairs.select(F.explode(F.array("a", "b")).alias("node"), "w").groupBy("node").agg(F.sum("w").alias("k"))
        apart = pairs.filter("a <> b")
        edges = written(apart.unionByName(apart.select(F.col("b").alias("a"), F.col("a").alias("b"), "w")), "louvain-edges")
        moves, improved = _level(edges, weight, m2, sweeps, tolerance)
        # A level's community is called by its least node, of all that are in it.
        step = belongs.join(moves.withColumnRenamed("node", "n").withColumnRenamed("community", "c"), F.col("community") == F.col("n"), "left").select("node", "community", F.coalesce("c", "community").alias("c"))
        least = step.groupBy("c").agg(F.min("node").alias("least"))
        renamed = written(step.join(least, "c").select("node", F.col("community").alias("was"), F.col("least").alias("community")), "louvain-members")
        names_of = renamed.select(F.col("was").alias("x"), "community").distinct()
        belongs = renamed.select("node", "community")
        merged = pairs.join(names_of.select(F.col("x").alias("a"), F.col("community").alias("ca")), "a").join(names_of.select(F.col("x").alias("b"), F.col("community").alias("cb")), "b")
        folded = written(merged.groupBy(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).agg(F.sum("w").alias("w")), "louvain-pairs")
        for old in (pairs, edges):
            forget(old)
        pairs = folded
        found.append(_modularity(pairs, m2))
        if not improved:
            break
    return belongs, found


def _modularity(pairs: DataFrame, m2: float) -> float:
    """Of communities as nodes: inner weight less what it would be by chance."""
    degree = pairs.select(F.explode(F.array("a", "b")).alias("c"), "w").groupBy("c").agg(F.sum("w").alias("k"))
    inside = pairs.agg(F.sum(F.when(F.col("a") == F.col("b"), 2 * F.col("w")).otherwise(0.0))).first()[0] or 0.0
    return inside / m2 - (degree.agg(F.sum((F.col("k") / m2) ** 2)).first()[0] or 0.0)
