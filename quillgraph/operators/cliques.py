"""Core numbers and maximal cliques, each clique found at its lowest node in the order by degree."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import forget, written
from .graph import adjacency, common_later, later_neighbours


def core_numbers(relations: DataFrame) -> DataFrame:
    """``node, core``: the greatest k for which the node is in a part where all have k neighbours.

    Starts from the degrees; each round a node takes the greatest h of which h neighbours
    have h or more, until nothing changes.  A round is one join and two groupings, the
    first by distinct values, so a node of many neighbours is never one group of them.
    """
    edges = written(adjacency(relations, "both").distinct(), "core-edges")
    now = written(edges.groupBy("node").agg(F.count(F.lit(1)).alias("core")), "cores")
    while True:
        other = now.select(F.col("node").alias("other"), F.col("core").alias("theirs"))
        met = edges.join(other, "other").join(now, "node").groupBy("node", "core", F.least("theirs", "core").alias("value")).agg(F.count(F.lit(1)).alias("n"))
        # Few values a node has: at most its own core number, whatever its degree.
        above = F.sum("n").over(Window.partitionBy("node").orderBy(F.desc("value")))
        new = met.withColumn("h", F.least("value", above)).groupBy("node", "core").agg(F.max("h").alias("new"))
        after = written(new, "cores")
        changed = not after.filter("new <> core").isEmpty()
        forget(now)
        now = after.select("node", F.col("new").alias("core"))
        now._written_to = after._written_to
        if not changed:
            forget(edges)
            return now


def _grow(around: dict, chosen: list, open_: set, done: set) -> Iterator[list]:
    """Maximal cliques by pivoting: a branch for each open node that the pivot is no neighbour of."""
    if not open_ and not done:
        yield chosen
        return
    pivot = max(open_ | done, key=lambda v: (len(around[v] & open_), v))
    for v in sorted(open_ - around[pivot]):
        yield from _grow(around, [*chosen, v], open_ & around[v], done & around[v])
        open_ = open_ - {v}
        done = done | {v}


def maximal_cliques(relations: DataFrame, min_size: int = 3) -> DataFrame:
    """``clique`` (sorted nodes), ``size`` of all maximal cliques of ``min_size`` nodes (2 at least) or more, undirected.

    Nodes are ordered by degree and name.  Every triangle goes to its lowest node, as an
    edge among that one's later neighbours, and to its middle node, as an earlier neighbour
    that may make a clique of later ones too small; earlier neighbours with the same later
    ones count once.  Each node then finds the maximal cliques among its later neighbours, of
    which there are at most the square root of twice the relations, and leaves out those that
    an earlier node extends.  So no graph, and no list of a node's neighbours, is in one task
    but what is later in the order.  No number of cliques is too large.
    """
    if min_size < 2:
        raise ValueError("cliques have two nodes or more here; single ones are the nodes without relations")
    later = written(later_neighbours(relations), "later-neighbours")
    triangles = written(common_later(later), "clique-triangles")
    among = triangles.groupBy("node").agg(F.collect_list(F.struct("other", "common")).alias("among"))
    sets = triangles.select(F.col("other").alias("node"), F.array_sort("common").alias("set")).distinct()
    earlier = sets.groupBy("node").agg(F.collect_list("set").alias("earlier"))
    # Pairs with an earlier node in common are in a triangle, so they are in these sets too.
    rows = later.join(among, "node", "left").join(earlier, "node", "left")
    kind = later.schema["node"].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for node, after, pairs, before in zip(frame["node"], frame["later"], frame["among"], frame["earlier"], strict=True):
                around = {v: set() for v in after}
                for pair in pairs if pairs is not None else ():
                    around[pair["other"]].update(pair["common"])
                    for b in pair["common"]:
                        around[b].add(pair["other"])
                taken = [set(s) for s in before] if before is not None else []
                found = []
                for clique in _grow(around, [], set(around), set()):
                    if len(clique) + 1 >= min_size and not any(s.issuperset(clique) for s in taken):
                        found.append(sorted([node, *clique]))
                    if len(found) >= 10_000:
                        yield pd.DataFrame({"clique": found, "size": [len(c) for c in found]})
                        found = []
                if found:
                    yield pd.DataFrame({"clique": found, "size": [len(c) for c in found]})

    return rows.select("node", "later", "among", "earlier").mapInPandas(run, f"clique array<{kind}>, size int")
