"""Paths that explain search results: from anchors to results, searched from all anchors at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import forget, written


def shortest_paths(relations: DataFrame, sources: DataFrame, max_depth: int) -> tuple[DataFrame, DataFrame]:
    """``source, node, depth, nodes, types`` of all nodes within the depth, and the sources with more beyond it.

    Of several shortest paths it is the one whose relations come first (by ``ord``, the
    first relation first), which is the one that a search with a queue finds.  Relations
    (``src, dst, relation_type, ord``) are walked both ways, self-loops not at all.  One join
    and one grouping a level, written, so that no node's neighbours meet but as partial minima.
    """
    flat = relations.filter("src <> dst").select("src", "dst", "relation_type", "ord")
    there = flat.select(F.col("src").alias("node"), F.col("dst").alias("other"), F.struct("ord", "relation_type").alias("r"))
    both = there.unionByName(flat.select(F.col("dst").alias("node"), F.col("src").alias("other"), F.struct("ord", "relation_type").alias("r")))
    edges = written(both.groupBy("node", "other").agg(F.min("r").alias("r")), "evidence-edges")
    none = lambda kind: F.array().cast(f"array<{kind}>")
    start = sources.select(F.col("node").alias("source"), "node").distinct()
    kinds = {f.name: f.dataType.simpleString() for f in edges.schema["r"].dataType.fields}
    level = written(start.select("source", "node", F.lit(0).alias("depth"), F.array("node").alias("nodes"), none(kinds["ord"]).alias("ords"), none(kinds["relation_type"]).alias("types")), "evidence")
    levels = [level]
    for depth in range(1, max_depth + 1):
        step = level.join(edges, "node").select("source", F.col("other").alias("node"), F.concat("ords", F.array("r.ord")).alias("ords"), F.concat("nodes", F.array("other")).alias("nodes"), F.concat("types", F.array("r.relation_type")).alias("types"))
        least = step.groupBy("source", "node").agg(F.min(F.struct("ords", "nodes", "types")).alias("p"))
        fresh = least
        for seen in levels[-2:]:  # what a level meets again is in the last two
            fresh = fresh.join(seen.select("source", "node"), ["source", "node"], "left_anti")
        level = written(fresh.select("source", "node", F.lit(depth).alias("depth"), "p.nodes", "p.ords", "p.types"), "evidence")
        if level.isEmpty():
            break
        levels.append(level)
    beyond = level.join(edges, "node").select("source", F.col("other").alias("node")).distinct()
    for seen in levels[-2:]:
        beyond = beyond.join(seen.select("source", "node"), ["source", "node"], "left_anti")
    limited = written(beyond.select("source").distinct(), "evidence-limited")
    out = levels[0]
    for x in levels[1:]:
        out = out.unionByName(x)
    forget(edges)
    return out.select("source", "node", "depth", "nodes", "types"), limited


def evidence_paths(relations: DataFrame, results: DataFrame, anchors: DataFrame, max_depth: int = 3, max_paths: int = 3) -> tuple[DataFrame, DataFrame]:
    """Paths from anchors to each result (``result, rank, anchor, via, nodes, types``), and ``result, n_paths, truncated``.

    Anchors (``name, score, via, ord``) are taken by score, best first, then by ``ord``; of
    rows with one name the first by ``ord`` counts, a null score is 0.  A result that is an
    anchor is a path of itself.  Each anchor gives one shortest path; a result has
    ``max_paths`` at most.  It is truncated if anchors are left then, or if a search that
    found nothing had more to see beyond ``max_depth``.
    """
    named = anchors.groupBy("name").agg(F.min_by(F.struct("score", "via", "ord"), "ord").alias("a"))
    named = written(named.select(F.col("name").alias("anchor"), F.coalesce("a.score", F.lit(0.0)).alias("score"), "a.via", "a.ord"), "evidence-anchors")
    paths, limited = shortest_paths(relations, named.select(F.col("anchor").alias("node")), max_depth)
    wanted = results.select(F.col("name").alias("result")).distinct()
    hits = paths.join(wanted, paths["node"] == wanted["result"]).select("result", F.col("source").alias("anchor"), "nodes", "types").join(named, "anchor")
    order = Window.partitionBy("result").orderBy(F.desc("score"), "ord")
    ranked = written(hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= max_paths), "evidence-paths")
    full = ranked.groupBy("result").agg(F.count(F.lit(1)).alias("n_paths"), F.max_by(F.struct((-F.col("score")).alias("s"), F.col("ord").alias("o")), "rank").alias("last"))
    # What comes last in the anchors' order, and which of them stopped at the depth.
    places = named.select("anchor", F.struct((-F.col("score")).alias("s"), F.col("ord").alias("o")).alias("at"))
    stopped = places.join(limited, places["anchor"] == limited["source"]).select("anchor")
    ends = places.agg(F.max("at").alias("end")).crossJoin(F.broadcast(stopped.agg(F.count(F.lit(1)).alias("stops"))))  # one row each
    reached = hits.join(stopped, "anchor").groupBy("result").agg(F.count(F.lit(1)).alias("reached"))
    met = wanted.join(full, "result", "left").join(reached, "result", "left").crossJoin(F.broadcast(ends))
    more = (F.coalesce("n_paths", F.lit(0)) >= max_paths) & (F.col("last") < F.col("end"))
    # Without more anchors all have been searched; one that stopped and found nothing may have missed a path.
    missed = F.col("stops") > F.coalesce("reached", F.lit(0))
    flags = met.select("result", F.coalesce("n_paths", F.lit(0)).alias("n_paths"), F.coalesce(more | missed, missed).alias("truncated"))
    return ranked.select("result", "rank", "anchor", "via", "nodes", "types"), flags
