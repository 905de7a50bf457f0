"""Graph operators over relations (src, dst, and others)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import TASK_BYTES, dealt, forget, written


def adjacency(relations: DataFrame, direction: str = "both") -> DataFrame:
    """``node, other`` of every relation but self-loops, in one direction or both."""
    out = relations.select(F.col("src").alias("node"), F.col("dst").alias("other"))
    back = relations.select(F.col("dst").alias("node"), F.col("src").alias("other"))
    both = {"outgoing": out, "incoming": back, "both": out.unionByName(back)}[direction]
    return both.filter("node <> other")


def neighbors(relations: DataFrame, node: str, direction: str = "both", kinds: list[str] | None = None) -> DataFrame:
    """Distinct neighbours of a node, over relations of some types (without case)."""
    if kinds:
        relations = relations.filter(F.lower("relation_type").isin([k.lower() for k in kinds]))
    return adjacency(relations, direction).filter(F.col("node") == node).select(F.col("other").alias("neighbor")).distinct()


def bfs(relations: DataFrame, starts: DataFrame, max_depth: int, direction: str = "both") -> DataFrame:
    """``node, depth`` of all nodes reached from ``starts`` (column ``node``).

    One join for each level; the frontier and what was seen are written each time, so
    plans stay small.
    """
    edges = adjacency(relations, direction)
    seen = frontier = written(starts.select("node").distinct().withColumn("depth", F.lit(0)), "bfs")
    for depth in range(1, max_depth + 1):
        step = frontier.select("node").join(edges, "node").select(F.col("other").alias("node")).distinct()
        frontier = written(step.join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(depth)), "bfs")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def shortest_path_length(relations: DataFrame, a: str, b: str, max_depth: int, direction: str = "both") -> DataFrame:
    """``length`` of the shortest path; no row if there is none."""
    start = relations.sparkSession.createDataFrame([(a,)], "node string")
    return bfs(relations, start, max_depth, direction).filter(F.col("node") == b).select(F.col("depth").alias("length"))


def all_paths(relations: DataFrame, a: str, b: str, max_depth: int = 5, direction: str = "outgoing") -> DataFrame:
    """All simple paths from a to b: ``path, length``; the depth bounds their number."""
    edges = adjacency(relations, direction).distinct()
    now = edges.filter(F.col("node") == a).select(F.array("node", "other").alias("path"))
    done = None
    for length in range(1, max_depth + 1):
        hit = now.filter(F.element_at("path", -1) == b).withColumn("length", F.lit(length))
        done = hit if done is None else done.unionByName(hit)
        if length < max_depth:
            open_ = now.filter(F.element_at("path", -1) != b).withColumn("node", F.element_at("path", -1))
            now = open_.join(edges, "node").filter(~F.array_contains("path", F.col("other"))).select(F.concat("path", F.array("other")).alias("path"))
    return done


def upward_paths(relations: DataFrame, prefix: str, max_depth: int = 50) -> DataFrame:
    """``node, path`` from each node with a prefix along outgoing relations to a node without any.

    One join a level; paths end at the depth, and a node that was met is not entered again.
    """
    edges = adjacency(relations, "outgoing").distinct()
    now = written(edges.select("node").distinct().filter(F.startswith("node", F.lit(prefix))).select(F.col("node").alias("start"), F.array("node").alias("path")), "paths")
    done = None
    for _ in range(max_depth):
        step = now.join(edges, F.element_at("path", -1) == edges["node"], "left")
        ends = step.filter("other is null").select(F.col("start").alias("node"), "path")
        done = ends if done is None else done.unionByName(ends)
        now = written(step.filter("other is not null").filter(~F.array_contains("path", F.col("other"))).select("start", F.concat("path", F.array("other")).alias("path")), "paths")
        if now.isEmpty():
            break
    return done


def degree_centrality(nodes: DataFrame, relations: DataFrame) -> DataFrame:
    """``node, degree, score``: in + out relations, a self-loop twice; score = degree / (n - 1)."""
    ends = relations.select(F.explode(F.array("src", "dst")).alias("node"))
    degree = ends.groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    n = nodes.select("node").distinct().agg(F.count(F.lit(1)).alias("n"))
    met = nodes.select("node").distinct().join(degree, "node", "left").crossJoin(F.broadcast(n))
    d = F.coalesce("degree", F.lit(0)).cast("bigint")
    return met.select("node", d.alias("degree"), F.round(F.when(F.col("n") > 1, d / (F.col("n") - 1)).otherwise(0.0), 6).alias("score"))


def _wide(df: DataFrame, size: int, *keys: str) -> DataFrame:
    """Rows dealt by keys where they take more tasks than Spark would give them; others stay, so that a small table may meet them where they are."""
    return dealt(df, size, *keys) if size > TASK_BYTES * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def pagerank(nodes: DataFrame, relations: DataFrame, damping: float = 0.85, iterations: int = 100, tolerance: float | None = 1e-6) -> DataFrame:
    """``node, score``; multiple relations weigh, dangling mass is spread evenly.

    Relations with unknown ends are dropped first.  Each iteration is one join and one
    aggregation over the relations, written to the shared folder; with ``tolerance``
    None all iterations run.  Tasks are as many as the relations take, so that none of
    them grows with the table.
    """
    nodes = written(nodes.select("node").distinct(), "pagerank-nodes")
    n = nodes.count()
    if not n:
        return nodes.withColumn("score", F.lit(0.0))
    known = nodes.select(F.col("node").alias("src")), nodes.select(F.col("node").alias("dst"))
    edges = written(relations.select("src", "dst"), "pagerank-relations")
    count = edges.count()
    into = _wide(edges, 100 * count, "dst").join(known[1], "dst", "left_semi")
    # Grouped, met and summed up by the source in one place: a row is in a hash table and in two sorts.
    met = dealt(into, 340 * count, "src").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("w")).join(known[0], "src", "left_semi")
    shares = written(met.select("src", "dst", (F.col("w") / F.sum("w").over(Window.partitionBy("src"))).alias("share")), "pagerank-shares")
    forget(edges)
    rank, before = nodes.withColumn("score", F.lit(1.0 / n)), None
    for _ in range(iterations):
        got = _wide(shares, 200 * count, "src").join(rank, F.col("src") == rank["node"]).groupBy("dst").agg(F.sum(F.col("share") * F.col("score")).alias("got"))
        now = written(rank.join(got, rank["node"] == got["dst"], "left").select("node", F.col("score").alias("old"), F.coalesce("got", F.lit(0.0)).alias("got")), "pagerank")
        # What was not handed on is the dangling mass; ranks sum up to 1.
        base = (1 - damping) / n + damping * max(0.0, 1 - now.agg(F.sum("got")).first()[0]) / n
        if before is not None:
            forget(before)
        before = now
        new = F.lit(base) + damping * F.col("got")
        rank = now.select("node", new.alias("score"))
        if tolerance is not None and now.agg(F.sum(F.abs(new - F.col("old")))).first()[0] < tolerance:
            return rank
    return rank


def hits(nodes: DataFrame, relations: DataFrame, iterations: int = 20) -> DataFrame:
    """``node, hub, authority``: authorities from hubs, hubs from the new authorities, then both of length 1."""
    nodes = written(nodes.select("node").distinct(), "hits-nodes")
    edges = written(relations.select("src", "dst"), "hits-edges")
    now = nodes.withColumn("hub", F.lit(1.0))
    for _ in range(iterations):
        auth = edges.join(now, edges["src"] == now["node"]).groupBy("dst").agg(F.sum("hub").alias("authority")).select(F.col("dst").alias("node"), "authority")
        hub = edges.join(auth, edges["dst"] == auth["node"]).groupBy("src").agg(F.sum("authority").alias("hub")).select(F.col("src").alias("node"), "hub")
        both = nodes.join(auth, "node", "left").join(hub, "node", "left").fillna(0.0)
        both = written(both, "hits")
        a, h = both.agg(F.sqrt(F.sum(F.col("authority") ** 2)), F.sqrt(F.sum(F.col("hub") ** 2))).first()
        now = both.select("node", (F.col("hub") / (h or 1.0)).alias("hub"), (F.col("authority") / (a or 1.0)).alias("authority"))
    return now


def connected_components(nodes: DataFrame, relations: DataFrame) -> DataFrame:
    """``node, component`` (the least node reached), undirected, isolated nodes by themselves.

    Each round takes the least label of the neighbours and then the label of that label,
    so chains halve each time; the rounds end when nothing changes.
    """
    edges = written(adjacency(relations, "both").distinct(), "component-edges")
    now = written(nodes.select("node").distinct().withColumn("component", F.col("node")), "components")
    while True:
        near = edges.join(now, edges["other"] == now["node"]).groupBy(edges["node"].alias("at")).agg(F.min("component").alias("near"))
        step = now.join(near, now["node"] == near["at"], "left").select("node", "component", F.least("component", F.coalesce("near", "component")).alias("new"))
        jump = step.select(F.col("node").alias("of"), F.col("new").alias("further"))
        new = written(step.join(jump, step["new"] == jump["of"], "left").select("node", "component", F.least("new", F.coalesce("further", "new")).alias("new")), "components")
        if new.filter("new <> component").isEmpty():
            return now
        now = new.select("node", F.col("new").alias("component"))


def later_neighbours(relations: DataFrame) -> DataFrame:
    """``node, later``: distinct neighbours, undirected, that come after a node in the order by degree and name, in this order.

    A list is no longer than the square root of twice the number of relations; the last of
    all have none and no row.
    """
    e = relations.filter("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    degree = e.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("d"))
    a, b = (degree.select(F.col("node").alias(x), F.struct(F.col("d"), F.col("node").alias("name")).alias(f"at_{x}")) for x in "ab")
    met = e.join(a, "a").join(b, "b").select(F.least("at_a", "at_b").alias("low"), F.greatest("at_a", "at_b").alias("high"))
    lists = met.groupBy(F.col("low.name").alias("node")).agg(F.array_sort(F.collect_list("high")).alias("later"))
    return lists.select("node", F.transform("later", lambda x: x["name"]).alias("later"))


def common_later(lists: DataFrame) -> DataFrame:
    """``node, other, common`` of each later neighbour ``other`` of a node: the later neighbours of both, if there are any.

    So every triangle is at its lowest node and its middle one.  Lists meet, not pairs of
    their nodes, so a row for each relation is shuffled and not one for each two relations.
    """
    each = lists.select("node", F.posexplode("later").alias("i", "other"), F.size("later").alias("n"), "later").filter("i + 1 < n")
    rest = each.select("node", "other", F.slice("later", F.col("i") + 2, F.col("n")).alias("rest"))
    theirs = lists.select(F.col("node").alias("other"), F.col("later").alias("theirs"))
    n = F.size("later").cast("bigint")
    size = lists.agg(F.coalesce(F.sum(64 * n + 4 * n * n), F.lit(0))).first()[0]
    return dealt(rest, size, "other").join(theirs, "other").select("node", "other", F.array_intersect("rest", "theirs").alias("common")).filter(F.size("common") > 0)


def triangles(relations: DataFrame) -> DataFrame:
    """``a, b, c`` with a < b < c, undirected, each found once: at its node of least degree."""
    found = common_later(written(later_neighbours(relations), "later-neighbours"))
    each = found.select("node", "other", F.explode("common").alias("third"))
    s = F.array_sort(F.array("node", "other", "third"))
    return each.select(s[0].alias("a"), s[1].alias("b"), s[2].alias("c"))


def modularity(relations: DataFrame, communities: DataFrame) -> DataFrame:
    """One row, ``modularity``, of an assignment (node, community) on undirected relations."""
    c1 = communities.select(F.col("node").alias("src"), F.col("community").alias("cs"))
    c2 = communities.select(F.col("node").alias("dst"), F.col("community").alias("cd"))
    e = relations.filter("src <> dst").join(c1, "src").join(c2, "dst")
    m = e.agg(F.count(F.lit(1)).alias("m"))
    inside = e.filter("cs = cd").groupBy(F.col("cs").alias("c")).agg(F.count(F.lit(1)).alias("l"))
    degree = e.select(F.explode(F.array("cs", "cd")).alias("c")).groupBy("c").agg(F.count(F.lit(1)).alias("d"))
    parts = degree.join(inside, "c", "left").crossJoin(F.broadcast(m))
    return parts.agg(F.round(F.sum(F.coalesce("l", F.lit(0)) / F.col("m") - (F.col("d") / (2 * F.col("m"))) ** 2), 6).alias("modularity"))


def ancestors(parents: DataFrame, node: str, max_depth: int = 50) -> DataFrame:
    """``node, depth`` of all ancestors (column ``parent`` of each ``node``); cycles end the walk."""
    edges = parents.select(F.col("node").alias("src"), F.col("parent").alias("dst")).filter("dst is not null")
    start = parents.sparkSession.createDataFrame([(node,)], "node string")
    return bfs(edges, start, max_depth, "outgoing").filter("depth > 0")


def descendants(parents: DataFrame, node: str, max_depth: int = 50) -> DataFrame:
    """``node, depth`` of all descendants."""
    edges = parents.select(F.col("parent").alias("src"), F.col("node").alias("dst")).filter("src is not null")
    start = parents.sparkSession.createDataFrame([(node,)], "node string")
    return bfs(edges, start, max_depth, "outgoing").filter("depth > 0")


def orphaned_relations(relations: DataFrame, nodes: DataFrame) -> DataFrame:
    """Relations with an end that is no node."""
    a, b = nodes.select(F.col("node").alias("src")), nodes.select(F.col("node").alias("dst"))
    return relations.join(a, "src", "left_anti").unionByName(relations.join(a, "src", "left_semi").join(b, "dst", "left_anti"))


def isolated_nodes(nodes: DataFrame, relations: DataFrame) -> DataFrame:
    return nodes.join(relations.select(F.explode(F.array("src", "dst")).alias("node")).distinct(), "node", "left_anti")


def path_scores(paths: DataFrame, strengths: DataFrame) -> DataFrame:
    """``path, score``: the product of the causal strengths (src, dst, strength) along each path."""
    steps = paths.withColumn("id", F.monotonically_increasing_id()).select("id", "path", F.posexplode(F.transform(F.sequence(F.lit(1), F.size("path") - 1), lambda i: F.struct(F.element_at("path", i).alias("src"), F.element_at("path", i + 1).alias("dst")))).alias("at", "e"))
    met = steps.select("id", "path", F.col("e.src").alias("src"), F.col("e.dst").alias("dst")).join(strengths, ["src", "dst"], "left")
    return met.groupBy("id").agg(F.first("path").alias("path"), F.round(F.product(F.coalesce("strength", F.lit(1.0))), 6).alias("score")).drop("id")


def stats(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """``metric, key, n, first_ts, last_ts``: entities and relations by type, the oldest and the newest entity.

    Entities without a time count, but are neither oldest nor newest; ties go by name.
    """
    none = F.lit(None).cast(entities.schema["ts"].dataType)
    of_type = entities.groupBy(F.col("entity_type").alias("key")).agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    kinds = relations.groupBy(F.col("relation_type").alias("key")).agg(F.count(F.lit(1)).alias("n")).select("key", "n", none.alias("first_ts"), none.alias("last_ts"))
    ends = entities.filter("ts is not null").agg(F.min(F.struct("ts", "name")).alias("oldest"), F.max(F.struct("ts", "name")).alias("newest"))
    end = lambda c: ends.select(F.lit(c).alias("metric"), F.col(f"{c}.name").alias("key"), F.lit(1).cast("bigint").alias("n"), F.col(f"{c}.ts").alias("first_ts"), F.col(f"{c}.ts").alias("last_ts"))
    rows = of_type.select(F.lit("entities").alias("metric"), "*").unionByName(kinds.select(F.lit("relations").alias("metric"), "*"))
    return rows.unionByName(end("oldest")).unionByName(end("newest"))


def latest_by(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in an order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def betweenness(nodes: DataFrame, relations: DataFrame) -> DataFrame:
    """``node, score``: shortest-path dependencies of all sources, by 2 / ((n - 1) (n - 2)) over ordered pairs.

    Relations count in both directions, repeated ones as paths of their own, self-loops and
    null ends not at all; ends that are no node pass paths on but get no score.  All sources
    step together: a level holds ``source, node, paths`` and is written, the next one is a
    join with the relations, and what it meets again can only be in the last two levels.
    The way back sums dependencies level by level.  The work is that of one search for each node.
    """
    names = nodes.select("node").filter("node is not null").distinct()
    n = names.count()
    both = relations.select("src", "dst").unionByName(relations.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    edges = written(both.filter("src <> dst"), "edges")
    levels = [written(names.select(F.col("node").alias("source"), "node", F.lit(1.0).alias("paths")), "level")]
    while True:
        met = levels[-1].join(edges, F.col("node") == F.col("src")).groupBy("source", F.col("dst").alias("node")).agg(F.sum("paths").alias("paths"))
        for known in levels[-2:]:
            met = met.join(known.select("source", "node"), ["source", "node"], "left_anti")
        new = written(met, "level")
        if new.isEmpty():
            forget(new)
            break
        levels.append(new)
    total = None
    shares = [levels[-1].withColumn("share", F.lit(0.0))]
    for level in reversed(levels[:-1]):
        back = shares[-1].join(edges, F.col("node") == F.col("src")).groupBy("source", F.col("dst").alias("node")).agg(F.sum((1 + F.col("share")) / F.col("paths")).alias("back"))
        shares.append(written(level.join(back, ["source", "node"], "left").select("source", "node", "paths", (F.col("paths") * F.coalesce("back", F.lit(0.0))).alias("share")), "shares"))
    for share in shares:
        own = share.filter("source <> node").groupBy("node").agg(F.sum("share").alias("raw"))
        total = own if total is None else total.unionByName(own)
    scale = 2 / ((n - 1) * (n - 2)) if n > 2 else 0.0
    score = names.join(total.groupBy("node").agg(F.sum("raw").alias("raw")), "node", "left").select("node", F.round(F.coalesce("raw", F.lit(0.0)) * scale, 6).alias("score"))
    out = written(score, "betweenness")
    for old in (edges, *levels, *shares[1:]):
        forget(old)
    return out
