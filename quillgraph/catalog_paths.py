"""Queries of communities, cliques, chains and evidence paths over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .catalog import _geo_nodes, query
from .operators import chains, cliques, communities, evidence
from .sources.views import geo_relations, table


@query()
def louvain_communities(spark: SparkSession, d: str) -> DataFrame:
    return communities.louvain(_geo_nodes(spark, d), geo_relations(spark, d))[0]


#: Customers whose orders have keys at most two apart.
NEAR_SQL = "SELECT DISTINCT a.o_custkey AS a, b.o_custkey AS b FROM orders a JOIN orders b ON a.o_orderkey <> b.o_orderkey AND abs(a.o_orderkey - b.o_orderkey) <= 2 WHERE a.o_custkey <> b.o_custkey"


@query(f"""
    WITH RECURSIVE e AS MATERIALIZED ({NEAR_SQL}),
         g(clique) AS (SELECT [a, b] FROM e WHERE a < b
                       UNION ALL SELECT list_append(clique, e.b) FROM g JOIN e ON e.a = g.clique[len(g.clique)] AND e.b > e.a
                       WHERE (SELECT count(*) FROM e x WHERE x.b = e.b AND list_contains(g.clique, x.a)) = len(g.clique)),
         u AS (SELECT unnest(clique) AS v, clique FROM g),
         more AS (SELECT DISTINCT clique FROM (SELECT clique, e.b FROM u JOIN e ON e.a = u.v GROUP BY clique, e.b HAVING count(*) = len(clique)))
    SELECT array_to_string(clique, '-') AS clique, CAST(len(clique) AS INTEGER) AS size FROM g WHERE len(clique) >= 3 AND clique NOT IN (SELECT clique FROM more)""")
def maximal_cliques(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    near = o.select(F.explode(F.array(F.col("o_orderkey") + 1, F.col("o_orderkey") + 2)).alias("key"), F.col("o_custkey").alias("src"))
    relations = near.join(o, near["key"] == o["o_orderkey"]).select("src", F.col("o_custkey").alias("dst"))
    return cliques.maximal_cliques(relations, 3).select(F.array_join("clique", "-").alias("clique"), "size")


@query("""
    WITH o AS (SELECT o_orderkey AS k, o_custkey AS c, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders)
    SELECT a.k AS start, a.n - b.n AS place, b.k AS node FROM o a JOIN o b ON a.c = b.c AND b.n < a.n""")
def supersession_chains(spark: SparkSession, d: str) -> DataFrame:
    """Every order and all that it supersedes: its customer's earlier ones, nearest first."""
    before = F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    return chains.chains(table(spark, d, "orders").select(F.col("o_orderkey").alias("node"), before.alias("next")))


@query("""
    WITH e AS (SELECT event_id, user_id, event_type, event_type || ' ' || event_id AS content, row_number() OVER w AS n,
                      CASE WHEN ts - lag(ts) OVER w <= INTERVAL 1 DAY THEN 0 ELSE 1 END AS begins FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
         s AS (SELECT *, max(CASE WHEN begins = 1 THEN n END) OVER (PARTITION BY user_id ORDER BY n) AS first FROM e),
         l AS (SELECT *, least(n - first, 5) AS length FROM s)
    SELECT l.event_id AS node, CASE WHEN l.length > 0 THEN CAST(r.event_id AS VARCHAR) ELSE '' END AS root, l.length AS length,
           'Failure: ' || l.content || CASE WHEN l.length > 0 THEN ' (root cause: ' || r.content || ')' ELSE '' END AS description,
           CASE WHEN l.length > 0 THEN 'To prevent "' || l.content || '", address root cause: "' || r.content || '"' ELSE 'Avoid: ' || l.content END AS lesson
    FROM l JOIN l r ON r.user_id = l.user_id AND r.n = l.n - l.length WHERE l.event_type = 'error'""")
def failure_lessons(spark: SparkSession, d: str) -> DataFrame:
    """Errors and their chains of causes: the user's event before, if it was within a day."""
    e = table(spark, d, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    near = F.col("ts") - F.lag("ts").over(w) <= F.expr("interval '1' day")
    causes = e.select(F.col("event_id").alias("src"), F.when(near, F.lag("event_id").over(w)).alias("dst"), F.lit("caused_by").alias("relation_type"), F.lit(0).alias("ord")).filter("dst is not null")
    content = e.select(F.col("event_id").alias("node"), F.concat_ws(" ", "event_type", "event_id").alias("content"))
    failures = e.filter("event_type = 'error'").select(F.col("event_id").alias("node"))
    found = chains.failure_lessons(failures, content, chains.first_links(causes, "caused_by"), 5)
    return found.withColumn("root", F.coalesce(F.col("root").cast("string"), F.lit("")))


@query("""
    WITH x AS (SELECT 'c' || c_custkey AS result, c_nationkey AS n FROM customer UNION ALL SELECT 's' || s_suppkey, s_nationkey FROM supplier),
         a AS (SELECT 'r' || r_regionkey AS anchor, CAST(r_regionkey AS DOUBLE) AS score, r_regionkey AS r, NULL AS n, r_regionkey AS ord FROM region
               UNION ALL SELECT 'n' || n_nationkey, n_nationkey / 5.0, n_regionkey, n_nationkey, 1000 + n_nationkey FROM nation),
         z AS (SELECT max({'s': -score, 'o': ord}) AS last FROM a),
         m AS (SELECT result, anchor, score, ord, CASE WHEN a.n IS NULL THEN [anchor, 'n' || x.n, result] WHEN a.n = x.n THEN [anchor, result] ELSE [anchor, 'r' || a.r, 'n' || x.n, result] END AS nodes,
                      row_number() OVER (PARTITION BY result ORDER BY score DESC, ord) AS rank
               FROM x JOIN nation ON x.n = n_nationkey JOIN a ON a.r = n_regionkey),
         k AS (SELECT result, count(*) AS n, max({'s': -score, 'o': ord}) AS last FROM m WHERE rank <= 3 GROUP BY result)
    SELECT m.result, CAST(rank AS INTEGER) AS rank, anchor, array_to_string(nodes, '>') AS nodes, k.n >= 3 AND k.last < z.last AS truncated FROM m JOIN k USING (result), z WHERE rank <= 3""")
def evidence_paths(spark: SparkSession, d: str) -> DataFrame:
    """How customers and suppliers hang together with regions and nations."""
    r, n = table(spark, d, "region"), table(spark, d, "nation")
    place = F.concat(F.lit("r"), F.col("r_regionkey").cast("string")), F.concat(F.lit("n"), F.col("n_nationkey").cast("string"))
    anchors = r.select(place[0].alias("name"), F.col("r_regionkey").cast("double").alias("score"), F.lit("semantic").alias("via"), F.col("r_regionkey").cast("long").alias("ord")).unionByName(
        n.select(place[1].alias("name"), (F.col("n_nationkey") / 5.0).alias("score"), F.lit("lexical").alias("via"), (F.col("n_nationkey") + 1000).cast("long").alias("ord"))
    )
    relations = geo_relations(spark, d).withColumn("ord", F.xxhash64("src"))
    results = _geo_nodes(spark, d).select(F.col("node").alias("name")).filter("name like 'c%' or name like 's%'")
    paths, flags = evidence.evidence_paths(relations, results, anchors)
    return paths.join(flags, "result").select("result", "rank", "anchor", F.array_join("nodes", ">").alias("nodes"), "truncated")
