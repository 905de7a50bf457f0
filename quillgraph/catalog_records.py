"""Queries over memory records, events and roles, each with its DuckDB twin."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .catalog import ALNUM_SQL, JACCARD_SQL, NOW, query
from .functions import scoring
from .operators import records
from .plans import time_phrases
from .sources.views import table


@query(f"WITH s AS (SELECT user_id, max(ts) AS last_seen FROM events GROUP BY user_id) SELECT user_id FROM s WHERE last_seen < TIMESTAMP '{NOW}' - INTERVAL 36 HOUR")
def stale_sessions(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "events").groupBy("user_id").agg(F.max("ts").alias("last_seen"))
    return s.filter(records.stale(F.col("last_seen"), NOW, "36 hours")).select("user_id")


@query("SELECT o_custkey AS session, o_orderkey AS plan FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders WHERE o_orderstatus = 'O') WHERE n = 1")
def active_plan(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").filter("o_orderstatus = 'O'")
    return records.newest(o, "o_custkey", F.desc("o_orderdate"), F.desc("o_orderkey")).select(F.col("o_custkey").alias("session"), F.col("o_orderkey").alias("plan"))


@query("""
    WITH RECURSIVE o AS (SELECT CAST(o_orderkey AS VARCHAR) AS id, CAST(lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS VARCHAR) AS previous FROM orders WHERE o_custkey = 7),
    last AS (SELECT CAST(o_orderkey AS VARCHAR) AS id FROM orders WHERE o_custkey = 7 ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1),
    w(id, steps) AS (SELECT id, 0 FROM last UNION ALL SELECT o.previous, w.steps + 1 FROM w JOIN o ON o.id = w.id WHERE o.previous IS NOT NULL) SELECT id, steps FROM w""")
def decision_chain(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").filter("o_custkey = 7")
    before = F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    r = o.select(F.col("o_orderkey").cast("string").alias("id"), before.cast("string").alias("previous"))
    last = o.orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).first()
    return records.chain(r, str(last["o_orderkey"]) if last else "")


@query(r"""
    WITH t AS (SELECT item_id AS ord, text, regexp_split_to_array(text, '\s+') AS w FROM benchmark)
    SELECT ord, round(0.25 * (least(1, length(text) / 80) + least(1, 0.3 * len(list_filter(w[2:], lambda x: regexp_matches(x, '^[A-Z][a-z]'))))
      + CASE WHEN regexp_matches(text, '\d') THEN 0.4 ELSE 0 END + CASE WHEN regexp_matches(text, '(?i)\d{4}[-/]\d{1,2}[-/]\d{1,2}|\b(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\b') THEN 0.4 ELSE 0 END
      + CASE WHEN contains(lower(text), 'tion') THEN 0.6 ELSE 0 END), 6) AS score FROM t""")
def observation_score(spark: SparkSession, d: str) -> DataFrame:
    score = records.observation_score(F.col("text"), F.contains(F.lower("text"), F.lit("tion")))
    return table(spark, d, "benchmark").select(F.col("item_id").alias("ord"), F.round(score, 6).alias("score"))


@query("SELECT event_id FROM events WHERE value >= 50 AND event_type = 'purchase' AND user_id % 3 >= 1")
def rule_eval(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").filter(records.rules_pass([F.col("value") >= 50, F.col("event_type") == "purchase", F.col("user_id") % 3 >= 1])).select("event_id")


@query("SELECT p_partkey AS ord, CASE WHEN p_size % 7 = 0 THEN 100.0 ELSE 0 END + CASE WHEN p_size / 50.0 >= 0.8 AND p_partkey % 5 >= 2 THEN p_size / 50.0 * 50 + p_partkey % 5 * 10 + p_partkey % 9 ELSE 0 END AS priority FROM part WHERE p_size % 7 = 0 OR (p_size / 50.0 >= 0.8 AND p_partkey % 5 >= 2)")
def promotion_candidates(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    priority = records.promotion_priority(F.col("p_size") % 7 == 0, F.col("p_size") / 50.0, F.col("p_partkey") % 5, F.col("p_partkey") % 9)
    return p.select(F.col("p_partkey").alias("ord"), priority.alias("priority")).filter("priority is not null")


@query("SELECT p_partkey AS ord, round(0.6 * (p_size / 50.0) + 0.3 * (1 - 1 / (1 + (p_partkey % 5) / 5)) - 0.1 * least(0.3, (p_partkey % 90) / 300), 6) AS reliability FROM part")
def reliability(spark: SparkSession, d: str) -> DataFrame:
    r = scoring.reliability(F.col("p_size") / 50.0, F.col("p_partkey") % 5, F.col("p_partkey") % 90)
    return table(spark, d, "part").select(F.col("p_partkey").alias("ord"), F.round(r, 6).alias("reliability"))


@query(f"WITH h AS (SELECT p_partkey AS id, round({JACCARD_SQL.format('list_distinct(' + ALNUM_SQL.format('p_name') + ')', chr(91) + chr(39) + 'small' + chr(39) + ', ' + chr(39) + 'ring' + chr(39) + chr(93))} * (p_size / 50.0), 6) AS score FROM part) SELECT id, score FROM h WHERE score >= 0.1")
def heuristic_match(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("condition"), (F.col("p_size") / 50.0).alias("confidence"))
    return records.heuristic_matches(h, "Small ring")


ROLES = [("reader", "read"), ("writer", "read"), ("writer", "write")]


@query("""
    WITH q AS (SELECT event_id AS request, user_id AS agent, CASE WHEN event_type = 'purchase' THEN 'write' ELSE 'read' END AS permission, 'area' || (event_id % 3) || '/x' AS resource, ts FROM events),
         a AS (SELECT DISTINCT user_id AS agent, CASE WHEN user_id % 2 = 0 THEN 'writer' ELSE 'reader' END AS role, 'area' || (user_id % 3) AS scope FROM events WHERE user_id % 5 <> 0),
         r AS (SELECT request, role, permission FROM q JOIN a USING (agent) WHERE starts_with(resource, scope) UNION ALL SELECT request, 'reader', permission FROM q WHERE agent NOT IN (SELECT agent FROM a))
    SELECT event_id AS request, event_id IN (SELECT request FROM r WHERE role = 'writer' OR permission = 'read') AS allowed FROM events""")
def rbac_check(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    requests = e.select(F.col("event_id").alias("request"), F.col("user_id").alias("agent"), F.when(F.col("event_type") == "purchase", "write").otherwise("read").alias("permission"), F.format_string("area%d/x", F.col("event_id") % 3).alias("resource"), F.col("ts").alias("at"))
    held = e.filter("user_id % 5 <> 0").select(F.col("user_id").alias("agent"), F.when(F.col("user_id") % 2 == 0, "writer").otherwise("reader").alias("role"), F.format_string("area%d", F.col("user_id") % 3).alias("scope"), F.lit(None).cast("timestamp_ntz").alias("expires")).distinct()
    matrix = spark.createDataFrame(ROLES, "role string, permission string")
    return records.role_allows(requests, held, F.broadcast(matrix), "reader")


@query("SELECT doc_id FROM documents WHERE source = 'src1' OR lang = 'fr' OR (lang = 'de' AND doc_id % 3 = 1) OR (lang = 'es' AND doc_id % 4 IN (1, 2))")
def visibility(spark: SparkSession, d: str) -> DataFrame:
    return _shared_documents(spark, d).filter(records.visible("src1", "1", ["1", "2"])).select("doc_id")


def _shared_documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(
        "doc_id", F.col("source").alias("owner"), F.when(F.col("lang") == "fr", "public").when(F.col("lang") == "de", "org").when(F.col("lang") == "es", "team").otherwise("private").alias("visibility"),
        (F.col("doc_id") % 3).cast("string").alias("org"), (F.col("doc_id") % 4).cast("string").alias("team"),
    )


@query("SELECT doc_id FROM documents WHERE NOT (contains(lower(coalesce(text, '')), 'idiot') OR contains(lower(coalesce(text, '')), 'disgusting'))")
def exclusion_rules(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").filter(~records.excluded(F.col("text"), ["Idiot", "disgusting"])).select("doc_id")


@query("WITH r AS (SELECT DISTINCT l_suppkey AS src, l_partkey AS dst FROM lineitem) SELECT a.src AS a, a.dst AS b FROM r a JOIN r b ON a.src = b.dst AND a.dst = b.src WHERE a.src < a.dst")
def inverse_relations(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    return records.inverse_pairs(li.select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst")))


@query("WITH x AS (SELECT user_id, event_id, CASE WHEN event_id % 97 = 0 THEN 'x' ELSE sha256(CAST(lag(event_id) OVER w AS VARCHAR)) END AS prev_hash, sha256(CAST(lag(event_id) OVER w AS VARCHAR)) AS want FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) SELECT event_id FROM x WHERE want IS NOT NULL AND prev_hash IS DISTINCT FROM want")
def audit_chain(spark: SparkSession, d: str) -> DataFrame:
    line = F.col("event_id").cast("string")
    before = F.lag(F.sha2(line, 256)).over(Window.partitionBy("user_id").orderBy("event_id"))
    log = table(spark, d, "events").select(F.col("user_id").alias("shard"), "event_id", F.when(F.col("event_id") % 97 == 0, "x").otherwise(before).alias("prev_hash"))
    return records.broken_links(log, "event_id", line).select("event_id")


@query("SELECT event_id FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-27 12:00:00' AND TIMESTAMP '2024-01-30 12:00:00'")
def time_phrase_search(spark: SparkSession, d: str) -> DataFrame:
    start, end = time_phrases.parse("last 3 days", datetime(2024, 1, 30, 12))
    return table(spark, d, "events").filter(F.col("ts").between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz"))).select("event_id")


@query("SELECT lang, source, count(*) AS n, count(DISTINCT length(text)) AS sizes FROM documents GROUP BY lang, source")
def type_project_list(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.length("text")).alias("sizes"))


@query("SELECT doc_id FROM documents WHERE (source = 'src1' OR lang = 'fr' OR (lang = 'de' AND doc_id % 3 = 1) OR (lang = 'es' AND doc_id % 4 IN (1, 2))) AND (source = 'src2' OR lang = 'fr' OR (lang = 'de' AND doc_id % 3 = 1) OR (lang = 'es' AND doc_id % 4 = 2))")
def visible_to_all(spark: SparkSession, d: str) -> DataFrame:
    docs = _shared_documents(spark, d)
    return docs.filter(records.visible("src1", "1", ["1", "2"]) & records.visible("src2", "1", ["2"])).select("doc_id")


@query("SELECT doc_id AS ord, sha256(text) AS content_hash FROM documents WHERE sha256(text) IN (SELECT sha256(text) FROM documents WHERE doc_id % 50 = 0)")
def content_hash_lookup(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("ord"), F.sha2("text", 256).alias("content_hash"))
    return docs.join(docs.filter("ord % 50 = 0").select("content_hash").distinct(), "content_hash", "left_semi").select("ord", "content_hash")
