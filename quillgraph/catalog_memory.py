"""Queries over changes, filters, scores and memory records, each with its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import ALNUM_SQL, GEO_SQL, NOW, SUPPLY_SQL, query
from .operators import access, dedup, graph, memory, mutate
from .sources import graph_io
from .sources.views import document_entities, geo_relations, part_entities, supply_relations, table

ORDER_E = "SELECT o_orderkey AS ord, CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_orderkey % 11 AS DOUBLE) END AS importance, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderdate END AS created_at, CASE WHEN o_orderkey % 3 = 0 THEN FALSE WHEN o_orderkey % 3 = 1 THEN TRUE END AS is_latest, CASE o_orderstatus WHEN 'O' THEN NULL WHEN 'F' THEN 'published' ELSE 'draft' END AS status, o_orderpriority AS entity_type FROM orders"


def _orders(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("o_orderkey")
    return table(spark, d, "orders").select(
        key.alias("ord"), F.when(key % 7 != 0, (key % 11).cast("double")).alias("importance"), F.when(key % 5 != 0, F.col("o_orderdate")).alias("created_at"), F.col("o_orderdate").alias("modified_at"),
        F.when(key % 3 == 0, False).when(key % 3 == 1, True).alias("is_latest"), F.when(F.col("o_orderstatus") == "F", "published").when(F.col("o_orderstatus") != "O", "draft").alias("status"),
        F.col("o_orderpriority").alias("entity_type"), F.array(F.lower("o_orderpriority")).alias("tags"), F.lit("p").alias("project_id"), F.when(key % 2 == 0, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>")).alias("observations"), F.col("o_custkey").cast("string").alias("parent"),
    )


@query(f"SELECT ord FROM ({ORDER_E}) WHERE importance BETWEEN 2 AND 9 AND created_at BETWEEN TIMESTAMP '1994-01-01' AND TIMESTAMP '1997-06-30' AND coalesce(is_latest, TRUE) AND coalesce(status, 'published') = 'published'")
def filter_chain_dates(spark: SparkSession, d: str) -> DataFrame:
    return _orders(spark, d).filter(memory.full_filter(least=2, most=9, created=("1994-01-01", "1997-06-30"))).select("ord")


@query(f"SELECT ord FROM ({ORDER_E}) WHERE coalesce(status, 'published') IN ('draft', 'published') AND lower(entity_type) IN ('1-urgent', '5-low')")
def filter_chain_lifecycle(spark: SparkSession, d: str) -> DataFrame:
    return _orders(spark, d).filter(memory.full_filter(tags=["1-URGENT", "5-low"], superseded=True, statuses=("draft", "published"))).select("ord")


@query(f"SELECT ord, 1.0::DOUBLE AS score FROM ({ORDER_E}) WHERE coalesce(importance, 5) BETWEEN 4 AND 6 AND created_at BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1996-12-31' AND ord % 2 = 0")
def symbolic_dates(spark: SparkSession, d: str) -> DataFrame:
    score = memory.full_symbolic(importance=(4, 6), dates=("1995-01-01", "1996-12-31"), observed=True)
    return _orders(spark, d).select("ord", score.alias("score")).filter("score is not null")


@query("SELECT doc_id AS ord FROM documents WHERE contains(lower(text), 'a_') OR contains(lower(source), 'a_') OR contains(lower(lang), 'a_') OR contains(CAST(doc_id AS VARCHAR), 'a_') OR contains(lower(text), 'src1') OR contains(lower(source), 'src1')")
def like_search(spark: SparkSession, d: str) -> DataFrame:
    docs = document_entities(spark, d)
    columns = [F.col("name"), F.col("entity_type"), F.col("observations")[0], F.col("tags")[0]]
    return docs.filter(memory.like_any("a_", *columns) | memory.like_any("SRC1", *columns)).select("ord")


@query("WITH t AS (SELECT unnest(['ther', 'en']) AS term), x AS (SELECT doc_id AS ord, term, contains(CAST(doc_id AS VARCHAR), term) AS in_name, coalesce(contains(lower(lang), term), FALSE) AS in_type, coalesce(contains(lower(text), term), FALSE) AS in_observations FROM documents, t) SELECT * FROM x WHERE in_name OR in_type OR in_observations")
def matched_fields(spark: SparkSession, d: str) -> DataFrame:
    return memory.matched_fields(document_entities(spark, d), ["ther", "en"])


@query("""
    WITH w AS (SELECT DISTINCT unnest(string_split(lower(p_name), ' ')) AS c FROM part), g AS (SELECT c, list_distinct(list_transform(range(1, length(c)), lambda i: substring(c, i, 2))) AS g, list_distinct(list_transform(range(1, 4), lambda i: substring('smal', i, 2))) AS q FROM w WHERE length(c) >= 2),
         s AS (SELECT c AS correction, levenshtein(c, 'smal') AS distance, round(1 - levenshtein(c, 'smal') / greatest(length(c), 4), 6) AS score FROM g WHERE len(list_intersect(g, q)) / len(list_distinct(list_concat(g, q))) >= 0.1)
    SELECT correction, score, CAST(distance AS INTEGER) AS distance FROM s WHERE distance <= 3 AND score >= 0.4 ORDER BY score DESC, distance, correction LIMIT 5""")
def spell_check(spark: SparkSession, d: str) -> DataFrame:
    return memory.spelling(table(spark, d, "part").select(F.explode(F.split(F.lower("p_name"), " ")).alias("word")), "word", "smal")


@query(r"WITH n AS (SELECT unnest(['tion', 'ther', 'der', 'und', 'erin']) AS name) SELECT doc_id AS ord, name FROM documents, n WHERE regexp_matches(text, '(?i)(?:^|\W)' || name || '(?:\W|$)')")
def mention_detection(spark: SparkSession, d: str) -> DataFrame:
    return memory.mentions(table(spark, d, "documents").withColumnRenamed("doc_id", "ord"), F.col("text"), ["tion", "ther", "der", "und", "erin", "x"])


@query("SELECT 's' || s_suppkey AS ref, CASE WHEN s_suppkey % 3 = 0 THEN s_name ELSE 's' || s_suppkey END AS name FROM supplier")
def alias_resolution(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("ref"), "s_suppkey", F.col("s_name").alias("name"))
    return memory.resolve_aliases(s.select("ref"), s.filter("s_suppkey % 3 = 0").select(F.col("ref").alias("alias"), "name"))


@query("SELECT ord, max(score) AS score FROM (SELECT doc_id AS ord, 1.0::DOUBLE AS score FROM documents WHERE lang = 'en' UNION ALL SELECT doc_id, 2.0 FROM documents WHERE source = 'src1') GROUP BY ord")
def layer_union(spark: SparkSession, d: str) -> DataFrame:
    docs = document_entities(spark, d)
    return memory.layer_union(docs.filter("entity_type = 'en'").select("ord", F.lit(1.0).alias("score")), docs.filter("project_id = 'src1'").select("ord", F.lit(2.0).alias("score")))


@query("SELECT conv_id, turn, role FROM conversations WHERE starts_with(role, 'us') ORDER BY turn DESC, conv_id LIMIT 20")
def session_scan(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").filter(F.startswith("role", F.lit("us"))).select("conv_id", "turn", "role").orderBy(F.desc("turn"), "conv_id").limit(20)


@query("""
    WITH o AS (SELECT 'c' || c_custkey AS name, array_to_string([lower(c_mktsegment)], ',') AS tags FROM customer WHERE c_custkey % 2 = 0),
         n AS (SELECT 'c' || c_custkey AS name, array_to_string(list_sort(list_distinct([lower(c_mktsegment), 'new'])), ',') AS tags FROM customer WHERE c_custkey % 3 = 0)
    SELECT * FROM o UNION ALL SELECT * FROM n WHERE name NOT IN (SELECT name FROM o)""")
def create_entities(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select("c_custkey", F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("name"), F.lower("c_mktsegment").alias("seg"), F.col("c_mktsegment").alias("raw"))
    old = c.filter("c_custkey % 2 = 0").select("name", F.array("seg").alias("tags"), F.lit(1).alias("created_at"))
    new = c.filter("c_custkey % 3 = 0").select("name", F.array("raw", F.lit("NEW"), F.lit("new")).alias("tags"), F.lit(2).alias("created_at"))
    new = new.unionByName(new.select("name", F.array(F.lit("late")).alias("tags"), F.lit(3).alias("created_at")))
    return memory.create_entities(old, new).select("name", F.array_join("tags", ",").alias("tags"))


@query("SELECT s_suppkey AS name, CASE WHEN s_suppkey % 2 = 0 AND s_suppkey % 4 = 0 THEN 'new' ELSE s_name END AS value, CASE WHEN s_suppkey % 2 = 0 AND (s_suppkey % 3 = 0 OR s_suppkey % 4 IN (0, 2) AND s_suppkey % 5 = 1) THEN s_suppkey % 5 + 1 ELSE s_suppkey % 5 END AS version, CASE WHEN s_suppkey % 2 = 1 THEN 'kept' WHEN s_suppkey % 3 = 0 OR s_suppkey % 5 = 1 THEN 'updated' ELSE 'conflict' END AS status FROM supplier".replace("CASE WHEN s_suppkey % 2 = 0 AND s_suppkey % 4 = 0 THEN 'new' ELSE s_name END", "CASE WHEN s_suppkey % 4 = 0 AND (s_suppkey % 3 = 0 OR s_suppkey % 5 = 1) THEN 'new' ELSE s_name END"))
def update_entities(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier")
    key = F.col("s_suppkey")
    old = s.select(key.alias("name"), F.col("s_name").alias("value"), (key % 5).alias("version"))
    changes = s.filter(key % 2 == 0).select(key.alias("name"), F.when(key % 4 == 0, F.lit("new")).alias("value"), F.when(key % 3 != 0, F.lit(1)).alias("expected"))
    return memory.update_entities(old, changes, "value")


@query(f"WITH {GEO_SQL} SELECT src, dst, relation_type FROM geo WHERE NOT (src IN ('n1', 'n2', 'c5') OR dst IN ('n1', 'n2', 'c5'))")
def delete_cascade(spark: SparkSession, d: str) -> DataFrame:
    rel = geo_relations(spark, d)
    nodes = rel.select(F.explode(F.array("src", "dst")).alias("name")).distinct()
    return mutate.without(nodes, rel, spark.createDataFrame([("n1",), ("n2",), ("c5",)], "name string"))[1].select("src", "dst", "relation_type")


@query(f"""
    WITH {GEO_SQL}, k AS (SELECT src AS node FROM geo UNION SELECT dst FROM geo), n AS (SELECT DISTINCT 'c' || o_custkey AS src, 'n' || (o_custkey % 30) AS dst, 'located_in' AS relation_type FROM orders)
    SELECT n.*, CASE WHEN src NOT IN (SELECT node FROM k) OR dst NOT IN (SELECT node FROM k) THEN 'dangling' WHEN EXISTS (SELECT 1 FROM geo g WHERE g.src = n.src AND g.dst = n.dst AND g.relation_type = n.relation_type) THEN 'existing' ELSE 'created' END AS status FROM n""")
def create_relations(spark: SparkSession, d: str) -> DataFrame:
    rel = geo_relations(spark, d)
    new = table(spark, d, "orders").select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("src"), F.concat(F.lit("n"), (F.col("o_custkey") % 30).cast("string")).alias("dst"), F.lit("located_in").alias("relation_type"))
    return memory.create_relations(rel, new, rel.select(F.explode(F.array("src", "dst")).alias("node")))


@query("SELECT p_partkey AS ord, array_to_string(list_filter(CASE WHEN p_type = p_name THEN [p_name] ELSE [p_name, p_type] END, lambda o: o <> 'small ring'), '|') AS observations FROM part")
def change_observations(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select(F.col("p_partkey").alias("ord"), F.array("p_name").alias("observations"), "p_type")
    return p.select("ord", F.array_join(memory.change_observations(p, F.array("p_type", "p_type"), F.array(F.lit("small ring"))), "|").alias("observations"))


@query("SELECT p_partkey AS ord, array_to_string(list_sort(list_distinct(list_filter(['seen', CASE lower(p_brand) WHEN 'brand#11' THEN 'prime' ELSE lower(p_brand) END], lambda t: t <> 'brand#12'))), ',') AS tags FROM part")
def change_tags(spark: SparkSession, d: str) -> DataFrame:
    return part_entities(spark, d).select("ord", F.array_join(memory.change_tags(["Seen"], ["BRAND#12"], {"Brand#11": "Prime"}), ",").alias("tags"))


@query("SELECT p_partkey AS ord FROM part WHERE p_name <> 'small ring'")
def forget_observation(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select(F.col("p_partkey").alias("ord"), F.array("p_name").alias("observations"))
    return memory.forget_observation(p, "small ring").select("ord")


@query("SELECT c_custkey AS ord, CASE WHEN NOT c_acctbal >= 0 THEN 'balance' WHEN c_mktsegment = 'BUILDING' THEN 'segment' END AS refused_by FROM customer")
def governance(spark: SparkSession, d: str) -> DataFrame:
    return memory.governed(table(spark, d, "customer"), balance=F.col("c_acctbal") >= 0, segment=F.col("c_mktsegment") != "BUILDING").select(F.col("c_custkey").alias("ord"), "refused_by")


@query("SELECT l_orderkey, l_linenumber, concat_ws(',', CASE WHEN NOT l_discount * 12 BETWEEN 0 AND 1 THEN 'weight' END, CASE WHEN NOT l_quantity / 40 BETWEEN 0 AND 1 THEN 'confidence' END, CASE WHEN o_orderdate > l_shipdate THEN 'validity' END) AS issues, o_orderdate <= TIMESTAMP '1995-06-01' AND l_shipdate >= TIMESTAMP '1995-06-01' AS current FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def relation_checks(spark: SparkSession, d: str) -> DataFrame:
    li, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    rel = li.join(o, li["l_orderkey"] == o["o_orderkey"]).select("l_orderkey", "l_linenumber", (F.col("l_discount") * 12).alias("weight"), (F.col("l_quantity") / 40).alias("confidence"), F.col("o_orderdate").alias("valid_from"), F.col("l_shipdate").alias("valid_until"))
    return memory.relation_checks(rel, "1995-06-01").select("l_orderkey", "l_linenumber", F.array_join("issues", ",").alias("issues"), "current")


@query("""
    WITH m AS (SELECT l_orderkey AS ord, l_partkey AS content, l_linenumber AS line, l_shipdate AS u FROM lineitem WHERE l_linenumber % 2 = 1), k AS (SELECT ord, content, max_by(u, {'line': line, 'u': u}) AS u FROM m GROUP BY ord, content)
    SELECT DISTINCT l_orderkey AS ord, l_partkey AS content FROM lineitem LEFT JOIN k ON l_orderkey = ord AND l_partkey = content WHERE u IS NULL OR u >= TIMESTAMP '1996-01-01'""")
def observation_asof(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("ord"), F.col("l_partkey").alias("content"), F.col("l_linenumber").alias("line"), F.lit(None).cast("timestamp_ntz").alias("valid_from"), F.col("l_shipdate").alias("valid_until"))
    return memory.observations_asof(li.select("ord", "content").distinct(), li.filter("line % 2 = 1"), "1996-01-01")


AGE_SQL = f"greatest(0, (epoch_us(TIMESTAMP '{NOW}') - epoch_us(ts)) / 1000000)"


@query(f"SELECT event_id, round((1 + (event_id % 11) / 10 * 2) * exp(-1e-6 * {AGE_SQL}) * exp(-1e-6 * {AGE_SQL}) + (CASE WHEN event_type = 'click' THEN 0.5 ELSE 0 END) * 0.35, 6) AS importance FROM events")
def prd_importance(spark: SparkSession, d: str) -> DataFrame:
    score = memory.prd_importance((F.col("event_id") % 11).cast("double"), F.col("ts"), F.lit(None).cast("timestamp_ntz"), F.col("event_type"), NOW, "Click here")
    return table(spark, d, "events").select("event_id", F.round(score, 6).alias("importance"))


@query(f"""
    WITH w AS (SELECT conv_id, turn, text, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')) AS w FROM conversations)
    SELECT conv_id, turn, CASE WHEN length(text) > 0 THEN least(10.0, floor((0.3 * least(1.0, log10(length(text)) / 4) + 0.4 * len(list_intersect(w, ['please', 'thanks'])) / 2 + 0.3 * CASE WHEN len(w) > 0 THEN len(list_intersect(w, ['the', 'of'])) / len(w) ELSE 0 END) * 10 + 0.5)) ELSE 0.0 END AS score FROM w""")
def turn_importance(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", memory.turn_importance(F.col("text"), ["please", "thanks"], "of the").alias("score"))


@query("SELECT p_partkey AS ord, score FROM (SELECT p_partkey, (3 * CAST(contains(lower(p_name), 'ring') AS INTEGER) + 2 * CAST(contains(lower(p_type), 'ring') AS INTEGER) + CAST(contains(lower(p_brand), 'ring') AS INTEGER) + 3 * CAST(contains(lower(p_name), 'brand#1') AS INTEGER) + 2 * CAST(contains(lower(p_type), 'brand#1') AS INTEGER) + CAST(contains(lower(p_brand), 'brand#1') AS INTEGER)) AS score FROM part) WHERE score > 0")
def failure_lookup(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("ord"), memory.failure_score("Ring a BRAND#1", F.col("p_name"), F.col("p_type"), F.col("p_brand")).alias("score")).filter("score > 0")


@query(f"""
    WITH t AS (SELECT p_partkey AS ord, list_distinct(list_filter(list_concat({ALNUM_SQL.format('p_name')}, {ALNUM_SQL.format('p_type')}), lambda w: length(w) >= 2)) AS w FROM part), s AS (SELECT ord, round(len(list_intersect(w, ['small', 'ring'])) / len(list_distinct(list_concat(w, ['small', 'ring']))), 6) AS score FROM t)
    SELECT ord, score FROM s WHERE score >= 0.2""")
def procedure_match(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("ord"), F.round(memory.procedure_score("a small ring", F.col("p_name"), F.array("p_type")), 6).alias("score")).filter("score >= 0.2")


@query("WITH r AS (SELECT user_id, CASE WHEN event_type <> 'error' THEN 1.0 ELSE 0 END AS ok, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) - 1 AS b FROM events) SELECT user_id, count(*) AS runs, round(sum(0.2 * 0.8 ** b * ok) + 0.5 * 0.8 ** count(*), 6) AS rate FROM r GROUP BY user_id")
def procedure_refinement(spark: SparkSession, d: str) -> DataFrame:
    return memory.success_rates(table(spark, d, "events"), "user_id", F.col("event_type") != "error", ["ts", "event_id"])


def _claims(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("l_orderkey")
    return table(spark, d, "lineitem").select(F.col("l_partkey").alias("subject"), (key * 10 + F.col("l_linenumber")).alias("ord"), F.col("l_shipdate").alias("ts"), F.col("l_discount").alias("confidence"), F.col("l_quantity").alias("confirmations"), F.element_at(F.array(*map(F.lit, memory.TRUST)), (key % 4 + 1).cast("int")).alias("trust"))


def _winner_sql(order: str) -> str:
    return f"SELECT l_partkey AS subject, l_orderkey * 10 + l_linenumber AS winner FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY {order}, l_orderkey * 10 + l_linenumber) AS n FROM lineitem) WHERE n = 1"


@query(_winner_sql("l_discount DESC"))
def conflict_confidence(spark: SparkSession, d: str) -> DataFrame:
    return memory.resolve_conflicts(_claims(spark, d), "subject", "highest_confidence")


@query(_winner_sql("l_quantity DESC"))
def conflict_confirmations(spark: SparkSession, d: str) -> DataFrame:
    return memory.resolve_conflicts(_claims(spark, d), "subject", "most_confirmations")


@query(_winner_sql("l_orderkey % 4 DESC"))
def conflict_trust(spark: SparkSession, d: str) -> DataFrame:
    return memory.resolve_conflicts(_claims(spark, d), "subject", "trust_level")


@query(f"WITH {SUPPLY_SQL}, e AS (SELECT src AS node FROM sup UNION ALL SELECT dst FROM sup WHERE dst <> src), k AS (SELECT node, count(*) AS degree FROM e GROUP BY node) SELECT node, degree, round(degree / (SELECT max(degree) FROM k), 6) AS share FROM k")
def degree_map(spark: SparkSession, d: str) -> DataFrame:
    return memory.degree_map(supply_relations(spark, d))


@query("SELECT user_id AS agent, event_type, count(*) AS accesses FROM events GROUP BY 1, 2")
def collaboration_stats(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy(F.col("user_id").alias("agent"), "event_type").agg(F.count(F.lit(1)).alias("accesses"))


@query("WITH s AS (SELECT user_id, event_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY event_id * 7919 % 10007, event_id) AS p FROM (SELECT *, CAST(strftime(ts, '%Y-%m-%d %H:%M:%S') AS TIMESTAMP) AS t FROM events WHERE event_id % 4 <> 0) e) SELECT event_id FROM s WHERE date_trunc('second', ts) < date_trunc('second', p)")
def temporal_disorder(spark: SparkSession, d: str) -> DataFrame:
    stamp = F.concat(F.lit("seen [T="), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit("] x"))
    obs = table(spark, d, "events").select("user_id", "event_id", F.when(F.col("event_id") % 4 != 0, stamp).otherwise(F.lit("none")).alias("text"))
    obs = obs.withColumn("place", F.struct(F.col("event_id") * 7919 % 10007, "event_id"))
    return memory.out_of_order(obs, "user_id", "place", "text").select("event_id")


@query("WITH g AS (SELECT *, CASE WHEN ts > lag(ts) OVER w + INTERVAL 6 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), k AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS no FROM g), c AS (SELECT user_id, CAST(no AS BIGINT) AS session_no, count(*) AS n FROM k GROUP BY 1, 2) SELECT user_id, session_no, n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY session_no DESC) AS b FROM c) WHERE b <= 2")
def recent_sessions(spark: SparkSession, d: str) -> DataFrame:
    return memory.last_sessions(table(spark, d, "events"), "user_id", "ts", "6 hours", 2)


@query("SELECT o_orderkey AS ord, CASE WHEN o_orderstatus <> 'O' THEN 'fired' WHEN o_orderdate + INTERVAL 365 DAY < TIMESTAMP '1997-01-01' THEN 'expired' WHEN o_orderdate <= TIMESTAMP '1997-01-01' THEN 'due' ELSE 'pending' END AS state FROM orders")
def prospective_due(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("ord"), F.when(F.col("o_orderstatus") == "O", "pending").otherwise("fired").alias("status"), F.col("o_orderdate").alias("fire_at"), (F.col("o_orderdate") + F.expr("interval 365 days")).alias("expires_at"))
    return memory.due(o, "1997-01-01").select("ord", "state")


@query(f"SELECT event_id FROM events WHERE event_type = 'click' AND CASE WHEN event_id % 5 <> 0 THEN ts END >= TIMESTAMP '{NOW}' - INTERVAL 10 DAY")
def artifacts_since(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", F.col("event_type").alias("artifact_type"), F.lit("t").alias("tool"), F.when(F.col("event_id") % 5 != 0, F.col("ts")).alias("created_at"))
    return memory.artifacts(e, "t", "click", "2024-01-22 00:00:00").select("event_id")


@query("SELECT s_suppkey AS ord, 'name ' || s_name AS fixed, 'nation ' || s_nationkey AS moving FROM supplier")
def profile_parts(spark: SparkSession, d: str) -> DataFrame:
    obs = F.array(F.concat(F.lit("static: name "), "s_name"), F.concat(F.lit("dynamic:nation "), F.col("s_nationkey").cast("string")), F.lit("other"))
    static, dynamic = memory.profile_parts(obs)
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("ord"), F.array_join(static, "|").alias("fixed"), F.array_join(dynamic, "|").alias("moving"))


@query("SELECT event_id FROM events WHERE ts + to_hours(CAST(event_id % 48 AS INTEGER)) < TIMESTAMP '2024-01-20 00:00:00'")
def ttl_expired(spark: SparkSession, d: str) -> DataFrame:
    expires = F.col("ts") + F.make_dt_interval(hours=(F.col("event_id") % 48).cast("int"))
    return table(spark, d, "events").filter(expires < F.to_timestamp(F.lit("2024-01-20 00:00:00"))).select("event_id")


@query("SELECT p_partkey AS ord FROM part WHERE p_size % 11 >= 1 AND p_size % 11 < 4 AND lower(p_brand) <> 'brand#11'")
def at_risk(spark: SparkSession, d: str) -> DataFrame:
    guarded = F.arrays_overlap("tags", F.array(F.lit("brand#11")))
    return part_entities(spark, d).filter(access.row_filter((F.col("importance") >= 1) & (F.col("importance") < 4), ~guarded)).select("ord")


@query("""
    WITH RECURSIVE n AS (SELECT DISTINCT p_name AS name FROM part), t AS (SELECT name, list_distinct(string_split(lower(name), ' ')) AS w FROM n),
         p AS (SELECT a.name AS x, b.name AS y FROM t a JOIN t b ON a.name <> b.name AND len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))) >= 0.3),
         r(name, seen) AS (SELECT name, name FROM n UNION SELECT r.name, p.y FROM r JOIN p ON p.x = r.seen)
    SELECT name, min(seen) AS duplicate_of FROM r GROUP BY name HAVING count(*) > 1""")
def obs_jaccard_dups(spark: SparkSession, d: str) -> DataFrame:
    return dedup.similar_observations(table(spark, d, "part").select(F.col("p_name").alias("content")), 0.3)


@query(f"WITH {GEO_SQL} SELECT 'c' || c_custkey AS node, 'c' || c_custkey || '>n' || n_nationkey || '>r' || n_regionkey AS path FROM customer JOIN nation ON c_nationkey = n_nationkey")
def path_bodies(spark: SparkSession, d: str) -> DataFrame:
    return graph.upward_paths(geo_relations(spark, d).filter("src not like 's%'"), "c").select("node", F.array_join("path", ">").alias("path"))


@query("""
    SELECT p_partkey AS ord, md5(concat_ws(chr(10), '### ' || p_name || ' #' || p_partkey, '', '- **Type:** ' || p_type, '- **Tags:** `' || lower(p_brand) || '`', '- **Importance:** ' || (p_size % 11) || '/10', '', '**Observations:**', '- ' || p_name || ' ' || p_type, '')) AS section
    FROM part""")
def export_markdown(spark: SparkSession, d: str) -> DataFrame:
    section = graph_io.markdown_section(*[F.col(c) for c in ("name", "entity_type", "tags", "importance", "observations")])
    return part_entities(spark, d).select("ord", F.md5(section).alias("section"))
