"""Queries of templates and of order-dependent choices over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import query
from .operators import patterns, streamed
from .session import shared_path
from .sources.views import table
from .streaming import timers


@query("""
    WITH e AS (SELECT event_id AS ord, concat_ws(' ', event_type, 'by user', user_id) AS text FROM events),
         t AS (SELECT text, min(ord) AS ord, regexp_split_to_array(text, '\\s+') AS k FROM e GROUP BY text),
         m AS (SELECT unnest([[0], [1], [2], [3], [0, 1], [0, 2], [0, 3], [1, 2], [1, 3], [2, 3]]) AS mask),
         r AS (SELECT ord, mask, lower(k[mask[1] + 1]) AS a, lower(k[mask[2] + 1]) AS b, array_to_string(list_transform(range(4), lambda i: CASE WHEN list_contains(mask, i) THEN '{X}' ELSE k[i + 1] END), ' ') AS pattern FROM t, m),
         g AS (SELECT min_by(pattern, ord) AS pattern, count(*) AS occurrences FROM r GROUP BY mask, lower(pattern) HAVING count(DISTINCT a) > 1 AND (len(mask) = 1 OR count(DISTINCT b) > 1))
    SELECT pattern, occurrences, round(least(1, occurrences / (SELECT count(*) FROM e)), 6) AS confidence FROM g""")
def pattern_templates(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    texts = e.select(F.col("event_id").alias("ord"), F.concat_ws(" ", "event_type", F.lit("by user"), "user_id").alias("text"))
    return patterns.templates(texts).select("pattern", "occurrences", F.round("confidence", 6).alias("confidence"))


@query("""
    WITH RECURSIVE p AS (SELECT p_brand AS brand, p_partkey AS part, p_size = 50 AS must, CAST(length(p_name) + length(p_type) AS BIGINT) AS cost,
                      row_number() OVER (PARTITION BY p_brand ORDER BY p_size = 50 DESC, CASE WHEN p_size = 50 THEN 0 ELSE -p_size / (length(p_name) + length(p_type)) END, p_partkey) AS n FROM part),
         w(brand, n, used, taken, part, must) AS (
             SELECT brand, CAST(0 AS BIGINT), CAST(0 AS BIGINT), FALSE, CAST(0 AS BIGINT), FALSE FROM p GROUP BY brand
             UNION ALL SELECT p.brand, p.n, w.used + CASE WHEN p.must OR w.used + p.cost <= 200 THEN p.cost ELSE 0 END, p.must OR w.used + p.cost <= 200, p.part, p.must FROM w JOIN p ON p.brand = w.brand AND p.n = w.n + 1)
    SELECT brand, part, must AS required FROM w WHERE taken""")
def budget_selection(spark: SparkSession, d: str) -> DataFrame:
    """Of each brand the parts of most size for their text, under a budget of characters; those of size 50 always."""
    p = table(spark, d, "part").select(F.col("p_brand").alias("brand"), F.col("p_partkey").alias("part"), F.col("p_size").alias("value"), (F.length("p_name") + F.length("p_type")).alias("cost"), (F.col("p_size") == 50).alias("must"))
    return streamed.budget_knapsack(p, "brand", "part", "value", "cost", 200, "must")


@query("""
    WITH RECURSIVE t AS (SELECT conv_id, turn, coalesce(length(text), 0) AS size, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations),
         w(conv_id, n, turn, used, chunk) AS (
             SELECT conv_id, n, turn, CAST(size AS BIGINT), CAST(0 AS BIGINT) FROM t WHERE n = 1
             UNION ALL SELECT t.conv_id, t.n, t.turn, CASE WHEN w.used > 0 AND w.used + t.size > 1000 THEN t.size ELSE w.used + t.size END, w.chunk + CASE WHEN w.used > 0 AND w.used + t.size > 1000 THEN 1 ELSE 0 END
             FROM w JOIN t ON t.conv_id = w.conv_id AND t.n = w.n + 1)
    SELECT conv_id, turn, chunk FROM w""")
def size_chunks(spark: SparkSession, d: str) -> DataFrame:
    return streamed.chunks_by_size(table(spark, d, "conversations"), "conv_id", "turn", "text", 1000)


@query("""
    WITH t AS (SELECT conv_id, turn, coalesce(text, '') AS text, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM conversations),
         f AS (SELECT *, CAST(1200 - before AS BIGINT) AS room, min(CASE WHEN before + length(text) > 1200 THEN turn END) OVER (PARTITION BY conv_id) AS stop_at FROM t),
         s AS (SELECT conv_id, turn, CASE WHEN stop_at IS NULL OR turn < stop_at THEN text WHEN turn = stop_at THEN regexp_extract(substring(text, 1, greatest(room, 0)), '(?s)^.*[.!?]') END AS section, turn = stop_at AS cut FROM f)
    SELECT conv_id, turn, section FROM s WHERE section IS NOT NULL AND NOT (coalesce(cut, FALSE) AND section = '')""")
def context_sections(spark: SparkSession, d: str) -> DataFrame:
    """The beginning of each conversation under a budget, cut at a sentence."""
    return streamed.clipped_sections(table(spark, d, "conversations"), "conv_id", "turn", "text", 1200)


@query("""
    WITH e AS (SELECT CAST(user_id AS VARCHAR) AS key, event_type, time_bucket(INTERVAL 1 MILLISECOND, ts) AS put FROM events),
         f AS (SELECT *, (SELECT min(o.put) FROM e o WHERE o.key = e.key AND o.put > e.put) AS following, max(put) OVER () AS latest FROM e),
         t AS (SELECT key, put, following, latest, unnest(['fired', 'expired']) AS event, unnest([put + INTERVAL 30 MINUTE, put + INTERVAL 6 HOUR]) AS due FROM f WHERE event_type IN ('view', 'click'))
    SELECT key, event, strftime(put, '%Y-%m-%d %H:%M:%S.%g') AS put_at, strftime(due, '%Y-%m-%d %H:%M:%S.%g') AS time FROM t WHERE due <= latest AND (following IS NULL OR following > due)""")
def trigger_times(spark: SparkSession, d: str) -> DataFrame:
    """Views and clicks, due after half an hour and void after six, until the user's next event; replayed as a stream."""
    rows = spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/event[s].parquet")  # a pattern: a stream takes a folder or a pattern, and the table may be one file
    at = F.col("ts").cast("timestamp")
    op = F.when(F.col("event_type").isin("view", "click"), "put").otherwise("take")
    changes = rows.select(F.col("user_id").alias("key"), op.alias("op"), at.alias("at"), (at + F.expr("interval '30' minute")).alias("due"), (at + F.expr("interval '6' hour")).alias("expires"))
    out = shared_path(spark, "triggers")
    found = timers.watch(changes)
    found.writeStream.option("checkpointLocation", shared_path(spark, "trigger-progress")).trigger(availableNow=True).format("parquet").outputMode("append").start(out).awaitTermination()
    shown = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSS").alias(c)
    return spark.read.schema(found.schema).parquet(out).select("key", "event", shown("put_at"), shown("time"))
