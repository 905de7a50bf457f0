"""Queries over the persisted inverted index: built from whole tables, changed, and asked."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import ORACLES, TOKENS_SQL, query
from .operators import text_index
from .session import shared_path
from .sources.views import table


def _indexed(spark: SparkSession, d: str) -> str:
    folder = shared_path(spark, "text-index")
    text_index.build(table(spark, d, "documents").select(F.col("doc_id").alias("ord"), "text"), folder, buckets=16)
    return folder


@query(ORACLES["bm25_topk"])
def index_bm25(spark: SparkSession, d: str) -> DataFrame:
    return text_index.bm25(spark, _indexed(spark, d), "Tion, ther! (erin)")


@query(f"""
    WITH k AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id),
         s AS (SELECT d.doc_id AS ord, {TOKENS_SQL.format("CASE WHEN quality = 1 THEN text || ' ther!' ELSE text END")} AS tokens FROM documents d LEFT JOIN k USING (doc_id) WHERE coalesce(toxic, 0) = 0),
         q AS (SELECT unnest(['tion', 'ther', 'erin']) AS term, unnest([1, 2, 1]) AS times),
         tf AS (SELECT s.ord, greatest(len(tokens), 1) AS dl, term, times, len(list_filter(tokens, lambda t: t = term)) AS tf FROM s, q),
         df AS (SELECT term, count(*) FILTER (tf > 0) AS df FROM tf GROUP BY term), tot AS (SELECT count(*) AS n FROM s),
         sc AS (SELECT ord, round(sum(CASE WHEN tf > 0 THEN times * tf / dl * ln(n / df) ELSE 0 END), 6) AS score FROM tf JOIN df USING (term), tot GROUP BY ord)
    SELECT ord, score FROM sc WHERE score > 0 ORDER BY score DESC, ord LIMIT 10""")
def index_changes(spark: SparkSession, d: str) -> DataFrame:
    """Toxic texts are removed and good ones get a word more; then the index is asked."""
    folder = _indexed(spark, d)
    marks = table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    op = F.when(F.col("toxic") == 1, "remove").when(F.col("quality") == 1, "put")
    met = table(spark, d, "documents").join(marks.select("doc_id", op.alias("op")).filter("op is not null"), "doc_id")
    changes = met.select(F.col("doc_id").alias("ord"), F.concat("text", F.lit(" ther!")).alias("text"), "op", F.lit(1).alias("at"))
    text_index.apply_changes(changes, folder)
    return text_index.tfidf(spark, folder, "tion ther? THER erin")
