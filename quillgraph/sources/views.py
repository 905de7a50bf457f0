"""The two core tables, entities and relations, as views of relational tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import dealt


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents: name is the id, type the language, one observation, project the source."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("ord"), F.col("doc_id").cast("string").alias("name"), F.col("lang").alias("entity_type"), F.array("text").alias("observations"), F.array(F.col("source")).alias("tags"), F.col("source").alias("project_id"))


def part_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts: type, one observation and a tag of the brand; importance 0 to 10."""
    p = table(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").alias("ord"), F.concat("p_name", F.lit(" #"), F.col("p_partkey").cast("string")).alias("name"), F.col("p_type").alias("entity_type"),
        F.array(F.concat_ws(" ", "p_name", "p_type")).alias("observations"), F.array(F.lower("p_brand")).alias("tags"), (F.col("p_size") % 11).cast("double").alias("importance"),
    )


def geo_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations are part of regions; customers and suppliers are located in nations."""
    n, c, s = (table(spark, sf_dir, t) for t in ("nation", "customer", "supplier"))
    edge = lambda src, dst, kind: (src.alias("src"), dst.alias("dst"), F.lit(kind).alias("relation_type"))
    node = lambda prefix, col: F.concat(F.lit(prefix), F.col(col).cast("string"))
    return (
        n.select(*edge(node("n", "n_nationkey"), node("r", "n_regionkey"), "part_of"))
        .unionByName(c.select(*edge(node("c", "c_custkey"), node("n", "c_nationkey"), "located_in")))
        .unionByName(s.select(*edge(node("s", "s_suppkey"), node("n", "s_nationkey"), "located_in")))
    )


#: The same view for DuckDB.
GEO_SQL = """geo AS (
    SELECT 'n' || n_nationkey AS src, 'r' || n_regionkey AS dst, 'part_of' AS relation_type FROM nation
    UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 'located_in' FROM customer
    UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 'located_in' FROM supplier)"""


def supply_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers supply parts, once for each distinct pair; the weight is the number of line items."""
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey")
    # A row of the hash table, or of its sort (the count is of the files' footers).
    pairs = dealt(li, 150 * li.count(), "l_suppkey", "l_partkey").groupBy("l_suppkey", "l_partkey").agg(F.count(F.lit(1)).alias("weight"))
    return pairs.select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("src"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("dst"), "weight")


SUPPLY_SQL = "sup AS (SELECT 's' || l_suppkey AS src, 'p' || l_partkey AS dst, count(*) AS weight FROM lineitem GROUP BY 1, 2)"


def contains_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders contain parts from the order's date until the shipping date."""
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    # A row and the copies of it that joins and windows by order sort (the count is of the files' footers).
    li = dealt(li, 200 * li.count(), "l_orderkey")
    return li.join(o, li["l_orderkey"] == o["o_orderkey"]).select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"), F.col("l_linenumber").alias("line"), F.col("o_orderdate").alias("valid_from"), F.col("l_shipdate").alias("valid_until"))
