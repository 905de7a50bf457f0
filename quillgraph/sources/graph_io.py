"""Reads graphs from JSON lines; writes JSON lines, CSV, GraphML, DOT, Mermaid, Markdown and Turtle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as TT

from ..functions.text import csv_cell

ENTITY = TT.StructType(
    [TT.StructField("name", TT.StringType()), TT.StructField("entityType", TT.StringType()), TT.StructField("observations", TT.ArrayType(TT.StringType())), TT.StructField("tags", TT.ArrayType(TT.StringType())), TT.StructField("importance", TT.DoubleType()), TT.StructField("createdAt", TT.StringType()), TT.StructField("lastModified", TT.StringType())]
)
RELATION = TT.StructType([TT.StructField("from", TT.StringType()), TT.StructField("to", TT.StringType()), TT.StructField("relationType", TT.StringType()), TT.StructField("weight", TT.DoubleType())])


def read_jsonl(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Entities and relations of a JSON-lines log; the last line of a key wins, bad lines are skipped.

    Lines are ordered by file and place in it, as an append-only log has them.
    """
    schema = TT.StructType([TT.StructField("type", TT.StringType()), *ENTITY.fields, *RELATION.fields])
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path).withColumn("line", F.struct(F.input_file_name(), F.monotonically_increasing_id()))
    e = rows.filter("type = 'entity' and name is not null").groupBy("name").agg(F.max_by(F.struct(*[f.name for f in ENTITY.fields if f.name != "name"]), "line").alias("r")).select("name", "r.*")
    r = rows.filter("type = 'relation' and `from` is not null and `to` is not null").groupBy("from", "to", "relationType").agg(F.max_by("weight", "line").alias("weight"))
    return e, r


def jsonl(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """One JSON object a line: ``value``."""
    one = lambda df, kind: df.select(F.to_json(F.struct(F.lit(kind).alias("type"), *df.columns)).alias("value"))
    return one(entities, "entity").unionByName(one(relations, "relation"))


def csv_lines(entities: DataFrame) -> DataFrame:
    """Entities as CSV lines; arrays are joined by ``; ``."""
    cells = [csv_cell(F.coalesce(F.array_join(c, "; ") if isinstance(entities.schema[c].dataType, TT.ArrayType) else F.col(c).cast("string"), F.lit(""))) for c in entities.columns]
    return entities.select(F.concat_ws(",", *cells).alias("value"))


def xml_escaped(c: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def _id(c: Column) -> Column:
    return F.regexp_replace(c, "[^A-Za-z0-9_]", "_")


def graphml(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Body lines of a GraphML graph; ``part`` orders nodes before edges."""
    node = F.format_string('<node id="%s"><data key="entityType">%s</data></node>', xml_escaped(F.col("name")), xml_escaped(F.col("entityType")))
    edge = F.format_string('<edge source="%s" target="%s"><data key="relationType">%s</data></edge>', *[xml_escaped(F.col(c)) for c in ("from", "to", "relationType")])
    return entities.select(F.lit(0).alias("part"), node.alias("value")).unionByName(relations.select(F.lit(1).alias("part"), edge.alias("value")))


def dot(entities: DataFrame, relations: DataFrame) -> DataFrame:
    q = lambda c: F.concat(F.lit('"'), F.replace(F.replace(F.col(c), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    node = F.concat(q("name"), F.lit(" [label="), q("name"), F.lit("];"))
    edge = F.concat(q("from"), F.lit(" -> "), q("to"), F.lit(" [label="), q("relationType"), F.lit("];"))
    return entities.select(F.lit(0).alias("part"), node.alias("value")).unionByName(relations.select(F.lit(1).alias("part"), edge.alias("value")))


def mermaid(entities: DataFrame, relations: DataFrame) -> DataFrame:
    node = F.concat(_id(F.col("name")), F.lit('["'), F.replace(F.col("name"), F.lit('"'), F.lit("#quot;")), F.lit('"]'))
    edge = F.concat(_id(F.col("from")), F.lit(" -->|"), F.col("relationType"), F.lit("| "), _id(F.col("to")))
    return entities.select(F.lit(0).alias("part"), node.alias("value")).unionByName(relations.select(F.lit(1).alias("part"), edge.alias("value")))


def markdown_section(name: Column, kind: Column, tags: Column, importance: Column, observations: Column) -> Column:
    """The Markdown section of an entity; tags, importance and observations only where there are any."""
    number = F.regexp_replace(importance.cast("string"), r"\.0$", "")
    lines = F.array_compact(
        F.array(
            F.concat(F.lit("### "), F.coalesce(name, F.lit(""))), F.lit(""), F.concat(F.lit("- **Type:** "), F.coalesce(kind, F.lit(""))),
            F.when(F.size(tags) > 0, F.concat(F.lit("- **Tags:** "), F.array_join(F.transform(tags, lambda t: F.concat(F.lit("`"), t, F.lit("`"))), ", "))),
            F.when(importance.isNotNull(), F.concat(F.lit("- **Importance:** "), number, F.lit("/10"))),
            F.when(F.size(observations) > 0, F.concat(F.lit("\n**Observations:**\n"), F.array_join(F.transform(observations, lambda o: F.concat(F.lit("- "), o)), "\n"))),
            F.lit(""),
        )
    )
    return F.array_join(lines, "\n")


def markdown(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Sections of entities, then one line for each relation; ``part`` orders them."""
    section = markdown_section(*[F.col(c) for c in ("name", "entityType", "tags", "importance", "observations")])
    line = F.format_string("- **%s** \u2192 *%s* \u2192 **%s**", "from", "relationType", "to")
    return entities.select(F.lit(0).alias("part"), section.alias("value")).unionByName(relations.select(F.lit(1).alias("part"), line.alias("value")))


def turtle(triples: DataFrame, base: str = "urn:kg:") -> DataFrame:
    """N-Triples lines of (s, p, o) rows; objects are literals, subjects and predicates IRIs."""
    iri = lambda c: F.concat(F.lit(f"<{base}"), F.url_encode(c), F.lit(">"))
    text = F.col("o")
    for raw, safe in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return triples.select(F.concat(iri("s"), F.lit(" "), iri("p"), F.lit(' "'), text, F.lit('" .')).alias("value"))
