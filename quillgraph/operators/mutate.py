"""Graph changes as functions from tables to tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def last_writer(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key, by one aggregation (no sort of a key's rows)."""
    others = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), F.col(order)).alias("r"))
    return best.select(*keys, *[F.col(f"r.{c}").alias(c) for c in others])


def import_merge(old: DataFrame, new: DataFrame, key: str, strategy: str = "merge") -> DataFrame:
    """Imports rows (key, observations): ``replace`` all, ``skip`` known keys, ``merge`` observations, or ``fail`` on one."""
    if strategy == "replace":
        return new.withColumn("status", F.lit("added"))
    a = old.select(key, F.col("observations").alias("o"))
    b = new.select(key, F.col("observations").alias("n"))
    met = a.join(b, key, "full_outer")
    if strategy == "fail" and not met.filter("o is not null and n is not null").isEmpty():
        raise ValueError("a key exists already")
    none = F.array().cast("array<string>")
    both = F.array_distinct(F.concat(F.coalesce("o", none), F.coalesce("n", none)))
    out = both if strategy == "merge" else F.coalesce("o", "n")
    status = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "kept").otherwise("updated" if strategy == "merge" else "skipped")
    return met.select(key, out.alias("observations"), status.alias("status"))


def archive(entities: DataFrame, older: Column | None = None, below: float | None = None, tags: list[str] | None = None) -> DataFrame:
    """Entities to archive: old, or of less importance (missing counts as less), or with a tag."""
    test = F.lit(False)
    if older is not None:
        test = test | F.coalesce(older, F.lit(False))
    if below is not None:
        test = test | F.coalesce(F.col("importance") < below, F.lit(True))
    if tags:
        test = test | F.arrays_overlap("tags", F.array(*map(F.lit, tags)))
    return entities.filter(test)


def without(entities: DataFrame, relations: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Removes entities (by name) and the relations that touch them."""
    names = gone.select("name").distinct()
    left = entities.join(names, "name", "left_anti")
    touched = relations.join(names.withColumnRenamed("name", "src"), "src", "left_anti").join(names.withColumnRenamed("name", "dst"), "dst", "left_anti")
    return left, touched


def rename(relations: DataFrame, names: DataFrame) -> DataFrame:
    """Rewrites both ends of relations by a table (old, new)."""
    a, b = names.select(F.col("old").alias("src"), F.col("new").alias("new_src")), names.select(F.col("old").alias("dst"), F.col("new").alias("new_dst"))
    return relations.join(a, "src", "left").join(b, "dst", "left").select(F.coalesce("new_src", "src").alias("src"), F.coalesce("new_dst", "dst").alias("dst"), *[c for c in relations.columns if c not in ("src", "dst")])


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """``key, change``: added, removed or changed."""
    met = old.select(key, F.col(value).alias("o"), F.lit(True).alias("in_old")).join(new.select(key, F.col(value).alias("n"), F.lit(True).alias("in_new")), key, "full_outer")
    change = F.when(F.col("in_old").isNull(), "added").when(F.col("in_new").isNull(), "removed").when(~F.col("o").eqNullSafe(F.col("n")), "changed")
    return met.select(key, change.alias("change")).filter("change is not null")


def triples(entities: DataFrame) -> DataFrame:
    """Subject, predicate, object rows of entities: type, observations and tags."""
    one = lambda p, c: entities.select(F.col("name").alias("s"), F.lit(p).alias("p"), F.col(c).alias("o"))
    many = lambda p, c: entities.select(F.col("name").alias("s"), F.lit(p).alias("p"), F.explode(c).alias("o"))
    return one("type", "entity_type").unionByName(many("observation", "observations")).unionByName(many("tag", "tags"))
