"""Duplicates, merging and consolidation of entities, observations and relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: Rows of a block in one piece, and pairs of one task, about.
_PIECE, _PAIRS = 500, 10_000_000


def entity_similarity_pairs(entities: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Pairs of one type and neighbouring two-letter blocks: ``a, b, score``.

    Score: 0.4 name + 0.2 type + 0.3 observations + 0.1 tags (if either has tags), over
    the weights used.
    """
    low = entities.select(
        F.col("ord"), F.lower("name").alias("name"), F.lower("entity_type").alias("t"), F.array_sort(F.array_distinct(F.transform("observations", F.lower))).alias("obs"), F.array_sort(F.array_distinct(F.transform("tags", F.lower))).alias("tags")
    ).withColumn("block", F.substring("name", 1, 2))
    blocks = low.select("t", "block").distinct().withColumn("rank", F.row_number().over(Window.partitionBy("t").orderBy("block")))
    keyed = low.join(blocks, ["t", "block"])
    # A block's rows are dealt over pieces, which meet all rows of the right: no block is one task.
    rows = keyed.groupBy("t", "rank").agg(F.count(F.lit(1)).alias("n"))
    tasks = rows.agg(F.coalesce(F.ceil(F.sum(F.col("n") * F.col("n")) / _PAIRS), F.lit(0))).first()[0]
    pieces = rows.select("t", "rank", F.ceil(F.col("n") / _PIECE).cast("int").alias("pieces"))
    left = keyed.join(pieces, ["t", "rank"]).select("t", "rank", F.pmod(F.xxhash64("ord"), F.col("pieces")).cast("int").alias("piece"), *[F.col(c).alias(f"l_{c}") for c in ("ord", "name", "obs", "tags")])
    right = keyed.select("t", F.explode(F.array(F.col("rank"), F.col("rank") - 1)).alias("rank"), F.col("rank").alias("own"), *[F.col(c).alias(f"r_{c}") for c in ("ord", "name", "obs", "tags")])
    right = right.join(pieces, ["t", "rank"]).withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).drop("pieces")
    left = left.repartition(max(int(low.sparkSession.conf.get("spark.sql.shuffle.partitions")), tasks), "t", "rank", "piece")
    met = left.join(right.hint("merge"), ["t", "rank", "piece"]).filter((F.col("own") != F.col("rank")) | (F.col("l_ord") < F.col("r_ord")))
    tagged = (F.size("l_tags") > 0) | (F.size("r_tags") > 0)
    whole = F.when(tagged, 1.0).otherwise(0.9)
    alike = lambda c: F.when((F.col(f"l_{c}") == F.col(f"r_{c}")) & (F.size(f"l_{c}") > 0), 1.0)
    # Sets that differ have one element or more apart.  What they leave to the names bounds the distance, which is searched no further.
    bound = lambda c: alike(c).otherwise(1 - 1 / F.greatest(F.size(f"l_{c}") + F.size(f"r_{c}"), F.lit(1)))
    need = ((threshold - 1e-6) * whole - 0.2 - 0.3 * bound("obs") - F.when(tagged, 0.1 * bound("tags")).otherwise(0.0)) / 0.4
    most = F.floor((1 - need) * F.greatest(F.length("l_name"), F.length("r_name")) + 1e-6).cast("int")
    near = (most >= 0) & (F.call_function("levenshtein", "l_name", "r_name", F.greatest(most, F.lit(0))) >= 0)
    met = met.filter(F.coalesce(near, F.lit(True)))
    jaccard = lambda c: alike(c).otherwise(T.jaccard(F.col(f"l_{c}"), F.col(f"r_{c}")))
    total = 0.4 * T.similarity(F.col("l_name"), F.col("r_name")) + 0.2 + 0.3 * jaccard("obs") + F.when(tagged, 0.1 * jaccard("tags")).otherwise(0.0)
    score = F.round(total / whole, 6)
    return met.select(F.least("l_ord", "r_ord").alias("a"), F.greatest("l_ord", "r_ord").alias("b"), score.alias("score")).filter(F.col("score") >= threshold)


def exact_observations(observations: DataFrame, least: int = 2) -> DataFrame:
    """Hashes of lower-cased, blank-collapsed observations that occur ``least`` times: ``hash, n, first_ord``."""
    norm = F.trim(F.regexp_replace(F.lower("content"), r"\s+", " "))
    return observations.groupBy(F.sha2(norm, 256).alias("hash")).agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first_ord")).filter(F.col("n") >= least)


def merge_groups(entities: DataFrame, group: str) -> DataFrame:
    """One entity of each group: union of observations and tags, largest importance, first ord."""

    def union(c: str) -> DataFrame:
        each = entities.select(group, F.explode(c).alias("x")).distinct()  # tasks drop repeats before the shuffle
        return each.groupBy(group).agg(F.array_sort(F.collect_list("x")).alias(c))

    empty = F.array().cast("array<string>")
    one = entities.groupBy(group).agg(F.min("ord").alias("ord"), F.max("importance").alias("importance"), F.count(F.lit(1)).alias("merged"))
    both = one.join(union("observations"), group, "left").join(union("tags"), group, "left")
    return both.select(group, "ord", "importance", F.coalesce("observations", empty).alias("observations"), F.coalesce("tags", empty).alias("tags"), "merged")


def normalise_relation_type(col):
    """camelCase to snake_case, lower-cased; blanks and hyphens become underscores."""
    return F.lower(F.regexp_replace(F.regexp_replace(col, r"([a-z0-9])([A-Z])", "$1_$2"), r"[\s\-]+", "_"))


def consolidate_relations(relations: DataFrame) -> DataFrame:
    """One relation for each (src, dst, normalised type): largest weight, number merged."""
    return relations.groupBy("src", "dst", normalise_relation_type(F.col("relation_type")).alias("relation_type")).agg(F.max("weight").alias("weight"), F.count(F.lit(1)).alias("merged"))


def turn_duplicates(turns: DataFrame, last: int = 200, threshold: float = 0.5, prefix: float = 0.5) -> DataFrame:
    """Turns like an earlier one of their conversation: ``conv_id, turn, tier``.

    Tiers, the first that holds: the same normalised text anywhere before; among the last
    turns one that shares a prefix of at least ``prefix`` of the longer text; or a Jaccard
    similarity of the words.  Null texts are no duplicates.
    """
    norm = F.trim(F.regexp_replace(F.lower("text"), r"\s+", " "))
    t = turns.filter("text is not null").select("conv_id", "turn", "text", F.sha2(norm, 256).alias("hash"), F.array_distinct(T.tokenize_alphanumeric(F.col("text"))).alias("words"))
    t = t.withColumn("first", F.min("turn").over(Window.partitionBy("conv_id", "hash")))
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-last, -1)
    t = t.withColumn("before", F.collect_list(F.struct("text", "words")).over(w))
    size = lambda x: F.ceil(prefix * F.greatest(F.length(x["text"]), F.length("text"))).cast("int")
    begins = F.exists("before", lambda x: F.substring(x["text"], F.lit(1), size(x)) == F.substring(F.col("text"), F.lit(1), size(x)))
    near = F.exists("before", lambda x: T.jaccard(x["words"], F.col("words")) >= threshold)
    tier = F.when(F.col("first") < F.col("turn"), "exact").when(begins, "prefix").when(near, "jaccard")
    return t.select("conv_id", "turn", tier.alias("tier")).filter("tier is not null")


def conflict_winners(claims: DataFrame, subject: str, *order) -> DataFrame:
    """The claim of each subject that comes first in an order."""
    return claims.withColumn("n", F.row_number().over(Window.partitionBy(subject).orderBy(*order))).filter("n = 1").drop("n")


def similar_observations(observations: DataFrame, threshold: float = 0.8) -> DataFrame:
    """``name, duplicate_of`` of distinct contents that others resemble: the least content of their closure.

    Contents are sets of lower-cased words.  Two with a Jaccard similarity of the threshold
    share one of their first words in a global order, the rarest first, so only contents
    with such a word in common and of similar size meet.
    """
    from .graph import connected_components

    texts = observations.select(F.col("content").alias("name")).filter("content is not null").distinct()
    words = texts.select("name", F.explode(F.array_distinct(F.filter(F.split(F.lower("name"), r"\s+"), lambda w: w != ""))).alias("w"))
    counts = words.groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    ordered = words.join(counts, "w").groupBy("name").agg(F.transform(F.sort_array(F.collect_list(F.struct("n", "w"))), lambda x: x["w"]).alias("words"))
    sized = ordered.withColumn("size", F.size("words"))
    prefix = F.slice("words", F.lit(1), F.col("size") - F.ceil(F.lit(threshold) * F.col("size")).cast("int") + 1)
    keyed = sized.select("name", "words", "size", F.explode(prefix).alias("key"))
    a, b = (keyed.select("key", *[F.col(c).alias(f"{c}_{x}") for c in ("name", "words", "size")]) for x in "ab")
    met = a.join(b, "key").filter((F.col("name_a") < F.col("name_b")) & (F.least("size_a", "size_b") >= threshold * F.greatest("size_a", "size_b")))
    links = met.filter(T.jaccard(F.col("words_a"), F.col("words_b")) >= threshold).select(F.col("name_a").alias("src"), F.col("name_b").alias("dst")).distinct()
    nodes = links.select(F.explode(F.array("src", "dst")).alias("node"))
    return connected_components(nodes, links).select(F.col("node").alias("name"), F.col("component").alias("duplicate_of"))
