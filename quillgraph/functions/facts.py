"""Facts (subject, relation, object) of statements, by an ordered table of phrases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Relations, their phrases and confidences, the more specific first (fixed values).
RULES = [
    ("works_at", r"works?\s+(?:at|for)", 0.9),
    ("located_in", r"(?:is\s+)?located\s+in", 0.9),
    ("is_a", r"is\s+(?:a|an)", 0.85),
    ("created_by", r"(?:was\s+)?created\s+by", 0.8),
    ("owned_by", r"(?:is\s+)?owned\s+by", 0.8),
    ("part_of", r"(?:is\s+)?part\s+of", 0.8),
    ("prefers", r"prefers?", 0.75),
    ("depends_on", r"depends?\s+on", 0.75),
    ("uses", r"uses?", 0.7),
    ("manages", r"manages?", 0.7),
]
#: Letters that a statement of each relation holds, in lower case (fixed values).
STEMS = {
    "works_at": "work", "located_in": "located", "is_a": "is", "created_by": "created", "owned_by": "owned",
    "part_of": "part", "prefers": "prefer", "depends_on": "depend", "uses": "use", "manages": "manage",
}
#: Words that end an object, and titles that are no part of a name (fixed values).
BOUNDARIES = "on in at for with from since during after before and or but who which that".split()
TITLES = "dr. mr. mrs. ms. prof. sr. jr.".split()


def normalise_name(name: Column) -> Column:
    """Lower-cased, without a title before it, single blanks."""
    title = "|".join(t.replace(".", r"\.") for t in TITLES)
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(F.lower(name)), rf"^(?:{title})\s*", ""), r"\s+", " "))


def statement_pattern(phrase: str) -> str:
    """Subject, phrase and object of a statement.

    A subject is a run of words, blanks and hyphens up to the phrase.  It is tried from the
    first word of a run only, and the phrase where blanks begin: starts further on can't
    match where those fail, and each run is read once, so very long texts take linear time.
    """
    return rf"(?i)(?:^|[^\w\s-])[\s-]*+(\w[\w\s-]*?)(?<!\s)\s++{phrase}\s++(\w[\w\s-]*?)(?=\s+(?:{'|'.join(BOUNDARIES)})(?!\w)|[.,;!?]|\z)"


def _said(text: Column, lower: Column, min_confidence: float) -> Column:
    """An array of ``relation, confidence, said`` of each rule, null where its phrase is not; ``lower`` is the text in lower case.

    ``said`` is subject and object with a zero character between, which neither can hold, from
    one reading of the text; a text without the statement stays as it is.
    """
    found = []
    for relation, phrase, confidence in RULES:
        if confidence < min_confidence:
            continue
        pattern = statement_pattern(phrase)
        both = F.regexp_replace(text, rf"(?s)\A.*?{pattern}.*\z", "$1\0$2")
        # A text with zero characters of its own is read once for each end.
        apart = F.concat(F.regexp_extract(text, pattern, 1), F.lit("\0"), F.regexp_extract(text, pattern, 2))
        said = F.struct(F.lit(relation).alias("relation"), F.lit(confidence).alias("confidence"), F.when(F.contains(text, F.lit("\0")), apart).otherwise(both).alias("said"))
        # Letters alone spare most texts the search for the phrase, and that spares most others the longer pattern.
        found.append(F.when(F.contains(lower, F.lit(STEMS[relation])) & text.rlike(rf"(?i)\s{phrase}\s"), said))
    return F.array(*found)


def _end(said: Column, which: int, normalise: bool) -> Column:
    """Subject (1) or object (2); words, blanks and hyphens only, so there is no title with its dot to take off."""
    end = F.split_part(said, F.lit("\0"), F.lit(which))
    return F.trim(F.regexp_replace(F.lower(end), r"\s+", " ")) if normalise else F.regexp_replace(end, r"^\s+|\s+$", "")


def facts(text: Column, min_confidence: float = 0.5, normalise: bool = True) -> Column:
    """An array of ``subject, relation, object, confidence``: the first statement of each rule, in the order of the rules.

    Rules under the confidence are left out.  A null or empty text has no facts.
    """
    said = F.filter(_said(text, F.lower(text), min_confidence), lambda s: F.contains(s["said"], F.lit("\0")))
    each = F.transform(said, lambda s: F.struct(_end(s["said"], 1, normalise).alias("subject"), s["relation"].alias("relation"), _end(s["said"], 2, normalise).alias("object"), s["confidence"].alias("confidence")))
    return F.filter(each, lambda f: (f["subject"] != "") & (f["object"] != ""))


def extract(observations: DataFrame, key: str, text: str, min_confidence: float = 0.5) -> DataFrame:
    """``key, subject, relation, object, confidence``: distinct facts of the observations of each key."""
    read = observations.select(key, F.col(text).alias("text"), F.lower(text).alias("lower"))
    # Statements are rows before their ends are taken apart, so that each is read once.
    each = read.select(key, F.explode(_said(F.col("text"), F.col("lower"), min_confidence)).alias("s")).select(key, "s.*")
    each = each.filter(F.contains("said", F.lit("\0")) & (F.col("said") != "\0"))  # ends begin with a word's character, so none is empty
    ends = each.select(key, _end(F.col("said"), 1, True).alias("subject"), "relation", _end(F.col("said"), 2, True).alias("object"), "confidence")
    return ends.groupBy(key, "subject", "relation", "object").agg(F.max("confidence").alias("confidence"))


def persist(found: DataFrame, entities: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities (``name``) and relations (``src, dst, relation_type, weight``) that facts add to those there are.

    Subjects and objects without an entity become one; facts of the same ends and relation
    are one relation of the largest confidence, and none where it exists.
    """
    names = found.select(F.explode(F.array("subject", "object")).alias("name")).distinct()
    new = found.groupBy(F.col("subject").alias("src"), F.col("object").alias("dst"), F.col("relation").alias("relation_type")).agg(F.max("confidence").alias("weight"))
    return names.join(entities.select("name"), "name", "left_anti"), new.join(relations.select("src", "dst", "relation_type"), ["src", "dst", "relation_type"], "left_anti")
