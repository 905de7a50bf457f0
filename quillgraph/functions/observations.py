"""Observations made to stand alone: pronouns become the entity's name, relative dates absolute ones."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Pronouns, and parts of names that tell which of them are meant (fixed values).
PRONOUNS = {"masculine": "he him his", "feminine": "she her hers", "neutral": "they them their theirs"}
NAMES = {"masculine": "john james bob mike david alex", "feminine": "alice jane sarah mary emma lisa"}
#: Words that are no keywords (fixed values).
STOP_WORDS = (
    "a an the is are was were be been being have has had do does did will would could should may might must shall "
    "can to of in for on with at by from as into through during before after above below between under again further "
    "then once here there when where why how all each few more most other some such no nor not only own same so than "
    "too very s t just don now and but or"
).split()


def _word(pattern: str) -> str:
    """A pattern between characters that are no ASCII letter, digit or underscore, in any case."""
    return rf"(?i)(?<![A-Za-z0-9_])(?:{pattern})(?![A-Za-z0-9_])"


def _literal(text: Column) -> Column:
    """Text as a replacement that stands for itself."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$"))


def resolve_pronouns(text: Column, name: Column, entity_type: Column) -> Column:
    """Pronouns of the name's gender become the name, and neutral ones that of an entity that is no person.

    A name that holds names of both genders counts as masculine; with none, only neutral
    pronouns are replaced.  A null name or type leaves the text as it is.
    """

    def replaced(text: Column, gender: str) -> Column:
        return F.regexp_replace(text, _word(PRONOUNS[gender].replace(" ", "|")), _literal(name))

    holds = {g: reduce(lambda a, b: a | b, [F.lower(name).contains(n) for n in names.split()]) for g, names in NAMES.items()}
    gendered = F.when(holds["masculine"], replaced(text, "masculine")).when(holds["feminine"], replaced(text, "feminine")).otherwise(text)
    return F.coalesce(F.when(F.lower(entity_type) != "person", replaced(gendered, "neutral")).otherwise(gendered), text)


def _anchors(clock: Column) -> list[tuple[str, Column]]:
    """Relative dates and what they mean at a clock, in the order in which they are replaced."""
    day = lambda n: F.date_format(F.date_add(F.to_date(clock), n), "yyyy-MM-dd")
    week = lambda n: F.concat(F.lit("week of "), day(n))
    # A day that the month before doesn't have runs over into the next: 31 March gives March.
    before = F.date_add(F.add_months(F.trunc(clock, "month"), -1), F.dayofmonth(clock) - 1)
    month = lambda date: F.date_format(date, "yyyy-MM")
    year = lambda n: (F.year(clock) + n).cast("string")
    return [
        ("yesterday", day(-1)), ("today", day(0)), ("tomorrow", day(1)), ("last week", week(-7)), ("last month", month(before)),
        ("last year", year(-1)), ("this week", week(0)), ("this month", month(clock)), ("this year", year(0)),
    ]


def anchored(rows: DataFrame, text: str, clock: str, changes: str = "changes") -> DataFrame:
    """``text`` with the first relative date of each kind replaced; what was done is added to the array ``changes``.

    A null clock or text changes nothing.
    """
    for phrase, date in _anchors(F.col(clock)):
        found = F.col(text).rlike(_word(phrase)) & date.isNotNull()
        told = F.concat(F.lit("'"), F.regexp_extract(text, _word(phrase), 0), F.lit("' -> '"), date, F.lit("'"))
        first = rf"(?s)\A(?<head>.*?){_word(phrase)}"
        rows = rows.withColumns({
            changes: F.when(found, F.concat(changes, F.array(told))).otherwise(F.col(changes)),
            text: F.when(found, F.regexp_replace(text, first, F.concat(F.lit("${head}"), date))).otherwise(F.col(text)),
        })
    return rows


def keywords(text: Column) -> Column:
    """Distinct lower-case words of three characters or more (a-z, 0-9) that are no stop words, in the order of the text."""
    bare = F.regexp_replace(F.lower(text), r"[^a-z0-9\s]", "")
    return F.array_distinct(F.filter(F.split(bare, r"\s+"), lambda w: (F.length(w) > 2) & ~w.isin(STOP_WORDS)))


def normalise(observations: DataFrame, text: str, name: str, entity_type: str, clock: str, pronouns: bool = True, dates: bool = True) -> DataFrame:
    """The rows with ``normalized``, ``changes`` (what was done, in order) and ``keywords`` of the normalised text.

    Pronouns are resolved first, so a name that holds a relative date is dated, too.  There
    is no shuffle.  Columns of these three names are replaced.
    """
    out = observations.withColumn("normalized", F.col(text).cast("string"))
    out = out.withColumn("changes", F.array().cast("array<string>"))
    if pronouns:
        told = F.array(F.concat(F.lit("Resolved pronouns to '"), F.col(name), F.lit("'")))
        out = out.withColumn("_n", resolve_pronouns(F.col("normalized"), F.col(name), F.col(entity_type)))
        out = out.withColumn("changes", F.when(F.col("_n") != F.col("normalized"), told).otherwise(F.col("changes"))).withColumn("normalized", F.col("_n")).drop("_n")
    if dates:
        out = anchored(out, "normalized", clock)
    return out.withColumn("keywords", keywords(F.col("normalized")))
