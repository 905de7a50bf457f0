"""Text functions as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that BM25 leaves out (fixed values).
BM25_STOP_WORDS = (
    "a an and are as at be by for from has he in is it its of on or that the to was were will with you your "
    "this but they have had what when where who which why how all each every both few more most other some such no not "
    "only own same so than too very can just should now also being been would could into over after before between under "
    "again then once here there any about"
).split()
#: Words that are no keywords, and weights of words that tell a topic (fixed values).
KEYWORD_STOP_WORDS = "a an the is are was were be been have has had do does did will would could should can to of in for on with at by from as and or but".split()
KEYWORD_BOOSTS = {
    "project": 1.5, "task": 1.5, "meeting": 1.3, "deadline": 1.4, "completed": 1.2, "started": 1.2, "person": 1.3,
    "company": 1.3, "team": 1.3, "release": 1.4, "feature": 1.3, "bug": 1.2, "issue": 1.2, "milestone": 1.4,
}
#: Patterns of personal data and what replaces them, in this order (fixed values).
PII_PATTERNS = [
    (r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", "<EMAIL>"),
    (r"\b\d{3}-\d{2}-\d{4}\b", "<SSN>"),
    (r"\b(?:\d{13,19}|\d{4}(?:[ -]\d{4}){2,4})\b", "<CC>"),
    (r"(?:\+?1[\s.-]?)?\(?\d{3}\)?[\s.-]?\d{3}[\s.-]?\d{4}", "<PHONE>"),
    (r"\b(?:\d{1,3}\.){3}\d{1,3}\b", "<IP>"),
]


def tokenize(text: Column) -> Column:
    """Lower-cased words; everything but ASCII word characters separates."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"\w+"), F.lit(0))


def query_tokens(query: str) -> list[str]:
    """The tokens of a query, as ``tokenize`` gives those of a text; repeats stay."""
    return re.sub(r"[^a-z0-9_\s]", " ", query.lower()).split()


def word_count(lower: Column, word: str | None = None) -> Column:
    """How often a word (any, if None) is among the tokens of lower-cased text, without building them.

    A word that is not even a substring is not searched.
    """
    if word is None:
        return F.regexp_count(lower, F.lit(r"\w+"))
    exact = F.regexp_count(lower, F.lit(rf"(?<!\w)\Q{word}\E(?!\w)"))
    return F.when(F.contains(lower, F.lit(word)), exact).otherwise(F.lit(0)) if re.fullmatch(r"\w+", word, re.ASCII) else F.lit(0)


def tokenize_stripped(text: Column) -> Column:
    """Lower-cased words after dropping (not replacing) all but ``[a-z0-9\\s]``."""
    return F.filter(F.split(F.regexp_replace(F.lower(text), r"[^a-z0-9\s]", ""), r"\s+"), lambda t: t != "")


def tokenize_alphanumeric(text: Column) -> Column:
    """Lower-cased runs of ``[a-z0-9]``."""
    return F.filter(F.split(F.lower(text), r"[^a-z0-9]+"), lambda t: t != "")


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays as sets; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of numbers as doubles; 0 for a zero vector."""
    a, b = (F.transform(x, lambda v: v.cast("double")) for x in (a, b))
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    dot = total(F.zip_with(a, b, lambda x, y: x * y))
    norm = F.sqrt(total(F.transform(a, lambda x: x * x))) * F.sqrt(total(F.transform(b, lambda x: x * x)))
    return F.when(norm > 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot / norm))).otherwise(F.lit(0.0))


def ngrams(text: Column, n: int = 3) -> Column:
    """Distinct character n-grams of lower-cased text with single blanks; the whole text if shorter."""
    t = F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))
    grams = F.transform(F.sequence(F.lit(1), F.length(t) - n + 1), lambda i: F.substring(t, i, F.lit(n)))
    return F.array_distinct(F.when(F.length(t) >= n, grams).when(t != "", F.array(t)).otherwise(F.array().cast("array<string>")))


def redact(text: Column) -> Column:
    """Personal data replaced, one pattern after the other."""
    for pattern, mark in PII_PATTERNS:
        text = F.regexp_replace(text, pattern, mark)
    return text


def entropy(text: Column) -> Column:
    """Shannon entropy of the characters in bits; 0 for empty text."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    n = F.size(chars)
    share = F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda x: x == c)) / n)
    return F.when(n > 0, F.aggregate(share, F.lit(0.0), lambda s, p: s - p * F.log2(p))).otherwise(F.lit(0.0))


def similarity(a: Column, b: Column) -> Column:
    """1 - Levenshtein distance / longer length, of lower-cased text; 1 for two empty texts."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest > 0, 1 - F.levenshtein(F.lower(a), F.lower(b)) / longest).otherwise(F.lit(1.0))


def token_estimate(text: Column) -> Column:
    """ceil(words * 1.3)."""
    words = F.filter(F.split(text, r"\s+"), lambda t: t != "")
    return F.ceil(F.size(words) * F.lit(1.3)).cast("bigint")


def csv_cell(text: Column) -> Column:
    """An RFC 4180 cell; a leading formula character gets a single quote before it."""
    safe = F.when(text.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), text)).otherwise(text)
    quoted = F.concat(F.lit('"'), F.replace(safe, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(safe.rlike(r'[,"\n\r]'), quoted).otherwise(safe)
