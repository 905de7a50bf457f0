"""Search and ranking over entities (name, entity_type, observations, tags, ord)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import written


def entity_text(entities: DataFrame) -> Column:
    """Name, type and observations of an entity as one text."""
    return F.concat_ws(" ", "name", "entity_type", F.array_join("observations", " "))


def contains_term(term: str, fields: tuple[str, ...] = ("name", "entity_type", "observations"), ignore: bool = True) -> Column:
    """Substring of the name, the type, any observation or any tag, without case."""
    t = F.lit(term.lower())
    test = {
        "name": F.contains(F.lower("name"), t), "entity_type": F.contains(F.lower("entity_type"), t),
        "observations": F.exists("observations", lambda o: F.contains(F.lower(o), t)), "tags": F.exists("tags", lambda o: F.contains(F.lower(o), t)),
    }
    out = F.lit(False)
    for f in fields:
        out = out | F.coalesce(test[f], F.lit(False))
    return out


def basic_search(entities: DataFrame, query: str) -> DataFrame:
    """Entities with the query in their name, type or an observation (not in tags)."""
    return entities.filter(contains_term(query))


def induced_relations(relations: DataFrame, names: DataFrame) -> DataFrame:
    """Relations with both ends among ``names`` (column ``name``)."""
    a, b = names.select(F.col("name").alias("src")).distinct(), names.select(F.col("name").alias("dst")).distinct()
    return relations.join(a, "src", "left_semi").join(b, "dst", "left_semi")


def _terms(docs: DataFrame, text: Column, stop: list[str] | None) -> DataFrame:
    tokens = T.tokenize(text)
    if stop:
        tokens = F.filter(tokens, lambda t: ~t.isin(stop))
    return docs.select("ord", tokens.alias("tokens")).select("ord", F.size("tokens").alias("dl"), F.explode_outer("tokens").alias("term"))


def bm25(docs: DataFrame, text: Column, query: str, k: int = 10, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """The k best documents of a query by BM25: ``ord, score``; ties to the smaller ord.

    Stop words are dropped from documents and query; a word counts as often as the query has it.  A text is counted where it lies, by
    compiled patterns; the counts, a few numbers a row, are written once and read for the
    totals and for the scores of the rows that hold a query word.  Null texts have no words.
    """
    asked = [w for w in T.query_tokens(query) if w not in T.BM25_STOP_WORDS]
    words = list(dict.fromkeys(asked))
    lower = F.lower(F.coalesce(text, F.lit("")))
    stops = F.regexp_count(lower, F.lit(rf"(?<!\w)(?:{'|'.join(T.BM25_STOP_WORDS)})(?!\w)"))
    counted = written(docs.select("ord", (T.word_count(lower) - stops).alias("dl"), *[T.word_count(lower, w).alias(f"tf{i}") for i, w in enumerate(words)]), "word-counts")
    totals = counted.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(words))])
    hit = F.lit(False)
    score = F.lit(0.0)
    for i in range(len(words)):
        tf, df = F.col(f"tf{i}"), F.col(f"df{i}")
        idf = F.ln((F.col("n") - df + 0.5) / (df + 0.5) + 1)
        score = score + asked.count(words[i]) * idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
        hit = hit | (tf > 0)
    scored = counted.filter(hit).crossJoin(F.broadcast(totals))  # totals are one row
    return scored.select("ord", F.round(score, 6).alias("score")).orderBy(F.desc("score"), "ord").limit(k)


def tfidf(docs: DataFrame, text: Column, query: str, k: int = 10) -> DataFrame:
    """The k best documents by the sum of tf * ln(N / df) over query words (repeats count); planned like ``bm25``."""
    words = T.query_tokens(query)
    lower = F.lower(F.coalesce(text, F.lit("")))
    tf = {w: f"tf{i}" for i, w in enumerate(dict.fromkeys(words))}
    some = F.lit(False)
    for w in tf:
        some = some | F.contains(lower, F.lit(w))
    # The length matters only where a query word may be.
    dl = F.when(some, T.word_count(lower)).otherwise(F.lit(0))
    counted = written(docs.select("ord", dl.alias("dl"), *[T.word_count(lower, w).alias(c) for w, c in tf.items()]), "word-counts")
    totals = counted.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(c) > 0).alias(f"df_{c}") for c in tf.values()])
    score = F.lit(0.0)
    for w in words:
        share = F.col(tf[w]) / F.greatest(F.col("dl"), F.lit(1))
        score = score + F.when(F.col(f"df_{tf[w]}") > 0, share * F.ln(F.col("n") / F.col(f"df_{tf[w]}"))).otherwise(0.0)
    scored = counted.crossJoin(F.broadcast(totals)).select("ord", F.round(score, 6).alias("score"))
    return scored.filter("score > 0").orderBy(F.desc("score"), "ord").limit(k)


def documents_with(docs: DataFrame, text: Column, words: list[str], every: bool) -> DataFrame:
    """``ord`` of texts that have all words among their tokens, or any; a scan without a shuffle."""
    out = F.lit(every)
    for w in words:
        has = T.word_count(F.lower(F.coalesce(text, F.lit(""))), w) > 0
        out = out & has if every else out | has
    return docs.filter(out).select("ord")


def term_table(docs: DataFrame, text: Column) -> DataFrame:
    """Inverted index: ``term, ord, tf``."""
    return _terms(docs, text, None).filter("term is not null").groupBy("term", "ord").agg(F.count(F.lit(1)).alias("tf"))


def postings(terms: DataFrame, words: list[str], every: bool) -> DataFrame:
    """Documents with all words (intersection) or any (union)."""
    met = terms.filter(F.col("term").isin(words)).groupBy("ord").agg(F.count_distinct("term").alias("n"))
    return met.filter(F.col("n") >= (len(set(words)) if every else 1)).select("ord")


def fuzzy(entities: DataFrame, query: str, threshold: float = 0.7) -> DataFrame:
    """Entities whose name, type, an observation or a word of one is similar to the query, or contains it or is contained."""
    q = F.lit(query.lower())

    def near(x: Column) -> Column:
        x = F.lower(x)
        return (x == q) | F.contains(x, q) | F.contains(q, x) | (T.similarity(x, q) >= threshold)

    words = F.flatten(F.transform("observations", lambda o: F.filter(F.split(o, r"\s+"), lambda w: w != "")))
    return entities.filter(near(F.col("name")) | near(F.col("entity_type")) | F.exists(F.concat(words, "observations"), near))


def ngram_matches(names: DataFrame, col: str, query: str, threshold: float = 0.2, n: int = 3) -> DataFrame:
    """Values whose character n-grams have a Jaccard similarity of ``threshold`` or more with the query's."""
    return names.withColumn("score", F.round(T.jaccard(T.ngrams(F.col(col), n), T.ngrams(F.lit(query), n)), 6)).filter(F.col("score") >= threshold)


def glob(col: Column, pattern: str) -> Column:
    """Whole-string match of ``*`` and ``?``, without case."""
    escaped = "".join(".*" if c == "*" else "." if c == "?" else "\\" + c if not (c.isalnum() or c == "_" or c == " ") else c for c in pattern.lower())
    return F.lower(col).rlike(f"(?s)^{escaped}$")


def phrase(col: Column, words: str) -> Column:
    """The words occur one after the other."""
    inside = F.concat(F.lit(" "), F.array_join(T.tokenize(col), " "), F.lit(" "))
    return F.contains(inside, F.lit(f" {' '.join(T.query_tokens(words))} "))


def proximity(docs: DataFrame, text: Column, terms: list[str], distance: int) -> DataFrame:
    """Documents where words containing each term stand within ``distance``: ``ord, span, score``.

    The smallest span over all terms, by a running last position of each term; the
    positions of one document are one window.
    """
    tokens = docs.select("ord", F.posexplode(T.tokenize(text)).alias("pos", "tok"))
    marked = tokens.select("ord", "pos", *[F.when(F.contains("tok", F.lit(t)), F.col("pos")).alias(f"p{i}") for i, t in enumerate(terms)])
    some = F.lit(False)
    for i in range(len(terms)):
        some = some | F.col(f"p{i}").isNotNull()
    w = Window.partitionBy("ord").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    last = marked.filter(some).select("ord", "pos", *[F.last(f"p{i}", ignorenulls=True).over(w).alias(f"l{i}") for i in range(len(terms))])
    full = F.lit(True)
    for i in range(len(terms)):
        full = full & F.col(f"l{i}").isNotNull()
    least = F.least(*[F.col(f"l{i}") for i in range(len(terms))]) if len(terms) > 1 else F.col("l0")
    spans = last.filter(full).groupBy("ord").agg(F.min(F.col("pos") - least).cast("bigint").alias("span"))
    return spans.filter(F.col("span") <= distance).withColumn("score", F.round(1 / (1 + F.col("span")), 6))


def vector_topk(vectors: DataFrame, query: DataFrame, k: int = 10) -> DataFrame:
    """The k vectors nearest to one query vector (one row, column ``q``) by cosine: ``ord, score``."""
    met = vectors.crossJoin(F.broadcast(query.limit(1)))  # one row
    return met.filter(F.size("v") == F.size("q")).select("ord", F.round(T.cosine(F.col("v"), F.col("q")), 6).alias("score")).orderBy(F.desc("score"), "ord").limit(k)


def quantize(vectors: DataFrame) -> DataFrame:
    """Scalar quantisation to 0..255 by the global minimum and maximum: ``ord, code``."""
    v = F.transform("v", lambda x: x.cast("double"))
    bounds = vectors.agg(F.min(F.array_min(v)).alias("lo"), F.max(F.array_max(v)).alias("hi"))
    scale = (F.col("hi") - F.col("lo")) / 255
    code = F.transform(v, lambda x: F.greatest(F.lit(0), F.least(F.lit(255), F.when(F.col("hi") > F.col("lo"), F.round((x - F.col("lo")) / scale)).otherwise(0.0).cast("int"))))
    return vectors.crossJoin(F.broadcast(bounds)).select("ord", code.alias("code"), "lo", scale.alias("scale"))


def weighted_layers(layers: dict[str, tuple[DataFrame, float]], k: int = 10) -> DataFrame:
    """Hybrid score: layers (``ord, score``) by normalised weights; a missing layer counts 0.

    A zero-weight layer is left out.  Ties go to the smaller ord.
    """
    used = {n: (df, w) for n, (df, w) in layers.items() if w > 0}
    total = sum(w for _, w in used.values())
    rows = None
    for df, w in used.values():
        part = df.select("ord", (F.col("score") * (w / total)).alias("score"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("ord").agg(F.round(F.sum("score"), 6).alias("score")).orderBy(F.desc("score"), "ord").limit(k)


def min_max(df: DataFrame, col: str = "score") -> DataFrame:
    """Scores scaled to 0..1 over the whole result; 1 where all are equal, 0 where all are 0."""
    w = df.agg(F.min(col).alias("lo"), F.max(col).alias("hi"))
    scaled = F.when(F.col("hi") > F.col("lo"), (F.col(col) - F.col("lo")) / (F.col("hi") - F.col("lo"))).when(F.col("hi") == 0, 0.0).otherwise(1.0)
    return df.crossJoin(F.broadcast(w)).withColumn(col, scaled).drop("lo", "hi")


def suggestions(names: DataFrame, col: str, query: str, k: int = 5) -> DataFrame:
    """Distinct names similar to the query but not equal: similarity in (0.5, 1), best k."""
    scored = names.select(F.col(col).alias("suggestion")).distinct().withColumn("score", F.round(T.similarity(F.col("suggestion"), F.lit(query)), 6))
    return scored.filter("score > 0.5 and score < 1").orderBy(F.desc("score"), "suggestion").limit(k)


def corrections(vocabulary: DataFrame, col: str, tokens: DataFrame, max_distance: int = 2, min_length: int = 4) -> DataFrame:
    """``token, corrected``: the nearest vocabulary word within the distance; ties change nothing.

    Candidates meet tokens by deletion neighbours, an equi-join that no pair within the
    distance escapes: words at an edit distance of d share a string after at most d deletions from each.
    """

    def deletions(word: Column) -> Column:
        out = F.array(word)
        for _ in range(max_distance):
            out = F.array_distinct(F.concat(out, F.flatten(F.transform(out, lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.length(w), F.lit(1))), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))))))
        return out

    v = vocabulary.select(F.lower(col).alias("word")).distinct()
    t = tokens.select(F.lower("token").alias("token")).distinct()
    long = t.filter(F.length("token") >= min_length)
    met = long.select("token", F.explode(deletions(F.col("token"))).alias("key")).join(v.select("word", F.explode(deletions(F.col("word"))).alias("key")), "key").select("token", "word").distinct()
    near = met.withColumn("d", F.levenshtein("token", "word")).filter(F.col("d") <= max_distance)
    best = near.groupBy("token").agg(F.min("d").alias("d"))
    only = near.join(best, ["token", "d"]).groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.min("word").alias("word"))
    return t.join(only, "token", "left").select("token", F.when(F.col("n") == 1, F.col("word")).otherwise(F.col("token")).alias("corrected"))
