"""Queries over the test tables, one for each operator, each with its DuckDB twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import scoring
from .functions import text as T
from .operators import access, dedup, graph, mutate, search, temporal
from .plans.boolean_query import compile_query
from .sources.views import GEO_SQL, SUPPLY_SQL, contains_relations, document_entities, geo_relations, part_entities, supply_relations, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

STOP_SQL = ", ".join(f"'{w}'" for w in T.BM25_STOP_WORDS)
TOKENS_SQL = r"list_filter(regexp_split_to_array(regexp_replace(lower({0}), '[^\w\s]', ' ', 'g'), '\s+'), lambda t: t <> '')"
ALNUM_SQL = r"list_filter(regexp_split_to_array(lower({0}), '[^a-z0-9]+'), lambda t: t <> '')"
JACCARD_SQL = "CASE WHEN len(list_distinct(list_concat({0}, {1}))) > 0 THEN len(list_intersect({0}, {1})) / len(list_distinct(list_concat({0}, {1}))) ELSE 0 END"
#: Entities of documents and parts as the views give them.
DOC_SQL = "doc AS (SELECT doc_id AS ord, CAST(doc_id AS VARCHAR) AS name, lang AS entity_type, text AS obs, source FROM documents)"
PART_SQL = "part_e AS (SELECT p_partkey AS ord, p_name || ' #' || p_partkey AS name, p_type AS entity_type, concat_ws(' ', p_name, p_type) AS obs, lower(p_brand) AS tag, CAST(p_size % 11 AS DOUBLE) AS importance FROM part)"
NOW = "2024-02-01 00:00:00"


def query(sql: str | None = None) -> Callable:
    """Registers a query under its function's name, with its SQL if there is one."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _sup_nodes(spark: SparkSession, d: str) -> DataFrame:
    return supply_relations(spark, d).select(F.explode(F.array("src", "dst")).alias("node")).distinct()


def _geo_nodes(spark: SparkSession, d: str) -> DataFrame:
    return geo_relations(spark, d).select(F.explode(F.array("src", "dst")).alias("node")).distinct()


def _parents(spark: SparkSession, d: str) -> DataFrame:
    return geo_relations(spark, d).select(F.col("src").alias("node"), F.col("dst").alias("parent"))


# -- search --------------------------------------------------------------------------


@query(f"""
    WITH d AS (SELECT doc_id AS ord, list_filter({TOKENS_SQL.format('text')}, lambda t: t NOT IN ({STOP_SQL})) AS tokens FROM documents),
         s AS (SELECT ord, len(tokens) AS dl, tokens FROM d),
         tot AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM s),
         q AS (SELECT unnest(['tion', 'ther', 'erin']) AS term),
         tf AS (SELECT s.ord, s.dl, q.term, len(list_filter(s.tokens, lambda t: t = q.term)) AS tf FROM s, q),
         df AS (SELECT term, count(*) FILTER (tf > 0) AS df FROM tf GROUP BY term),
         sc AS (SELECT tf.ord, sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score, max(tf) AS hit
                FROM tf JOIN df USING (term), tot GROUP BY tf.ord)
    SELECT ord, round(score, 6) AS score FROM sc WHERE hit > 0 ORDER BY score DESC, ord LIMIT 10""")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return search.bm25(table(spark, d, "documents").withColumnRenamed("doc_id", "ord"), F.col("text"), "tion ther erin")


@query(f"""
    WITH s AS (SELECT doc_id AS ord, {TOKENS_SQL.format('text')} AS tokens FROM documents),
         q AS (SELECT unnest(['tion', 'ther', 'erin']) AS term),
         tf AS (SELECT s.ord, greatest(len(tokens), 1) AS dl, term, len(list_filter(tokens, lambda t: t = term)) AS tf FROM s, q),
         df AS (SELECT term, count(*) FILTER (tf > 0) AS df FROM tf GROUP BY term), tot AS (SELECT count(*) AS n FROM s),
         sc AS (SELECT ord, round(sum(CASE WHEN df > 0 THEN tf / dl * ln(n / df) ELSE 0 END), 6) AS score FROM tf JOIN df USING (term), tot GROUP BY ord)
    SELECT ord, score FROM sc WHERE score > 0 ORDER BY score DESC, ord LIMIT 10""")
def tfidf_topk(spark: SparkSession, d: str) -> DataFrame:
    return search.tfidf(table(spark, d, "documents").withColumnRenamed("doc_id", "ord"), F.col("text"), "tion ther erin")


@query("SELECT doc_id AS ord FROM documents WHERE contains(lower(text), 'tion the') OR contains(lower(lang), 'tion the') OR contains(CAST(doc_id AS VARCHAR), 'tion the')")
def basic_search(spark: SparkSession, d: str) -> DataFrame:
    return search.basic_search(document_entities(spark, d), "tion the").select("ord")


@query("SELECT doc_id AS ord FROM documents WHERE contains(lower(lang), 'en') AND (contains(lower(text), 'ther') OR contains(lower(lang), 'ther') OR contains(lower(source), 'ther') OR contains(lower(text), 'src9') OR contains(lower(source), 'src9')) AND NOT contains(lower(text), 'idiot')")
def field_boolean_search(spark: SparkSession, d: str) -> DataFrame:
    return document_entities(spark, d).filter(compile_query("type:en AND (ther OR src9) NOT observation:idiot")).select("ord")


@query("SELECT o_orderkey AS ord FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-06-30'")
def date_range_search(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.filter(F.col("o_orderdate").between(F.to_timestamp(F.lit("1996-01-01")), F.to_timestamp(F.lit("1996-06-30")))).select(F.col("o_orderkey").alias("ord"))


@query(f"WITH {PART_SQL} SELECT ord, 1.0::DOUBLE AS score FROM part_e WHERE tag IN ('brand#11', 'brand#23') AND importance BETWEEN 3 AND 8")
def symbolic_filter(spark: SparkSession, d: str) -> DataFrame:
    return part_entities(spark, d).select("ord", access.symbolic_score(["Brand#11", "brand#23"], None, (3, 8)).alias("score")).filter("score is not null")


@query(f"WITH {PART_SQL} SELECT ord FROM part_e WHERE tag IN ('brand#11', 'brand#12') AND importance >= 2 AND importance <= 9")
def filter_chain(spark: SparkSession, d: str) -> DataFrame:
    return part_entities(spark, d).filter(access.filter_chain(tags=["brand#11", "BRAND#12"], least=2, most=9)).select("ord")


@query("SELECT doc_id AS ord FROM documents ORDER BY doc_id LIMIT 50 OFFSET 100")
def pagination(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("ord")).orderBy("ord").offset(100).limit(50)


@query(f"SELECT doc_id AS ord FROM documents WHERE contains(' ' || array_to_string({TOKENS_SQL.format('text')}, ' ') || ' ', ' of the ')")
def phrase_search(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").filter(search.phrase(F.col("text"), "of the")).select(F.col("doc_id").alias("ord"))


@query("SELECT p_partkey AS ord FROM part WHERE regexp_full_match(lower(p_name), '(?s)s.*e.?')")
def wildcard_search(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    return p.filter(search.glob(F.col("p_name"), "S*e?") | search.glob(F.col("p_name"), "S*e")).select(F.col("p_partkey").alias("ord"))


@query(f"""
    WITH t AS (SELECT doc_id AS ord, {TOKENS_SQL.format('text')} AS toks FROM documents),
         p AS (SELECT ord, unnest(toks) AS tok, unnest(range(len(toks))) AS pos FROM t),
         a AS (SELECT ord, pos FROM p WHERE contains(tok, 'tionth')), b AS (SELECT ord, pos FROM p WHERE contains(tok, 'herin')),
         m AS (SELECT a.ord, min(abs(a.pos - b.pos)) AS span FROM a JOIN b USING (ord) GROUP BY a.ord)
    SELECT ord, CAST(span AS BIGINT) AS span, round(1 / (1 + span), 6) AS score FROM m WHERE span <= 20""")
def proximity_pair(spark: SparkSession, d: str) -> DataFrame:
    return search.proximity(table(spark, d, "documents").withColumnRenamed("doc_id", "ord"), F.col("text"), ["tionth", "herin"], 20)


@query(f"""
    WITH t AS (SELECT DISTINCT doc_id AS ord, unnest({TOKENS_SQL.format('text')}) AS term FROM documents)
    SELECT ord FROM t WHERE term IN ('the', 'tion', 'of') GROUP BY ord HAVING count(*) = 3""")
def posting_intersect(spark: SparkSession, d: str) -> DataFrame:
    return search.documents_with(table(spark, d, "documents").withColumnRenamed("doc_id", "ord"), F.col("text"), ["the", "tion", "of"], True)


@query(f"""
    WITH t AS (SELECT DISTINCT doc_id AS ord, unnest({TOKENS_SQL.format('text')}) AS term FROM documents)
    SELECT DISTINCT ord FROM t WHERE term IN ('ther', 'erin')""")
def posting_union(spark: SparkSession, d: str) -> DataFrame:
    return search.documents_with(table(spark, d, "documents").withColumnRenamed("doc_id", "ord"), F.col("text"), ["ther", "erin"], False)


@query("""
    WITH n AS (SELECT p_partkey AS ord, lower(p_name) AS n, lower(p_type) AS t, list_filter(regexp_split_to_array(lower(concat_ws(' ', p_name, p_type)), '\\s+'), lambda w: w <> '') AS w, lower(concat_ws(' ', p_name, p_type)) AS o, lower(p_name || ' #' || p_partkey) AS name FROM part),
         x AS (SELECT ord, unnest(list_concat([name, t, o], w)) AS v FROM n)
    SELECT DISTINCT ord FROM x WHERE v = 'medum' OR contains(v, 'medum') OR contains('medum', v) OR 1 - levenshtein(v, 'medum') / greatest(length(v), 5) >= 0.7""")
def fuzzy_search(spark: SparkSession, d: str) -> DataFrame:
    return search.fuzzy(part_entities(spark, d), "medum", 0.7).select("ord")


@query("""
    WITH n AS (SELECT DISTINCT p_name AS name FROM part),
         g AS (SELECT name, CASE WHEN length(name) >= 3 THEN list_distinct(list_transform(range(1, length(name) - 1), lambda i: substring(lower(name), i, 3))) ELSE [lower(name)] END AS g FROM n),
         q AS (SELECT list_distinct(list_transform(range(1, length('small ring') - 1), lambda i: substring('small ring', i, 3))) AS q)
    SELECT name, round(len(list_intersect(g, q)) / len(list_distinct(list_concat(g, q))), 6) AS score FROM g, q
    WHERE round(len(list_intersect(g, q)) / len(list_distinct(list_concat(g, q))), 6) >= 0.2""")
def ngram_jaccard(spark: SparkSession, d: str) -> DataFrame:
    return search.ngram_matches(table(spark, d, "part").select(F.col("p_name").alias("name")).distinct(), "name", "small ring")


@query("""
    WITH q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 7)
    SELECT vec_id AS ord, round(greatest(-1, least(1, list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(q AS DOUBLE[])))), 6) AS score FROM embeddings, q ORDER BY score DESC, ord LIMIT 10""")
def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return search.vector_topk(e.select(F.col("vec_id").alias("ord"), F.col("embedding").alias("v")), e.filter("vec_id = 7").select(F.col("embedding").alias("q")))


@query("""
    WITH b AS (SELECT min(list_min(CAST(embedding AS DOUBLE[]))) AS lo, max(list_max(CAST(embedding AS DOUBLE[]))) AS hi FROM embeddings)
    SELECT vec_id AS ord, CAST(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: greatest(0, least(255, CAST(round((x - lo) / ((hi - lo) / 255)) AS INTEGER))))) AS BIGINT) AS code_sum FROM embeddings, b""")
def vector_quantized(spark: SparkSession, d: str) -> DataFrame:
    q = search.quantize(table(spark, d, "embeddings").select(F.col("vec_id").alias("ord"), F.col("embedding").alias("v")))
    return q.select("ord", F.aggregate("code", F.lit(0).cast("bigint"), lambda s, x: s + x).alias("code_sum"))


def _layers(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = document_entities(spark, d)
    lexical = docs.select("ord", T.word_count(F.lower(F.col("observations")[0]), "ther").cast("double").alias("score")).filter("score > 0")
    return lexical, docs.filter("entity_type = 'en'").select("ord", F.lit(1.0).alias("score"))


LAYERS_SQL = f"lex AS (SELECT doc_id AS ord, CAST(len(list_filter({TOKENS_SQL.format('text')}, lambda t: t = 'ther')) AS DOUBLE) AS score FROM documents), sym AS (SELECT doc_id AS ord, 1.0 AS score FROM documents WHERE lang = 'en')"


@query(f"""
    WITH {LAYERS_SQL}, m AS (SELECT greatest(max(score), 1) AS top FROM lex WHERE score > 0),
    u AS (SELECT ord, score / top * 0.6 AS s FROM lex, m WHERE score > 0 UNION ALL SELECT ord, score * 0.4 FROM sym)
    SELECT ord, round(sum(s), 6) AS score FROM u GROUP BY ord ORDER BY score DESC, ord LIMIT 10""")
def hybrid_weighted(spark: SparkSession, d: str) -> DataFrame:
    lexical, symbolic = _layers(spark, d)
    top = lexical.agg(F.greatest(F.max("score"), F.lit(1.0)).alias("top"))
    scaled = lexical.crossJoin(F.broadcast(top)).select("ord", (F.col("score") / F.col("top")).alias("score"))
    return search.weighted_layers({"lexical": (scaled, 0.3), "symbolic": (symbolic, 0.2)})


@query(f"""
    WITH {LAYERS_SQL}, l AS (SELECT * FROM lex WHERE score > 0), m AS (SELECT min(score) AS lo, max(score) AS hi FROM l),
    u AS (SELECT ord, CASE WHEN hi > lo THEN (score - lo) / (hi - lo) WHEN hi = 0 THEN 0 ELSE 1 END * 0.4 / 0.6 AS s FROM l, m UNION ALL SELECT ord, 1.0 * 0.2 / 0.6 FROM sym)
    SELECT ord, round(sum(s), 6) AS score FROM u GROUP BY ord ORDER BY score DESC, ord LIMIT 10""")
def hybrid_minmax(spark: SparkSession, d: str) -> DataFrame:
    lexical, symbolic = _layers(spark, d)
    return search.weighted_layers({"lexical": (search.min_max(lexical), 0.4), "symbolic": (search.min_max(symbolic), 0.2)})


@query("""
    WITH n AS (SELECT DISTINCT p_name AS suggestion FROM part), s AS (SELECT suggestion, round(1 - levenshtein(lower(suggestion), 'smal ring') / greatest(length(suggestion), 9), 6) AS score FROM n)
    SELECT suggestion, score FROM s WHERE score > 0.5 AND score < 1 ORDER BY score DESC, suggestion LIMIT 5""")
def suggestions(spark: SparkSession, d: str) -> DataFrame:
    return search.suggestions(table(spark, d, "part"), "p_name", "smal ring")


@query("""
    WITH v AS (SELECT DISTINCT unnest(string_split(lower(p_name), ' ')) AS word FROM part), t AS (SELECT unnest(['smal', 'rnig', 'larg', 'zzzzzz', 'ab']) AS token),
         c AS (SELECT token, word, levenshtein(token, word) AS d FROM t, v WHERE length(token) >= 4 AND levenshtein(token, word) <= 2),
         b AS (SELECT token, min(d) AS d FROM c GROUP BY token),
         o AS (SELECT c.token, count(*) AS n, min(word) AS word FROM c JOIN b ON c.token = b.token AND c.d = b.d GROUP BY c.token)
    SELECT t.token, CASE WHEN n = 1 THEN word ELSE t.token END AS corrected FROM t LEFT JOIN o ON t.token = o.token""")
def query_correction(spark: SparkSession, d: str) -> DataFrame:
    words = table(spark, d, "part").select(F.explode(F.split(F.lower("p_name"), " ")).alias("word"))
    return search.corrections(words, "word", spark.createDataFrame([(t,) for t in ("smal", "rnig", "larg", "zzzzzz", "ab")], "token string"))


# -- text ----------------------------------------------------------------------------


@query(r"""
    SELECT doc_id AS ord, sha256(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text,
      '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b', '<EMAIL>', 'g'), '\b\d{3}-\d{2}-\d{4}\b', '<SSN>', 'g'), '\b(?:\d{13,19}|\d{4}(?:[ -]\d{4}){2,4})\b', '<CC>', 'g'),
      '(?:\+?1[\s.-]?)?\(?\d{3}\)?[\s.-]?\d{3}[\s.-]?\d{4}', '<PHONE>', 'g'), '\b(?:\d{1,3}\.){3}\d{1,3}\b', '<IP>', 'g')) AS redacted FROM documents""")
def pii_redact(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("ord"), F.sha2(T.redact(F.col("text")), 256).alias("redacted"))


@query(f"""
    WITH t AS (SELECT item_id AS ord, list_filter(regexp_split_to_array(regexp_replace(text, '[^a-zA-Z0-9\\s]', ' ', 'g'), '\\s+'), lambda w: w <> '') AS w FROM benchmark),
         p AS (SELECT ord, lower(unnest(w)) AS word, unnest(range(len(w))) AS pos, len(w) AS n FROM t)
    SELECT ord, word, round(sum((1 - pos / n * 0.3) * CASE WHEN length(word) > 6 THEN 1.1 ELSE 1 END), 6) AS score FROM p
    WHERE length(word) > 2 AND word NOT IN ({', '.join(f"'{w}'" for w in T.KEYWORD_STOP_WORDS)}) GROUP BY ord, word""")
def keyword_score(spark: SparkSession, d: str) -> DataFrame:
    words = F.filter(F.split(F.regexp_replace("text", r"[^a-zA-Z0-9\s]", " "), r"\s+"), lambda w: w != "")
    rows = table(spark, d, "benchmark").select(F.col("item_id").alias("ord"), words.alias("w")).select("ord", F.size("w").alias("n"), F.posexplode("w").alias("pos", "word")).withColumn("word", F.lower("word"))
    boost = F.lit(1.0)
    for word, weight in T.KEYWORD_BOOSTS.items():
        boost = F.when(F.col("word") == word, F.lit(weight)).otherwise(boost)
    one = (1 - F.col("pos") / F.col("n") * 0.3) * boost * F.when(F.length("word") > 6, 1.1).otherwise(1.0)
    return rows.filter((F.length("word") > 2) & ~F.col("word").isin(T.KEYWORD_STOP_WORDS)).groupBy("ord", "word").agg(F.round(F.sum(one), 6).alias("score"))


@query("""
    WITH c AS (SELECT p_partkey AS ord, unnest(string_split(p_type, '')) AS ch, length(p_type) AS n FROM part), k AS (SELECT ord, ch, n, count(*) AS k FROM c WHERE ch <> '' GROUP BY ALL)
    SELECT ord, round(-sum(k / n * log2(k / n)), 6) AS bits FROM k GROUP BY ord HAVING any_value(n) < 10 OR -sum(k / n * log2(k / n)) >= 1.5""")
def entropy_filter(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select(F.col("p_partkey").alias("ord"), F.length("p_type").alias("n"), T.entropy(F.col("p_type")).alias("bits"))
    return p.filter("n < 10 or bits >= 1.5").select("ord", F.round("bits", 6).alias("bits"))


@query("SELECT item_id AS ord, CAST(ceil(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda t: t <> '')) * 1.3) AS BIGINT) AS tokens FROM benchmark")
def token_estimate(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("ord"), T.token_estimate(F.col("text")).alias("tokens"))


@query("SELECT event_id AS ord, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_extract(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("event_id").alias("ord"), F.get_json_object("props", "$.k").cast("bigint").alias("k"))


# -- graph ---------------------------------------------------------------------------


@query(f"WITH {GEO_SQL} SELECT DISTINCT src AS neighbor FROM geo WHERE dst = 'n3' AND relation_type = 'located_in'")
def neighbors_filtered(spark: SparkSession, d: str) -> DataFrame:
    return graph.neighbors(geo_relations(spark, d), "n3", "both", ["LOCATED_IN"])


@query(f"""
    WITH RECURSIVE {GEO_SQL}, e AS (SELECT src AS a, dst AS b FROM geo UNION ALL SELECT dst, src FROM geo),
    w(node, depth) AS (SELECT 'r1', 0 UNION SELECT e.b, w.depth + 1 FROM w JOIN e ON e.a = w.node WHERE w.depth < 3)
    SELECT node, min(depth) AS depth FROM w GROUP BY node""")
def bfs_depth(spark: SparkSession, d: str) -> DataFrame:
    return graph.bfs(geo_relations(spark, d), spark.createDataFrame([("r1",)], "node string"), 3)


@query(f"""
    WITH RECURSIVE {GEO_SQL}, e AS (SELECT src AS a, dst AS b FROM geo UNION ALL SELECT dst, src FROM geo),
    w(node, depth) AS (SELECT 'c1', 0 UNION SELECT e.b, w.depth + 1 FROM w JOIN e ON e.a = w.node WHERE w.depth < 6)
    SELECT min(depth) AS length FROM w WHERE node = (SELECT 'r' || max(r_regionkey) FROM region) HAVING min(depth) IS NOT NULL""")
def shortest_path_len(spark: SparkSession, d: str) -> DataFrame:
    return graph.shortest_path_length(geo_relations(spark, d), "c1", "r" + str(table(spark, d, "region").agg(F.max("r_regionkey")).first()[0]), 6)


@query(f"""
    WITH RECURSIVE {GEO_SQL}, w(node, path) AS (SELECT 'c1', ['c1'] UNION ALL SELECT g.dst, list_append(w.path, g.dst) FROM w JOIN geo g ON g.src = w.node WHERE NOT list_contains(w.path, g.dst) AND len(w.path) <= 3)
    SELECT array_to_string(path, '>') AS path, len(path) - 1 AS length FROM w WHERE starts_with(node, 'r') AND node = (SELECT 'r' || n_regionkey FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE c_custkey = 1)""")
def all_paths(spark: SparkSession, d: str) -> DataFrame:
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    region = c.filter("c_custkey = 1").join(n, c["c_nationkey"] == n["n_nationkey"]).select(F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("r")).first()["r"]
    return graph.all_paths(geo_relations(spark, d), "c1", region, 3).select(F.array_join("path", ">").alias("path"), F.col("length").cast("bigint").alias("length"))


@query(f"WITH {GEO_SQL}, r AS (SELECT 'n' || n_nationkey AS node, 'r' || n_regionkey AS component FROM nation UNION ALL SELECT 'r' || r_regionkey, 'r' || r_regionkey FROM region), a AS (SELECT * FROM r UNION ALL SELECT g.src, r.component FROM geo g JOIN r ON g.dst = r.node WHERE g.relation_type = 'located_in'), m AS (SELECT component, min(node) AS least FROM a GROUP BY component) SELECT a.node, m.least AS component FROM a JOIN m USING (component) WHERE a.node IN (SELECT src FROM geo UNION SELECT dst FROM geo)")
def components(spark: SparkSession, d: str) -> DataFrame:
    return graph.connected_components(_geo_nodes(spark, d), geo_relations(spark, d))


@query(f"WITH {SUPPLY_SQL}, e AS (SELECT src AS node FROM sup UNION ALL SELECT dst FROM sup), t AS (SELECT count(DISTINCT node) AS n FROM e) SELECT node, count(*) AS degree, round(count(*) / (any_value(n) - 1), 6) AS score FROM e, t GROUP BY node")
def degree_centrality(spark: SparkSession, d: str) -> DataFrame:
    return graph.degree_centrality(_sup_nodes(spark, d), supply_relations(spark, d))


def _pagerank_sql(iterations: int) -> str:
    steps = [f"{SUPPLY_SQL}", "nd AS (SELECT DISTINCT src AS node FROM sup UNION SELECT DISTINCT dst FROM sup)", "nn AS (SELECT count(*) AS n FROM nd)", "o AS (SELECT src, count(*) AS k FROM sup GROUP BY src)", "r0 AS (SELECT node, 1.0::DOUBLE / n AS score FROM nd, nn)"]
    for i in range(iterations):
        steps.append(f"l{i} AS (SELECT coalesce(sum(score), 0) AS lost FROM r{i} WHERE node NOT IN (SELECT src FROM o))")
        steps.append(f"g{i} AS (SELECT dst, sum(score / k) AS got FROM sup JOIN o USING (src) JOIN r{i} ON node = src GROUP BY dst)")
        steps.append(f"r{i + 1} AS (SELECT nd.node, 0.15 / n + 0.85 * lost / n + 0.85 * coalesce(got, 0) AS score FROM nd LEFT JOIN g{i} ON nd.node = g{i}.dst, nn, l{i})")
    return "WITH " + ",\n".join(steps) + f" SELECT node, round(score, 9) AS score FROM r{iterations}"


@query(_pagerank_sql(5))
def pagerank_5iter(spark: SparkSession, d: str) -> DataFrame:
    return graph.pagerank(_sup_nodes(spark, d), supply_relations(spark, d), iterations=5, tolerance=None).select("node", F.round("score", 9).alias("score"))


@query(f"""
    WITH {SUPPLY_SQL}, nd AS (SELECT DISTINCT src AS node FROM sup UNION SELECT DISTINCT dst FROM sup), a AS (SELECT dst AS node, count(*)::DOUBLE AS a FROM sup GROUP BY dst), h AS (SELECT src AS node, sum(a) AS h FROM sup JOIN a ON a.node = sup.dst GROUP BY src),
         na AS (SELECT sqrt(sum(a * a)) AS v FROM a), nh AS (SELECT sqrt(sum(h * h)) AS v FROM h)
    SELECT nd.node, round(coalesce(h, 0) / nh.v, 6) AS hub, round(coalesce(a, 0) / na.v, 6) AS authority FROM nd LEFT JOIN a ON nd.node = a.node LEFT JOIN h ON nd.node = h.node, na, nh""")
def hits_1iter(spark: SparkSession, d: str) -> DataFrame:
    return graph.hits(_sup_nodes(spark, d), supply_relations(spark, d), 1).select("node", F.round("hub", 6).alias("hub"), F.round("authority", 6).alias("authority"))


#: Customers of orders whose keys are one, two or three apart, over all orders.
TRI_SQL = "e AS (SELECT DISTINCT least(a.o_custkey, b.o_custkey) AS a, greatest(a.o_custkey, b.o_custkey) AS b FROM orders a JOIN (SELECT o_custkey, unnest([o_orderkey - 1, o_orderkey - 2, o_orderkey - 3]) AS k FROM orders) b ON a.o_orderkey = b.k WHERE a.o_custkey <> b.o_custkey)"


@query(f"WITH {TRI_SQL} SELECT x.a AS a, x.b AS b, y.b AS c FROM e x JOIN e y ON x.b = y.a JOIN e z ON z.a = x.a AND z.b = y.b")
def triangles(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    later = o.select(F.col("o_custkey").alias("dst"), F.explode(F.array(*[F.col("o_orderkey") - i for i in (1, 2, 3)])).alias("k"))
    return graph.triangles(o.select(F.col("o_custkey").alias("src"), F.col("o_orderkey").alias("k")).join(later, "k").select("src", "dst"))


@query(f"""
    WITH {SUPPLY_SQL}, k AS (SELECT CAST(substring(src, 2) AS BIGINT) % 5 AS cs, CAST(substring(dst, 2) AS BIGINT) % 5 AS cd FROM sup), m AS (SELECT count(*) AS m FROM k),
         i AS (SELECT cs AS c, count(*) AS l FROM k WHERE cs = cd GROUP BY cs), g AS (SELECT c, count(*) AS d FROM (SELECT cs AS c FROM k UNION ALL SELECT cd FROM k) GROUP BY c)
    SELECT round(sum(coalesce(l, 0) / m - (d / (2 * m)) ** 2), 6) AS modularity FROM g LEFT JOIN i USING (c), m""")
def modularity(spark: SparkSession, d: str) -> DataFrame:
    nodes = _sup_nodes(spark, d).withColumn("community", F.substring("node", 2, 20).cast("bigint") % 5)
    return graph.modularity(supply_relations(spark, d), nodes)


@query("SELECT 'n' || c_nationkey AS node, 1 AS depth FROM customer WHERE c_custkey = 1 UNION ALL SELECT 'r' || n_regionkey, 2 FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey = 1")
def ancestors(spark: SparkSession, d: str) -> DataFrame:
    return graph.ancestors(_parents(spark, d), "c1")


@query("SELECT 'n' || n_nationkey AS node, 1 AS depth FROM nation WHERE n_regionkey = 2 UNION ALL SELECT 'c' || c_custkey, 2 FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 2 UNION ALL SELECT 's' || s_suppkey, 2 FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 2")
def descendants(spark: SparkSession, d: str) -> DataFrame:
    return graph.descendants(_parents(spark, d), "r2")


@query(f"WITH {GEO_SQL} SELECT src, dst FROM geo WHERE src IN ('n1', 'n2', 'r1', 'c1', 'c2') AND dst IN ('n1', 'n2', 'r1', 'c1', 'c2')")
def open_nodes_induced(spark: SparkSession, d: str) -> DataFrame:
    names = spark.createDataFrame([(n,) for n in ("n1", "n2", "r1", "c1", "c2")], "name string")
    return search.induced_relations(geo_relations(spark, d), names).select("src", "dst")


@query(f"""
    WITH {GEO_SQL}, o AS (SELECT 'o' || o_orderkey AS name, o_orderdate AS ts FROM orders)
    SELECT 'entities' AS metric, 'order' AS key, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM o
    UNION ALL SELECT 'relations', relation_type, count(*), NULL, NULL FROM geo GROUP BY relation_type
    UNION ALL SELECT 'oldest', (SELECT name FROM o ORDER BY ts, name LIMIT 1), 1, min(ts), min(ts) FROM o
    UNION ALL SELECT 'newest', (SELECT name FROM o ORDER BY ts DESC, name DESC LIMIT 1), 1, max(ts), max(ts) FROM o""")
def graph_stats(spark: SparkSession, d: str) -> DataFrame:
    entities = table(spark, d, "orders").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("name"), F.lit("order").alias("entity_type"), F.col("o_orderdate").alias("ts"))
    return graph.stats(entities, geo_relations(spark, d))


@query(f"WITH {GEO_SQL} SELECT 'isolated' AS issue, 'p' || p_partkey AS node FROM part UNION ALL SELECT 'orphan', src FROM geo WHERE dst IN ('n1') OR src IN ('n1')")
def graph_validate(spark: SparkSession, d: str) -> DataFrame:
    rel = geo_relations(spark, d)
    nodes = _geo_nodes(spark, d).filter("node <> 'n1'").unionByName(table(spark, d, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("node")))
    alone = graph.isolated_nodes(nodes, rel).select(F.lit("isolated").alias("issue"), "node")
    return alone.unionByName(graph.orphaned_relations(rel, nodes).select(F.lit("orphan").alias("issue"), F.col("src").alias("node")))


# -- temporal and events -------------------------------------------------------------


@query("SELECT l_orderkey AS src, l_partkey AS dst, l_linenumber AS line FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderdate <= TIMESTAMP '1995-06-01' AND l_shipdate >= TIMESTAMP '1995-06-01'")
def relation_asof(spark: SparkSession, d: str) -> DataFrame:
    return contains_relations(spark, d).filter(temporal.valid_at(F.col("valid_from"), F.col("valid_until"), "1995-06-01")).select("src", "dst", "line")


@query("WITH c AS (SELECT l_orderkey AS src, l_partkey AS dst, l_linenumber AS line, o_orderdate AS f FROM lineitem JOIN orders ON l_orderkey = o_orderkey) SELECT src, dst, line, CAST(row_number() OVER (PARTITION BY src ORDER BY f NULLS LAST, dst, line) AS INTEGER) AS pos FROM c")
def relation_timeline(spark: SparkSession, d: str) -> DataFrame:
    return temporal.timeline(contains_relations(spark, d), ["src"]).select("src", "dst", "line", "pos")


@query("SELECT o_custkey AS root, o_orderkey AS latest FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1")
def version_latest(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy(F.col("o_custkey").alias("root")).agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("latest"))


@query("""
    WITH s AS (SELECT user_id, event_id, event_type, lag(event_type) OVER w AS p, list(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 2 PRECEDING) AS before FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
    SELECT user_id, event_id FROM s WHERE list_contains(before, event_type) AND event_type <> p""")
def ledger_regressions(spark: SparkSession, d: str) -> DataFrame:
    return temporal.regressions(table(spark, d, "events"), ["user_id"], "event_type", "ts", "event_id").select("user_id", "event_id")


@query("SELECT user_id, event_type AS action, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM events GROUP BY user_id, event_type")
def who_did_what(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("user_id", F.col("event_type").alias("action")).agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query("WITH g AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) SELECT user_id, count(*) AS accesses, max(ts) AS last_access, round(avg(epoch_us(ts) - epoch_us(p)) / 1000000, 3) AS mean_gap FROM g GROUP BY user_id")
def access_stats(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, d, "events").withColumn("gap", F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(w).cast("timestamp")))
    return e.groupBy("user_id").agg(F.count(F.lit(1)).alias("accesses"), F.max("ts").alias("last_access"), F.round(F.avg("gap") / 1000000, 3).alias("mean_gap"))


@query("WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) SELECT user_id, count(*) AS calls, round(avg(CASE WHEN event_type <> 'error' THEN 1.0 ELSE 0 END), 6) AS success_rate FROM r WHERE n <= 20 GROUP BY user_id")
def tool_affordance(spark: SparkSession, d: str) -> DataFrame:
    return temporal.rolling_success(table(spark, d, "events"), "user_id", F.col("event_type") != "error", 20)


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def event_tumbling(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return w.select(F.col("w.start").cast("timestamp_ntz").alias("hour"), "event_type", "n", "total")


@query("WITH g AS (SELECT *, CASE WHEN ts > lag(ts) OVER w + INTERVAL 6 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), k AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS no FROM g) SELECT user_id, CAST(no AS BIGINT) AS session_no, count(*) AS n FROM k GROUP BY 1, 2")
def event_sessions(spark: SparkSession, d: str) -> DataFrame:
    return temporal.sessions(table(spark, d, "events"), "user_id", "ts", "6 hours").groupBy("user_id", "session_no").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, array_to_string(list(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), ',') AS context FROM events")
def event_context_window(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-2, 2)
    return table(spark, d, "events").select("event_id", F.array_join(F.collect_list("event_type").over(w), ",").alias("context"))


@query("SELECT conv_id, turn, role, lead(role) OVER w AS next_role, lag(role) OVER w AS prev_role FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def session_turns(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, d, "conversations").select("conv_id", "turn", "role", F.lead("role").over(w).alias("next_role"), F.lag("role").over(w).alias("prev_role"))


@query("WITH x AS (SELECT conv_id, turn, length(text) AS n, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS used FROM conversations) SELECT conv_id, turn FROM x WHERE used <= 600")
def budget_prefix(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, d, "conversations").withColumn("used", F.sum(F.length("text")).over(w)).filter("used <= 600").select("conv_id", "turn")


@query("WITH x AS (SELECT conv_id, turn, role, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS exchange FROM conversations) SELECT conv_id, CAST(exchange AS BIGINT) AS exchange, count(*) AS turns, min(turn) AS first_turn FROM x GROUP BY 1, 2")
def exchange_chunks(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    x = table(spark, d, "conversations").withColumn("exchange", F.sum((F.col("role") == "user").cast("bigint")).over(w))
    return x.groupBy("conv_id", "exchange").agg(F.count(F.lit(1)).alias("turns"), F.min("turn").alias("first_turn"))


# -- duplicates and scores -----------------------------------------------------------


@query(r"SELECT sha256(trim(regexp_replace(lower(text), '\s+', ' ', 'g'))) AS hash, count(*) AS n, min(doc_id) AS first_ord FROM documents GROUP BY 1 HAVING count(*) >= 2")
def obs_exact_dups(spark: SparkSession, d: str) -> DataFrame:
    return dedup.exact_observations(table(spark, d, "documents").select(F.col("doc_id").alias("ord"), F.col("text").alias("content")))


CUST_SQL = "e AS (SELECT s_suppkey AS ord, lower(s_name) AS name, 'n' || s_nationkey AS t, [CAST(s_nationkey AS VARCHAR)] AS obs, ['x' || (s_suppkey % 2)] AS tags FROM supplier), b AS (SELECT *, dense_rank() OVER (PARTITION BY t ORDER BY substring(name, 1, 2)) AS r FROM e)"


@query(f"""
    WITH {CUST_SQL}, p AS (SELECT x.ord AS a, y.ord AS b, 0.4 * (1 - levenshtein(x.name, y.name) / greatest(length(x.name), length(y.name))) + 0.2 + 0.3 * {JACCARD_SQL.format('x.obs', 'y.obs')} + 0.1 * {JACCARD_SQL.format('x.tags', 'y.tags')} AS score FROM b x JOIN b y ON x.t = y.t AND x.ord < y.ord AND abs(x.r - y.r) <= 1)
    SELECT a, b, round(score, 6) AS score FROM p WHERE round(score, 6) >= 0.9""")
def entity_dup_pairs(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier")
    e = s.select(F.col("s_suppkey").alias("ord"), F.col("s_name").alias("name"), F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("entity_type"), F.array(F.col("s_nationkey").cast("string")).alias("observations"), F.array(F.concat(F.lit("x"), (F.col("s_suppkey") % 2).cast("string"))).alias("tags"))
    return dedup.entity_similarity_pairs(e, 0.9)


@query(f"""
    WITH n AS (SELECT conv_id, turn, text, sha256(trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))) AS h, list_distinct({ALNUM_SQL.format('text')}) AS w FROM conversations),
         j AS (SELECT b.conv_id, b.turn, max(CASE WHEN a.h = b.h THEN 1 ELSE 0 END) AS same, max(CASE WHEN b.turn - a.turn <= 200 THEN {JACCARD_SQL.format('a.w', 'b.w')} END) AS sim,
                max(CASE WHEN b.turn - a.turn <= 200 AND left(a.text, CAST(ceil(0.5 * greatest(length(a.text), length(b.text))) AS INTEGER)) = left(b.text, CAST(ceil(0.5 * greatest(length(a.text), length(b.text))) AS INTEGER)) THEN 1 ELSE 0 END) AS prefix
               FROM n b JOIN n a ON a.conv_id = b.conv_id AND a.turn < b.turn GROUP BY 1, 2)
    SELECT conv_id, turn, CASE WHEN same = 1 THEN 'exact' WHEN prefix = 1 THEN 'prefix' ELSE 'jaccard' END AS tier FROM j WHERE same = 1 OR prefix = 1 OR sim >= 0.2""")
def turn_dedup(spark: SparkSession, d: str) -> DataFrame:
    return dedup.turn_duplicates(table(spark, d, "conversations"), threshold=0.2)


@query("SELECT p_name AS name, min(p_partkey) AS ord, max(CAST(p_size % 11 AS DOUBLE)) AS importance, array_to_string(list_sort(list_distinct(list(lower(p_brand)))), ',') AS tags, count(*) AS merged FROM part GROUP BY p_name")
def merge_entities(spark: SparkSession, d: str) -> DataFrame:
    e = part_entities(spark, d).withColumn("g", F.regexp_extract("name", "^(.*) #", 1))
    return dedup.merge_groups(e, "g").select(F.col("g").alias("name"), "ord", "importance", F.array_join("tags", ",").alias("tags"), "merged")


@query("SELECT l_suppkey AS src, l_partkey AS dst, 'ship_by' AS relation_type, max(l_quantity) AS weight, count(*) AS merged FROM lineitem GROUP BY 1, 2")
def relation_consolidate(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    kind = F.when(F.col("l_linenumber") % 3 == 0, "shipBy").when(F.col("l_linenumber") % 3 == 1, "Ship-By").otherwise("ship by")
    return dedup.consolidate_relations(li.select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), kind.alias("relation_type"), F.col("l_quantity").alias("weight")))


@query("SELECT l_partkey AS subject, l_orderkey AS winner FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate DESC, l_extendedprice DESC, l_orderkey, l_linenumber) AS n FROM lineitem) WHERE n = 1")
def conflict_winners(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    return dedup.conflict_winners(li, "l_partkey", F.desc("l_shipdate"), F.desc("l_extendedprice"), "l_orderkey", "l_linenumber").select(F.col("l_partkey").alias("subject"), F.col("l_orderkey").alias("winner"))


HOURS_SQL = f"(epoch_us(TIMESTAMP '{NOW}') - epoch_us(ts)) / 3600000000"


@query(f"SELECT event_id, round(least(10, greatest(0.1, (event_id % 11) * exp(-ln(2) * greatest({HOURS_SQL}, 0) / (168 * (1 + (event_id % 11) / 10))) * (1 + 0.1 * (event_id % 4) + 0.01 * (event_id % 7)))), 6) AS importance, round(least(1, greatest(0, exp(-ln(2) * {HOURS_SQL} / 24))), 6) AS recency FROM events")
def decay_importance(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    imp = scoring.effective_importance(F.col("ts"), (F.col("event_id") % 11).cast("double"), F.col("event_id") % 4, F.col("event_id") % 7, NOW)
    return e.select("event_id", F.round(imp, 6).alias("importance"), F.round(scoring.recency(F.col("ts"), NOW), 6).alias("recency"))


@query(f"WITH f AS (SELECT event_id, 0.6 * CASE WHEN event_id % 2 = 0 THEN greatest(0, 1 - {HOURS_SQL} * 3600000 / 1000000000) ELSE exp(-ln(2) * {HOURS_SQL} / 168) END + 0.4 * 0.5 AS f FROM events) SELECT CASE WHEN f >= 0.5 THEN 'fresh' WHEN f > 0.25 THEN 'stale' ELSE 'expired' END AS state, count(*) AS n, round(avg(f), 6) AS mean FROM f GROUP BY 1")
def freshness_report(spark: SparkSession, d: str) -> DataFrame:
    f = scoring.freshness(F.col("ts"), F.when(F.col("event_id") % 2 == 0, F.lit(1_000_000_000)), F.lit(0.5), NOW)
    e = table(spark, d, "events").select(f.alias("f"))
    return e.groupBy(F.when(F.col("f") >= 0.5, "fresh").when(F.col("f") > 0.25, "stale").otherwise("expired").alias("state")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("f"), 6).alias("mean"))


@query(f"WITH u AS (SELECT user_id, count(*) AS n, max(ts) AS ts FROM events GROUP BY user_id), m AS (SELECT max(n) AS top FROM u) SELECT user_id, round(0.25 * 0.5 + 0.25 * least(1, greatest(0, exp(-ln(2) * {HOURS_SQL} / 24))) + 0.2 * ln(1 + n) / ln(1 + top) + 0.1, 6) AS salience FROM u, m ORDER BY salience DESC, user_id LIMIT 20")
def salience_topk(spark: SparkSession, d: str) -> DataFrame:
    u = table(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("ts"))
    met = u.crossJoin(F.broadcast(u.agg(F.max("n").alias("top"))))
    s = scoring.salience(F.lit(0.5), scoring.recency(F.col("ts"), NOW), F.ln(1 + F.col("n")) / F.ln(1 + F.col("top")), F.lit(0.0), F.lit(1.0))
    return met.select("user_id", F.round(s, 6).alias("salience")).orderBy(F.desc("salience"), "user_id").limit(20)


@query(f"""
    WITH t AS (SELECT quality, unnest({TOKENS_SQL.format('text')}) AS tok FROM documents JOIN labels USING (doc_id)), c AS (SELECT tok, count(*) FILTER (quality = 1) AS s, count(*) FILTER (quality = 0) AS f FROM t GROUP BY tok)
    SELECT tok, round(s / (s + f + 1), 6) AS confidence FROM c WHERE s >= 2 AND s >= 2 * f""")
def contrastive_rules(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select("quality", F.explode(T.tokenize(F.col("text"))).alias("tok"))
    c = t.groupBy("tok").agg(F.count_if(F.col("quality") == 1).alias("s"), F.count_if(F.col("quality") == 0).alias("f"))
    return c.filter("s >= 2 and s >= 2 * f").select("tok", F.round(F.col("s") / (F.col("s") + F.col("f") + 1), 6).alias("confidence"))


# -- access, changes, exports --------------------------------------------------------


@query("SELECT c_custkey AS ord FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_nationkey = 3 AND c_acctbal >= 0")
def rls_filter(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    return c.filter(access.row_filter(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), F.col("c_nationkey") == 3, F.col("c_acctbal") >= 0)).select(F.col("c_custkey").alias("ord"))


RULES = [("c_mktsegment", "BUILDING", "allow", 5, "r1"), ("c_mktsegment", "MACHINERY", "deny", 5, "r2"), ("c_nationkey", "3", "deny", 5, "r3"), ("c_nationkey", "4", "allow", 9, "r4")]


@query(f"""
    WITH r(attribute, value, effect, priority, rule_id) AS (VALUES {', '.join(map(str, RULES))}),
         q AS (SELECT c_custkey AS request, 'c_mktsegment' AS attribute, c_mktsegment AS value FROM customer UNION ALL SELECT c_custkey, 'c_nationkey', CAST(c_nationkey AS VARCHAR) FROM customer),
         m AS (SELECT request, effect, rule_id, row_number() OVER (PARTITION BY request ORDER BY priority DESC, CASE WHEN effect = 'deny' THEN 0 ELSE 1 END, rule_id) AS n FROM q JOIN r USING (attribute, value))
    SELECT c_custkey AS request, coalesce(effect, 'deny') AS effect, rule_id FROM customer LEFT JOIN (SELECT * FROM m WHERE n = 1) ON request = c_custkey""")
def abac_decision(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    attrs = F.array(F.struct(F.lit("c_mktsegment").alias("attribute"), F.col("c_mktsegment").alias("value")), F.struct(F.lit("c_nationkey").alias("attribute"), F.col("c_nationkey").cast("string").alias("value")))
    requests = c.select(F.col("c_custkey").alias("request"), F.inline(attrs))
    rules = spark.createDataFrame(RULES, "attribute string, value string, effect string, priority int, rule_id string")
    return access.decide(requests, F.broadcast(rules), "request")


@query("SELECT p_name AS name, CASE WHEN a AND b THEN 'updated' WHEN a THEN 'kept' ELSE 'added' END AS status FROM (SELECT p_name, bool_or(p_partkey % 2 = 0) AS a, bool_or(p_partkey % 3 = 0) AS b FROM part GROUP BY p_name) WHERE a OR b")
def import_merge(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    side = lambda n: p.filter(F.col("p_partkey") % n == 0).groupBy(F.col("p_name").alias("name")).agg(F.collect_set("p_type").alias("observations"))
    return mutate.import_merge(side(2), side(3), "name").select("name", "status")


@query("SELECT p_partkey AS ord FROM part WHERE p_size % 11 < 2 OR lower(p_brand) = 'brand#11'")
def archive_select(spark: SparkSession, d: str) -> DataFrame:
    return mutate.archive(part_entities(spark, d), below=2, tags=["brand#11"]).select("ord")


@query("SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' ELSE 'changed' END AS change FROM (SELECT o_orderkey AS k, o_totalprice AS v FROM orders WHERE o_orderkey % 3 <> 0) a FULL JOIN (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE o_totalprice END AS v FROM orders WHERE o_orderkey % 4 <> 0) b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL OR a.v IS DISTINCT FROM b.v")
def snapshot_diff(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"))
    new = o.filter("k % 4 <> 0").withColumn("v", F.when(F.col("k") % 5 == 0, F.lit(0.0)).otherwise(F.col("v")))
    return mutate.snapshot_diff(o.filter("k % 3 <> 0"), new, "k", "v")


@query(f"WITH {GEO_SQL} SELECT CASE WHEN src = 'n3' THEN 'nation-three' ELSE src END AS src, CASE WHEN dst = 'n3' THEN 'nation-three' ELSE dst END AS dst, relation_type FROM geo")
def rename_rewrite(spark: SparkSession, d: str) -> DataFrame:
    return mutate.rename(geo_relations(spark, d), spark.createDataFrame([("n3", "nation-three")], "old string, new string"))


@query("SELECT l_orderkey, l_partkey, max_by(l_quantity, l_linenumber * 1000 + l_quantity) AS quantity FROM lineitem GROUP BY 1, 2")
def last_writer_wins(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", (F.col("l_linenumber") * 1000 + F.col("l_quantity")).alias("line"), F.col("l_quantity").alias("quantity"))
    return mutate.last_writer(li, ["l_orderkey", "l_partkey"], "line").select("l_orderkey", "l_partkey", "quantity")


@query(f"WITH {PART_SQL} SELECT name AS s, 'type' AS p, entity_type AS o FROM part_e UNION ALL SELECT name, 'observation', obs FROM part_e UNION ALL SELECT name, 'tag', tag FROM part_e")
def export_triples(spark: SparkSession, d: str) -> DataFrame:
    return mutate.triples(part_entities(spark, d))


@query("SELECT doc_id AS ord, md5(CASE WHEN regexp_matches(s, '[,\"\\n\\r]') THEN '\"' || replace(s, '\"', '\"\"') || '\"' ELSE s END) AS cell FROM (SELECT doc_id, CASE WHEN regexp_matches(text, '^[=+\\-@\\t\\r]') THEN '''' || text ELSE text END AS s FROM documents)")
def export_csv(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("ord"), F.md5(T.csv_cell(F.col("text"))).alias("cell"))
