"""The queries of this subpackage: one for each operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, context_mixing, conversation_repair, exact_dedup, language_id, packing, pivot_search, quality, surrogates, token_counts, token_store, trie_join, vector_codes
from .language_id import fold

#: The public tokenizer file of the token queries; its place is looked up where it is read.
TOKENIZER = "word_bpe_49k.json"
#: The key of the surrogate query; a deployment has a secret one.
SURROGATE_KEY = "surrogate-key"
#: The public tokenizer file of the token counts.
COUNT_TOKENIZER = "byte_bpe_50k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs.filter(fold(docs["doc_id"], 4) != 2))
    return language_id.predict(docs, model).withColumn("held_out", fold(F.col("doc_id"), 4) == 2)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.fit(docs, labels.filter(fold(labels["doc_id"], 5) != 0))
    return quality.predict(docs, model, threshold=0.3).withColumn("held_out", fold(F.col("doc_id"), 5) == 0)


def op3_pivot_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return pivot_search.top_k(vectors, F.pmod(vectors["vec_id"], F.lit(100)) == 0, k=10)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op5_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.replace_entities(table(spark, sf_dir, "documents"), SURROGATE_KEY).select("doc_id", "text", "n_entities")


def op6_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode_decode(table(spark, sf_dir, "documents"), bpe.public_path(TOKENIZER))
    return coded.select(
        "doc_id",
        F.expr("cast(length(ids) div 4 as bigint)").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op7_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return context_mixing.score_corpus(docs, fold(docs["doc_id"], 10) != 0).withColumn("held_out", fold(F.col("doc_id"), 10) == 0)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), bpe.public_path(TOKENIZER), capacity=2048, end_id=0)


def op9_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    manifest = token_store.write_store(docs, bpe.public_path(TOKENIZER), end_id=1)
    stored = token_store.read_store(manifest, docs.schema["doc_id"].dataType.simpleString())
    return stored.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op10_trie_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie_join.near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=90)


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(table(spark, sf_dir, "embeddings"), parts=16, entries=64, rounds=2, factor=256)


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), bpe.public_path(COUNT_TOKENIZER), limit=512)


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return conversation_repair.repair(conversation_repair.damaged(rows), ids=rows)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_quality": op2_quality,
    "op3_pivot_search": op3_pivot_search,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_surrogates": op5_surrogates,
    "op6_bpe_encode_decode": op6_bpe_encode_decode,
    "op7_context_mixing": op7_context_mixing,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_token_store": op9_token_store,
    "op10_trie_join": op10_trie_join,
    "op11_vector_codes": op11_vector_codes,
    "op12_token_counts": op12_token_counts,
    "op13_conversation_repair": op13_conversation_repair,
}

ORACLES: dict[str, str] = {
    "op3_pivot_search": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
                   WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
                     AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
             p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
                   FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
             r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM p)
        SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 10""",
    "op4_exact_dedup": r"""
        WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
             g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY norm)
        SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(n.norm) AS text_sha256
        FROM n JOIN g ON n.norm = g.norm""",
    "op11_vector_codes": """
        WITH RECURSIVE v AS MATERIALIZED (
                 SELECT row_number() OVER (ORDER BY vec_id) - 1 AS n, vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
                 FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
             p AS MATERIALIZED (SELECT n, vec_id, label, part, v[4 * part + 1] AS a, v[4 * part + 2] AS b, v[4 * part + 3] AS c, v[4 * part + 4] AS d FROM v, (SELECT unnest(range(16)) AS part)),
             c0 AS MATERIALIZED (SELECT part, n AS entry, a, b, c, d FROM p WHERE n < 64),
             a1 AS MATERIALIZED (SELECT n, part, min({'d': (p.a - c0.a) ** 2 + (p.b - c0.b) ** 2 + (p.c - c0.c) ** 2 + (p.d - c0.d) ** 2, 'e': entry}) AS s FROM p JOIN c0 USING (part) GROUP BY ALL),
             m1 AS (SELECT part, s.e AS entry, floor(sum(a) / count(*)) AS a, floor(sum(b) / count(*)) AS b, floor(sum(c) / count(*)) AS c, floor(sum(d) / count(*)) AS d FROM p JOIN a1 USING (n, part) GROUP BY ALL),
             c1 AS MATERIALIZED (SELECT part, entry, coalesce(m1.a, c0.a) AS a, coalesce(m1.b, c0.b) AS b, coalesce(m1.c, c0.c) AS c, coalesce(m1.d, c0.d) AS d FROM c0 LEFT JOIN m1 USING (part, entry)),
             a2 AS MATERIALIZED (SELECT n, part, min({'d': (p.a - c1.a) ** 2 + (p.b - c1.b) ** 2 + (p.c - c1.c) ** 2 + (p.d - c1.d) ** 2, 'e': entry}) AS s FROM p JOIN c1 USING (part) GROUP BY ALL),
             m2 AS (SELECT part, s.e AS entry, floor(sum(a) / count(*)) AS a, floor(sum(b) / count(*)) AS b, floor(sum(c) / count(*)) AS c, floor(sum(d) / count(*)) AS d FROM p JOIN a2 USING (n, part) GROUP BY ALL),
             c2 AS MATERIALIZED (SELECT part, entry, coalesce(m2.a, c1.a) AS a, coalesce(m2.b, c1.b) AS b, coalesce(m2.c, c1.c) AS c, coalesce(m2.d, c1.d) AS d FROM c1 LEFT JOIN m2 USING (part, entry)),
             a3 AS MATERIALIZED (SELECT n, part, min({'d': (p.a - c2.a) ** 2 + (p.b - c2.b) ** 2 + (p.c - c2.c) ** 2 + (p.d - c2.d) ** 2, 'e': entry}) AS s FROM p JOIN c2 USING (part) GROUP BY ALL),
             r AS (SELECT n, string_agg(printf('%02x', CAST(s.e AS BIGINT)), '' ORDER BY part) AS code, CAST(sum(s.d) AS BIGINT) AS error FROM a3 GROUP BY n),
             h AS (SELECT sha256(string_agg(concat_ws(',', CAST(a AS BIGINT), CAST(b AS BIGINT), CAST(c AS BIGINT), CAST(d AS BIGINT)), ',' ORDER BY part, entry)) AS sha FROM c2)
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, sha AS codebooks_sha256 FROM v JOIN r USING (n), h""",
    "op13_conversation_repair": r"""
        WITH RECURSIVE d AS (
                 SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                        xor(list_reduce(list_concat([4294967295], list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda c: CAST(ord(c) AS BIGINT))),
                            lambda x, y: list_reduce([xor(x, y), 0, 0, 0, 0, 0, 0, 0, 0], lambda u, z: xor(u >> 1, 3988292384 * (u & 1)))), 4294967295) % 20 AS damage
                 FROM conversations),
             e AS (SELECT conv_id, turn, CASE damage WHEN 4 THEN 'user' ELSE role END AS role,
                          CASE damage WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(CASE damage WHEN 3 THEN [1, 2] ELSE [1] END) AS copy
                   FROM d WHERE damage <> 0),
             t AS (SELECT *, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS solid, dense_rank() OVER (ORDER BY conv_id) AS k,
                          row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM e),
             f AS MATERIALIZED (
                 SELECT conv_id, turn, role, text, k, i, left(role, 1) AS initial,
                        CASE WHEN solid = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY k, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN right(solid, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
                        lag(left(role, 1)) OVER (PARTITION BY k ORDER BY i) AS initial_before FROM t),
             nxt(q, after, turned) AS (VALUES (0, 2, 'user'), (1, 2, 'user'), (2, 3, 'assistant'), (3, 2, 'user')),
             keep(q, initial, after) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
             ins(q, after, cost, letters, turns) AS (
                 SELECT q, q, 0, '', '' FROM nxt
                 UNION ALL SELECT q, after, 3, 'I', turned || ':' || chr(10) FROM nxt
                 UNION ALL SELECT a.q, b.after, 6, 'II', a.turned || ':' || chr(10) || b.turned || ':' || chr(10) FROM nxt a JOIN nxt b ON a.after = b.q),
             arcs AS MATERIALIZED (
                 SELECT k, i, q, 4 AS cost, 'D' AS letter, q AS after, '' AS line FROM f, nxt
                 UNION ALL SELECT k, i, q, 3 + 3 * CAST(fault = 'truncated' AS INTEGER), 'R', after, turned || ':' || text || chr(10) FROM f, nxt WHERE fault IN ('', 'truncated')
                 UNION ALL SELECT k, i, q, 3 * CAST(fault = 'truncated' AS INTEGER), 'K', after, role || ':' || text || chr(10) FROM f JOIN keep USING (initial) WHERE fault IN ('', 'truncated')),
             way AS (SELECT DISTINCT k, CAST(0 AS BIGINT) AS i, 0 AS q, {'cost': CAST(0 AS BIGINT), 'audit': '', 'lines': ''} AS w FROM f
                     UNION ALL
                     SELECT way.k, way.i + 1, arcs.after, min({'cost': CAST(w.cost + ins.cost + arcs.cost AS BIGINT), 'audit': w.audit || ins.letters || arcs.letter, 'lines': w.lines || ins.turns || arcs.line})
                     FROM way JOIN ins ON way.q = ins.q JOIN arcs ON arcs.k = way.k AND arcs.i = way.i + 1 AND arcs.q = ins.after GROUP BY way.k, way.i, arcs.after),
             n AS (SELECT conv_id, k, max(i) AS last, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
                          count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (i > 1 AND initial_before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id, k),
             best AS (SELECT way.k, min({'cost': w.cost + ins.cost, 'audit': w.audit || ins.letters, 'lines': w.lines || ins.turns}) AS w
                      FROM way JOIN n ON n.k = way.k AND way.i = n.last JOIN ins ON ins.q = way.q WHERE ins.after IN (0, 3) GROUP BY way.k),
             c AS (SELECT DISTINCT conv_id FROM conversations)
        SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(w.cost, 0) AS cost,
               coalesce(w.audit, '') AS audit, sha256(coalesce(left(w.lines, length(w.lines) - 1), '')) AS repaired_sha256
        FROM c LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN best USING (k)""",
}
