"""The registered queries over the smallest tables, against SQL or brute force; and the pipeline."""

from __future__ import annotations

import hashlib
import zlib

import corpus_pipeline
import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from quillgraph.llm import bpe, language_id, packing, queries, token_store
from test_matching import brute_components
from tokenizers import Tokenizer

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def library():
    out = Tokenizer.from_file(bpe.public_path(queries.TOKENIZER))
    out.no_truncation()
    out.no_padding()
    return out


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def fold(i, n):
    return zlib.crc32(str(i).encode()) % n


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_against_sql(spark, name):
    got = queries.QUERIES[name](spark, SF)
    db = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = db.execute(queries.ORACLES[name])
    names = [c[0] for c in want.description]
    assert sorted(map(str, want.fetchall())) == sorted(str(tuple(r)) for r in got.select(*names).collect())


def test_op1(spark, rows):
    got = {r.doc_id: r for r in queries.op1_language_id(spark, SF).collect()}
    assert set(got) == {i for i, _ in rows} and all(got[i].held_out == (fold(i, 4) == 2) and 0 <= got[i].score <= 1 for i, _ in rows)
    true = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").filter("lang is not null and text is not null").collect()}
    held = [i for i in true if got[i].held_out and got[i].lang_pred != "und"]
    assert np.mean([got[i].lang_pred == true[i] for i in held]) > 0.9


def test_op2(spark, rows):
    got = {r.doc_id: r for r in queries.op2_quality(spark, SF).collect()}
    assert set(got) == {i for i, _ in rows}
    assert all(r.held_out == (fold(i, 5) == 0) and r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for i, r in got.items())


def test_op5(spark, rows):
    got = {r.doc_id: r for r in queries.op5_surrogates(spark, SF).collect()}
    assert all((got[i].text == t) == (got[i].n_entities == 0) for i, t in rows)
    assert any(r.n_entities for r in got.values())


def test_op6(spark, rows, library):
    got = {r.doc_id: r for r in queries.op6_bpe_encode_decode(spark, SF).collect()}
    for i, t in rows:
        ids = ids_of(library, t)
        assert got[i].n_tokens == len(ids) and got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_op7(spark, rows):
    got = {r.doc_id: r for r in queries.op7_context_mixing(spark, SF).collect()}
    assert set(got) == {i for i, _ in rows} and all(r.held_out == (fold(i, 10) == 0) and r.score < 0 for i, r in got.items())


def test_op7_predicts_held_out_texts_better_than_word_counts(spark):
    total = queries.op7_context_mixing(spark, "/root/testdata/sf0.01").filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert total[0] > 0.95 * total[1]


def pieces_of(library, rows, end, capacity):
    out = []
    for i, t in rows:
        ids = [*ids_of(library, t), end]
        out += [(i, n, n * capacity, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for n in range(-(-len(ids) // capacity)) for x in [ids[n * capacity : (n + 1) * capacity]]]
    return out


def assert_packed(placed, capacity):
    by: dict[int, list] = {}
    for r in placed:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        ends = np.cumsum([n for _, n in sorted(parts)])
        assert [o for o, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] <= capacity
    assert len(by) <= packing.least_bins([r.length for r in placed], capacity) * 1.01 + 1


def test_op8(spark, rows, library):
    placed = queries.op8_best_fit_packing(spark, SF).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in placed) == sorted(pieces_of(library, rows, 0, 2048))
    assert_packed(placed, 2048)


def test_op9(spark, rows, library):
    at, want = 0, []
    for i, t in sorted(rows):
        ids = [*ids_of(library, t), 1]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in queries.op9_token_store(spark, SF).collect()) == want


def test_lookup_asks_the_shards_of_a_key(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").repartition(9)
    manifest = token_store.write_store(docs, bpe.public_path(queries.TOKENIZER))
    wanted = docs.select("doc_id").filter("doc_id % 3 = 0").unionByName(spark.range(10**9, 10**9 + 5).select(F.col("id").alias("doc_id")))
    stored = {r.doc_id: bytes(r.ids) for r in token_store.read_store(manifest).collect()}
    found = token_store.lookup(manifest, wanted).collect()
    assert {r.key: bytes(r.ids) for r in found} == {k: v for k, v in stored.items() if k % 3 == 0} and len(found) == sum(k % 3 == 0 for k in stored)


def test_op10(spark, rows):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op10_trie_join(spark, SF).collect()}
    assert got == brute_components(rows, 3, 90)


# -- the pipeline ------------------------------------------------------------------------

WORDS = {"en": "the of and to in is that for with was".split(), "de": "der die und von zu mit ist nicht das ein".split()}


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Texts of two languages with exact and near copies, junk, entities, nulls and a long text."""
    rng = np.random.default_rng(6)
    rows = []
    for i in range(160):
        lang = ("en", "de")[i % 2]
        rows.append((i, " ".join(rng.choice(WORDS[lang], 30).tolist() + [f"w{i}x{j}" for j in range(4)]), lang))
    rows += [(200 + i, rows[i][1].replace(" ", "  "), rows[i][2]) for i in range(10)]  # exact but for blanks
    rows += [(300 + i, rows[i][1] + " tail", rows[i][2]) for i in range(20, 30)]  # near
    rows += [(400, None, "en"), (401, "", None), (402, "12 34 !!", "en"), (403, "the of and to Mr Smith and ann@example.org in the", "en"), (404, " ".join(["the and of to in"] * 900), "en")]
    frame = spark.createDataFrame([(i, t, g, "src", len(t or "")) for i, t, g in rows], "doc_id long, text string, lang string, source string, n_chars int")
    folder = str(tmp_path_factory.mktemp("corpus"))
    frame.repartition(3).write.parquet(f"{folder}/documents.parquet")
    return folder


def test_pipeline(spark, corpus, library):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "exact dedup", "n-gram Jaccard join", "PII surrogates", "best-fit packing"]
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    at = {0: docs}
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        at[k + 1] = stage(spark, at[k], corpus).cache()
        if k < 4:
            assert at[k + 1].columns == docs.columns
    kept = [sorted((r.doc_id, r.text) for r in at[k].select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect()) for k in range(5)]
    # Language: texts without a letter go; of the others those that the fitted model calls ambiguous.
    model = language_id.fit(docs.filter(language_id.fold(docs["doc_id"], 4) != 2))
    clear = {r.doc_id for r in language_id.predict(docs, model).filter("lang_pred <> 'und' and not ambiguous").collect()}
    assert {i for i, _ in kept[1]} == clear and not clear & {400, 401, 402} and len(clear) > 150
    # Exact: the least id of each text.
    first: dict[str, int] = {}
    for i, t in kept[1]:
        first.setdefault(" ".join(t.split()), i)
    assert [i for i, _ in kept[2]] == sorted(first.values())
    # Near: the least id of each component.
    want = {c for _, c in brute_components(kept[2], 5, 80).values()}
    assert {i for i, _ in kept[3]} == want and not want & set(range(320, 330))
    # Personal data: only the text with entities changes.
    changed = {i for (i, a), (_, b) in zip(kept[3], kept[4], strict=True) if a != b}
    assert changed == {403} and "Smith" not in dict(kept[4])[403] and "ann@" not in dict(kept[4])[403]
    assert at[4].filter("doc_id = 403 and n_chars = length(text)").count() == 1
    # Packing: all pieces of all texts.
    placed = at[5].collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in placed) == sorted(pieces_of(library, kept[4], 0, 2048))
    assert_packed(placed, 2048)


def test_pipeline_run_equals_its_stages(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, corpus)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, corpus_pipeline.run(spark, corpus).select(*columns).collect())) == sorted(map(tuple, docs.select(*columns).collect()))


def test_stages_take_odd_tables(spark, corpus):
    odd = spark.createDataFrame([(None, None, None, None, None, 9), (7, "", None, "s", 0, 9), (7, "the and of to in", "en", "s", 16, 9), (7, "the and of to in", "en", "s", 16, 9), (7, "der die das und mit", "de", "s", 19, 9)], "doc_id long, text string, lang string, source string, n_chars int, n_entities int")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        for table in (odd, odd.limit(0)):
            out = stage(spark, table, corpus)
            n = out.count()
            assert n <= table.count() and (k == 4 or out.columns == table.columns)
    # An id with two texts: each text is decided by itself, and equal rows leave one.
    near = corpus_pipeline.drop_near_copies(spark, odd.filter("text is not null"), corpus)
    assert sorted(r.text for r in near.collect()) == ["", "der die das und mit", "the and of to in"]
    assert [r.n_entities for r in corpus_pipeline.replace_personal_data(spark, odd.limit(1), corpus).collect()] == [9]


def test_near_copies_are_dropped_without_a_shuffle_of_all_texts(spark):
    texts = {i: " ".join(f"w{i}x{j}" for j in range(30)) for i in range(40)}
    texts[41] = texts[7] + " end"
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars int")
    left = corpus_pipeline.drop_near_copies(spark, docs, "")
    plan = left._jdf.queryExecution().optimizedPlan()
    assert plan.nodeName() == "Union" and "Join" not in plan.children().head().toString()
    assert sorted(r.doc_id for r in left.collect()) == list(range(40))
