"""The inverted index: reads its own buckets only, and changes equal a rebuild."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from quillgraph.functions import text as T
from quillgraph.operators import search, text_index
from quillgraph.session import shared_path

WORDS = ["red", "Red", "blue", "fox", "the", "of", "naïve", "x_1", "snow,", "(snow)", "long"]
QUERIES = ["red fox", "RED, red! fox?", "the of", "snow x_1 absent", "", "x-1"]


def texts(spark, rows):
    return spark.createDataFrame(rows, "ord long, text string")


def ranked(df):
    return [tuple(r) for r in df.collect()]


def same_as_scan(spark, folder, state):
    docs = texts(spark, list(state.items()))
    for q in QUERIES[:3]:
        assert ranked(text_index.bm25(spark, folder, q, 5)) == ranked(search.bm25(docs, F.col("text"), q, 5)), q
        assert ranked(text_index.tfidf(spark, folder, q, 5)) == ranked(search.tfidf(docs, F.col("text"), q, 5)), q


def written_text(r):
    return r.choice([None, "", " ".join(r.choice(WORDS) for _ in range(r.randint(1, 8))), "long " * 300 + "fox red"])


def test_any_changes_equal_a_rebuild(spark):
    r = random.Random(8)
    state = {i: written_text(r) for i in range(30)}
    folder = shared_path(spark, "index")
    text_index.build(texts(spark, list(state.items())), folder, buckets=4)
    same_as_scan(spark, folder, state)
    for step in range(3):
        changes = [(r.randint(0, 40), written_text(r), r.choice(["put", "put", "remove", None]), at) for at in range(12)]
        for i, text, op, _ in changes:
            if op == "remove":
                state.pop(i, None)
            else:
                state[i] = text
        text_index.apply_changes(spark.createDataFrame([*changes, (None, "red", "put", 99)], "ord long, text string, op string, at int").repartition(3), folder)
        if step == 1:
            text_index.compact(spark, folder)
    same_as_scan(spark, folder, state)
    now = text_index.manifest(spark, folder)
    assert (now["version"], now["texts"], len(now["segments"])) == (5, len(state), 2)
    assert now["tokens"] == sum(len(T.query_tokens((t or "").replace("ï", " "))) for t in state.values())


def test_a_query_reads_its_words_buckets_only(spark):
    folder = shared_path(spark, "index")
    text_index.build(texts(spark, [(i, f"w{i} w{i + 1} the") for i in range(200)]), folder, buckets=16)
    _, rows = text_index.postings_of(spark, folder, ["w7"])
    plan = rows._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan
    assert "EqualTo(term,w7)" in plan or "In(term, [w7])" in plan
    read = {p for p in rows.inputFiles()}
    assert sorted(x.ord for x in rows.collect()) == [6, 7] and read


def test_a_repeated_batch_does_no_harm_and_versions_are_written_once(spark):
    folder = shared_path(spark, "index")
    with pytest.raises(ValueError, match="no index"):
        text_index.bm25(spark, folder, "red")
    text_index.build(texts(spark, [(1, "red"), (2, "blue")]), folder, buckets=2)
    with pytest.raises(ValueError, match="already"):
        text_index.build(texts(spark, [(1, "red")]), folder)
    more = spark.createDataFrame([(3, "red red", "put", 1)], "ord long, text string, op string, at int")
    first = text_index.apply_changes(more, folder, "s", 0)
    assert text_index.apply_changes(more, folder, "s", 0) == first and first["texts"] == 3
    with pytest.raises(RuntimeError, match="another"):
        text_index._commit(spark, folder, first)


def test_a_stream_equals_the_batch(spark):
    r = random.Random(3)
    start = {i: written_text(r) for i in range(10)}
    parts = [[(r.randint(0, 15), written_text(r), r.choice(["put", "remove"]), 10 * p + at) for at in range(5)] for p in range(3)]
    source, folder, checkpoint = (shared_path(spark, n) for n in ("changes", "index", "progress"))
    schema = "ord long, text string, op string, at int"
    text_index.build(texts(spark, list(start.items())), folder, buckets=2)
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        text_index.maintain(stream, folder, checkpoint).awaitTermination()
        for i, text, op, _ in part:
            if op == "remove":
                start.pop(i, None)
            else:
                start[i] = text
    same_as_scan(spark, folder, start)
    assert text_index.manifest(spark, folder)["version"] == 4


def test_queries_are_tokenised(spark):
    docs = texts(spark, [(1, "the vendor, a Brand!"), (2, "brand brand"), (3, None)])
    assert [o for o, _ in ranked(search.bm25(docs, F.col("text"), "vendor, brand!"))] == [1, 2]
    one, two = (dict(ranked(search.bm25(docs, F.col("text"), q))) for q in ("vendor", "vendor vendor"))
    assert two[1] == pytest.approx(2 * one[1], abs=2e-6)
    assert [o for o, _ in ranked(search.tfidf(docs, F.col("text"), "vendor?"))] == [1]
    assert docs.filter(search.phrase(F.col("text"), "vendor, a (brand)")).count() == 1


def test_words_are_counted_in_their_own_task(spark):
    """No text's words are shuffled to be counted, however long it is, and the counts are right."""
    docs = texts(spark, [(1, "b a B " + "long " * 300), (2, ""), (3, None), (4, "?!"), (5, "naïve the x_1")])
    found = text_index._analysed(docs)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    got = {r.ord: ({t.term: t.tf for t in r.terms}, r.words, r.tokens) for r in found.collect()}
    assert got == {1: ({"a": 1, "b": 2, "long": 300}, 302, 303), 2: ({}, 0, 0), 3: ({}, 0, 0), 4: ({}, 0, 0), 5: ({"na": 1, "ve": 1, "the": 1, "x_1": 1}, 3, 4)}


def test_an_update_finds_the_texts_before_it_without_sorting_their_words(spark):
    folder = shared_path(spark, "index")
    text_index.build(texts(spark, [(i, f"w{i} red") for i in range(20)]), folder, buckets=2)
    text_index.apply_changes(spark.createDataFrame([(1, "blue", "put", 1), (2, None, "remove", 1)], "ord long, text string, op string, at int"), folder)
    now = text_index.current_documents(spark, folder, text_index.manifest(spark, folder))
    assert "SortAggregate" not in now._jdf.queryExecution().executedPlan().toString()
    got = {r.ord: {t.term for t in r.terms} for r in now.collect()}
    assert got == {i: {"blue"} if i == 1 else {f"w{i}", "red"} for i in range(20) if i != 2}


def test_postings_lie_by_the_hash_of_their_term(spark):
    folder = shared_path(spark, "index")
    text_index.build(texts(spark, [(i, " ".join(f"w{i * j % 97}" for j in range(9))) for i in range(300)]), folder, buckets=4)
    now, rows = text_index.postings_of(spark, folder, ["w7"])
    found = text_index._read(spark, folder, now, "postings").select(F.input_file_name().alias("file"), "bucket", "term", "key")
    assert found.filter("key <> xxhash64(term)").isEmpty() and found.select("bucket").distinct().count() == 4
    for file in {r.file for r in found.select("file").distinct().collect()}:
        keys = [r.key for r in spark.read.parquet(file).select("key").collect()]
        assert keys == sorted(keys)
    assert {r.term for r in rows.collect()} == {"w7"} and "EqualTo(key" in rows._jdf.queryExecution().toString()
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == "0"
