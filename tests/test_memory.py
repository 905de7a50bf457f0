"""Memory operators with nulls, ties, repeats and empty tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from quillgraph.operators import dedup, graph, memory, records, search, temporal

ENTITY = "ord long, name string, tags array<string>, importance double, entity_type string, project_id string, created_at timestamp, modified_at timestamp, is_latest boolean, status string, observations array<string>, parent string"


def entities(spark):
    rows = [(1, "a", ["X"], 5.0, "t", "p", None, None, None, None, ["o"], None), (2, "b", None, None, "t", "p", None, None, False, "published", [], "a"), (3, None, [], 1.0, None, None, None, None, True, "draft", None, "a")]
    return spark.createDataFrame(rows, ENTITY)


def ords(df):
    return sorted(r.ord for r in df.select("ord").collect())


def test_filters(spark):
    e = entities(spark)
    assert ords(e.filter(memory.full_filter())) == [1]
    assert ords(e.filter(memory.full_filter(superseded=True))) == [1, 2]
    assert ords(e.filter(memory.full_filter(superseded=True, least=0))) == [1]
    assert ords(e.filter(memory.full_filter(created=("2020-01-01", None)))) == []
    assert ords(e.filter(memory.full_filter(tags=["x"], statuses=("draft", "published")))) == [1]
    assert [r.s for r in e.orderBy("ord").select(memory.full_symbolic().alias("s")).collect()] == [0.5] * 3
    assert [r.s for r in e.orderBy("ord").select(memory.full_symbolic(parent="a").alias("s")).collect()] == [None, 1.0, 1.0]
    assert [r.s for r in e.orderBy("ord").select(memory.full_symbolic(importance=(5, 5)).alias("s")).collect()] == [1.0, 1.0, None]
    assert e.limit(0).filter(memory.full_filter()).collect() == []
    assert ords(e.filter(memory.like_any("A", F.col("name"), F.col("entity_type")))) == [1]


def test_changes(spark):
    old = spark.createDataFrame([("a", ["t"], 1)], "name string, tags array<string>, created_at int")
    new = spark.createDataFrame([("a", ["z"], 2), ("b", ["B", "b"], 3), ("b", ["late"], 4), ("c", None, 1)], old.schema)
    assert {r.name: r.tags for r in memory.create_entities(old, new).collect()} == {"a": ["t"], "b": ["b"], "c": None}
    e = entities(spark)
    assert [r.t for r in e.orderBy("ord").select(memory.change_tags(["N"], ["x"]).alias("t")).collect()] == [["n"]] * 3
    assert [r.o for r in e.orderBy("ord").select(memory.change_observations(e, F.array(F.lit("o"), F.lit("p")), F.array(F.lit("o"))).alias("o")).collect()] == [["p"]] * 3
    assert ords(memory.forget_observation(e, "none")) == [1] and ords(memory.forget_observation(e, "o")) == []
    rel = spark.createDataFrame([("a", "b", "r")], "src string, dst string, relation_type string")
    nodes = spark.createDataFrame([("a",), ("b",), ("a",)], "node string")
    asked = spark.createDataFrame([("a", "b", "r"), ("b", "a", "r"), ("b", "a", "r"), ("a", "z", "r")], rel.schema)
    assert sorted(r.status for r in memory.create_relations(rel, asked, nodes).collect()) == ["created", "dangling", "existing"]
    base = spark.createDataFrame([("a", "v", 1), ("b", "v", 2)], "name string, value string, version int")
    changes = spark.createDataFrame([("a", None, None), ("b", "w", 1)], "name string, value string, expected int")
    assert sorted(map(tuple, memory.update_entities(base, changes, "value").collect())) == [("a", "v", 2, "updated"), ("b", "v", 2, "conflict")]
    refused = memory.governed(e, named=F.col("name").isNotNull(), typed=F.col("importance") > 2)
    assert [r.refused_by for r in refused.orderBy("ord").collect()] == [None, "typed", "named"]


def test_scores(spark):
    rows = [("u", 1, True), ("u", 2, False), ("u", 3, True), ("v", 1, False)]
    rates = {r.k: (r.runs, r.rate) for r in memory.success_rates(spark.createDataFrame(rows, "k string, at int, ok boolean"), "k", F.col("ok"), ["at"]).collect()}
    rate = 0.5
    for ok in (1, 0, 1):
        rate += 0.2 * (ok - rate)
    assert rates == {"u": (3, round(rate, 6)), "v": (1, 0.4)}
    text = spark.createDataFrame([("",), (None,), ("x" * 10_000,)], "t string")
    assert [r.s for r in text.select(memory.turn_importance(F.col("t")).alias("s")).collect()] == [0.0, 0.0, 5.0]
    claims = spark.createDataFrame([("s", 2, None, "verified"), ("s", 1, 0.5, "verified"), ("s", 3, 0.4, "odd")], "subject string, ord long, confidence double, trust string")
    assert memory.resolve_conflicts(claims, "subject", "trust_level").first().winner == 1
    assert memory.resolve_conflicts(claims, "subject", "highest_confidence").first().winner == 1


def test_dedup_and_order(spark):
    texts = spark.createDataFrame([("a b c d",), ("a b c e",), ("x",), (None,), ("",), ("a b c d",)], "content string")
    assert sorted(map(tuple, dedup.similar_observations(texts, 0.6).collect())) == [("a b c d", "a b c d"), ("a b c e", "a b c d")]
    assert dedup.similar_observations(texts.limit(0), 0.6).collect() == []
    turns = spark.createDataFrame([(1, 1, "hello there friend"), (1, 2, "Hello  there friend"), (1, 3, "hello there fr1 zz"), (1, 4, None), (1, 5, "other")], "conv_id int, turn int, text string")
    assert sorted(map(tuple, dedup.turn_duplicates(turns).collect())) == [(1, 2, "exact"), (1, 3, "prefix")]
    ledger = spark.createDataFrame([(1, i, v) for i, v in enumerate(["a", "b", "a", "a", None, "b"])], "k int, at int, v string")
    assert sorted(r["at"] for r in temporal.regressions(ledger, ["k"], "v", "at").collect()) == [2]
    assert [r.x for r in spark.createDataFrame([(None,), ("an Idiot",)], "t string").select(records.excluded(F.col("t"), ["idiot"]).alias("x")).collect()] == [False, True]


def test_ranked_search_with_null_and_empty_texts(spark):
    docs = spark.createDataFrame([(1, "red fox, red"), (2, None), (3, ""), (4, "the red dog"), (5, "redder")], "ord long, t string")
    assert [r.ord for r in search.bm25(docs, F.col("t"), "red the").collect()] == [1, 4]
    assert [r.ord for r in search.tfidf(docs, F.col("t"), "red").collect()] == [1, 4]
    assert sorted(r.ord for r in search.documents_with(docs, F.col("t"), ["red", "dog"], True).collect()) == [4]
    assert search.bm25(docs.limit(0), F.col("t"), "red").collect() == []


def test_graph_paths_and_stats(spark):
    rel = spark.createDataFrame([("c1", "n1"), ("n1", "r1"), ("c2", "c2")], "src string, dst string").withColumn("relation_type", F.lit("r"))
    assert [r.path for r in graph.upward_paths(rel, "c").collect()] == [["c1", "n1", "r1"]]
    assert {r.node: (r.degree, r.share) for r in memory.degree_map(rel).collect()} == {"c1": (1, 0.5), "n1": (2, 1.0), "r1": (1, 0.5), "c2": (1, 0.5)}
    nodes = rel.select(F.explode(F.array("src", "dst")).alias("node"))
    ranks = {r.node: r.score for r in graph.pagerank(nodes, rel, iterations=50).collect()}
    assert abs(sum(ranks.values()) - 1) < 1e-6 and ranks["r1"] > ranks["n1"] > ranks["c1"]
