"""Hand-computed fixtures and metamorphic checks of the graph and search operators."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quillgraph import session
from quillgraph.functions import text as T
from quillgraph.operators import access, dedup, graph, mutate, search, temporal
from quillgraph.plans.boolean_query import QueryError, compile_query
from quillgraph.sources import views

TREE = [("A", "B"), ("B", "C"), ("C", "D"), ("B", "E"), ("C", "F"), ("E", "G")]


@pytest.fixture(scope="module")
def tree(spark):
    edges = spark.createDataFrame(TREE, "src string, dst string")
    nodes = spark.createDataFrame([(n,) for n in "ABCDEFGH"], "node string")
    return nodes, edges


def as_dict(df):
    return {r[0]: r[1] for r in df.collect()}


def test_bfs_depths(spark, tree):
    start = spark.createDataFrame([("A",)], "node string")
    assert as_dict(graph.bfs(tree[1], start, 5, "outgoing")) == {"A": 0, "B": 1, "C": 2, "E": 2, "D": 3, "F": 3, "G": 3}


def test_shortest_path(tree):
    assert graph.shortest_path_length(tree[1], "A", "G", 6).collect()[0][0] == 3
    assert graph.shortest_path_length(tree[1], "A", "H", 6).collect() == []


def test_components(tree):
    found = as_dict(graph.connected_components(*tree))
    assert set(found.values()) == {"A", "H"} and found["G"] == "A"


def test_degree_centrality(tree):
    rows = {r.node: r.score for r in graph.degree_centrality(*tree).collect()}
    assert rows["B"] == pytest.approx(3 / 7, abs=1e-6) and rows["E"] == pytest.approx(2 / 7, abs=1e-6) and rows["H"] == 0


def test_pagerank_tasks_are_as_many_as_the_relations_take(spark, monkeypatch):
    """Double relations weigh, unknown ends are dropped, and tasks come by the number of relations, not by a setting."""
    edges = spark.createDataFrame([("a", "b"), ("a", "b"), ("a", "c"), ("b", "c"), ("c", "a"), ("x", "a"), ("b", "y")], "src string, dst string")
    nodes = spark.createDataFrame([(n,) for n in "abcd"], "node string")
    few = as_dict(graph.pagerank(nodes, edges, iterations=5, tolerance=None))
    monkeypatch.setattr(session, "TASK_BYTES", 100)
    monkeypatch.setattr(graph, "TASK_BYTES", 100)
    asked = []
    monkeypatch.setattr(graph, "dealt", lambda df, size, *keys: asked.append((size, keys)) or session.dealt(df, size, *keys))
    assert as_dict(graph.pagerank(nodes, edges, iterations=5, tolerance=None)) == pytest.approx(few)
    assert asked[:2] == [(700, ("dst",)), (2380, ("src",))] and asked[2:] == [(1400, ("src",))] * 5
    r = {n: 0.25 for n in "abcd"}
    for _ in range(5):
        lost = 0.15 / 4 + 0.85 * r["d"] / 4
        r = {"a": lost + 0.85 * r["c"], "b": lost + 0.85 * r["a"] * 2 / 3, "c": lost + 0.85 * (r["a"] / 3 + r["b"]), "d": lost}
    assert few == pytest.approx(r)


def test_supply_relations_come_in_tasks_by_their_number(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(session, "TASK_BYTES", 50_000)
    found = views.supply_relations(spark, sf_dir)
    assert found.rdd.getNumPartitions() >= 150 * 6000 // 50_000
    assert found.agg(F.sum("weight")).first()[0] == spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()


def test_pagerank_sums_to_one(tree):
    assert sum(r.score for r in graph.pagerank(*tree).collect()) == pytest.approx(1.0)


def test_triangle(spark):
    edges = spark.createDataFrame([("X", "Y"), ("Y", "Z"), ("Z", "X"), ("W", "X")], "src string, dst string")
    assert [tuple(r) for r in graph.triangles(edges).collect()] == [("X", "Y", "Z")]


def test_modularity_of_two_triangles(spark):
    edges = spark.createDataFrame([(f"{g}{i}", f"{g}{j}") for g in "ab" for i, j in ((1, 2), (2, 3), (3, 1))], "src string, dst string")
    nodes = spark.createDataFrame([(f"{g}{i}", g) for g in "ab" for i in (1, 2, 3)], "node string, community string")
    assert graph.modularity(edges, nodes).collect()[0][0] == pytest.approx(0.5)


def test_hierarchy(spark):
    parents = spark.createDataFrame([("Root1", None), ("Child1", "Root1"), ("Grandchild1", "Child1"), ("Child2", "Root1"), ("Root2", None)], "node string, parent string")
    assert as_dict(graph.ancestors(parents, "Grandchild1")) == {"Child1": 1, "Root1": 2}
    assert set(as_dict(graph.descendants(parents, "Root1"))) == {"Child1", "Child2", "Grandchild1"}


def test_all_paths_and_causal_product(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "d"), ("a", "c"), ("c", "d"), ("d", "a")], "src string, dst string")
    paths = graph.all_paths(edges, "a", "d", 4)
    assert {tuple(r.path) for r in paths.collect()} == {("a", "b", "d"), ("a", "c", "d")}
    strength = spark.createDataFrame([("a", "b", 0.5), ("b", "d", 0.5), ("a", "c", 0.9)], "src string, dst string, strength double")
    assert {tuple(r.path): r.score for r in graph.path_scores(paths, strength).collect()} == {("a", "b", "d"): 0.25, ("a", "c", "d"): 0.9}


def test_asof_bounds(spark):
    row = spark.createDataFrame([(1,)], "id int").select(F.to_timestamp(F.lit("2025-06-01")).alias("f"), F.to_timestamp(F.lit("2026-03-01")).alias("u"))
    held = [row.filter(temporal.valid_at(F.col("f"), F.col("u"), t)).count() for t in ("2025-05-31", "2025-06-01", "2026-03-01", "2026-03-02")]
    assert held == [0, 1, 1, 0]


def test_entity_similarity(spark):
    e = spark.createDataFrame([(1, "Alice Smith", "p", ["x"], []), (2, "Alice Smyth", "p", ["x"], []), (3, "Bob Jones", "p", ["y"], []), (4, "Alice Smith", "q", ["x"], [])], "ord long, name string, entity_type string, observations array<string>, tags array<string>")
    (row,) = dedup.entity_similarity_pairs(e, 0.8).collect()
    assert (row.a, row.b) == (1, 2) and row.score == pytest.approx(0.9596, abs=1e-4)


@pytest.mark.parametrize(
    "query, want",
    [("vendor AND brand", {1}), ("vendor OR other", {1, 2}), ("NOT vendor", {2, 3}), ("type:t2 (other OR third)", {2, 3}), ('"two words"', {3}), ("tag:red", {2}), ("nothing", set())],
)
def test_boolean_query(spark, query, want):
    e = spark.createDataFrame([(1, "vendor brand", "t1", ["first"], []), (2, "other", "t2", ["second"], ["Red"]), (3, "third", "t2", ["two words"], [])], "ord long, name string, entity_type string, observations array<string>, tags array<string>")
    assert {r.ord for r in e.filter(compile_query(query)).collect()} == want


@pytest.mark.parametrize("query", ["", "(a", "a)", "AND", "a AND", "x" * 6000])
def test_bad_boolean_queries(spark, query):
    with pytest.raises(QueryError):
        compile_query(query)


def test_bm25_prefers_rare_and_short(spark):
    docs = spark.createDataFrame([(1, "apple pear"), (2, "apple apple plum fig fig fig fig"), (3, "fig"), (4, None)], "ord long, text string")
    assert [r.ord for r in search.bm25(docs, F.col("text"), "pear").collect()] == [1]
    assert [r.ord for r in search.bm25(docs, F.col("text"), "the apple").collect()] in ([1, 2], [2, 1])


def test_redaction(spark):
    text = "a@b.org 123-45-6789 4111111111111111 (555) 123-4567 10.0.0.1"
    got = spark.createDataFrame([(text,)], "t string").select(T.redact(F.col("t"))).collect()[0][0]
    assert got == "<EMAIL> <SSN> <CC> <PHONE> <IP>"


def test_csv_cell(spark):
    rows = [("=1+1", "'=1+1"), ('a"b', '"a""b"'), ("a,b", '"a,b"'), ("plain", "plain")]
    got = spark.createDataFrame(rows, "t string, w string").select(T.csv_cell(F.col("t")).alias("g"), "w").collect()
    assert all(r.g == r.w for r in got)


def test_row_filter_denies_missing(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "i int, a string")
    assert [r.i for r in df.filter(access.row_filter(F.col("a") == "x")).collect()] == [2]


def test_import_strategies(spark):
    old = spark.createDataFrame([("a", ["1"]), ("b", ["2"])], "name string, observations array<string>")
    new = spark.createDataFrame([("b", ["3"]), ("c", ["4"])], "name string, observations array<string>")
    merged = {r.name: (sorted(r.observations), r.status) for r in mutate.import_merge(old, new, "name").collect()}
    assert merged == {"a": (["1"], "kept"), "b": (["2", "3"], "updated"), "c": (["4"], "added")}
    skipped = {r.name: r.observations for r in mutate.import_merge(old, new, "name", "skip").collect()}
    assert skipped["b"] == ["2"]
    with pytest.raises(ValueError):
        mutate.import_merge(old, new, "name", "fail")


def test_corrections_leave_ties(spark):
    vocab = spark.createDataFrame([("large",), ("small",), ("smart",)], "word string")
    tokens = spark.createDataFrame([("lrage",), ("smalt",), ("abc",)], "token string")
    assert as_dict(search.corrections(vocab, "word", tokens)) == {"lrage": "large", "smalt": "smalt", "abc": "abc"}


def test_inverse_pairs_are_shuffled_once(spark):
    from quillgraph.operators import records

    rows = [(1, 2), (2, 1), (2, 1), (3, 3), (4, 5), (4, 5), (None, 1), (1, None), (9, 7), (7, 9)]
    found = records.inverse_pairs(spark.createDataFrame(rows, "src long, dst long"))
    assert sorted(map(tuple, found.collect())) == [(1, 2), (7, 9)]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join") == 0


def test_relations_are_dealt_by_their_number(spark, sf_dir, monkeypatch):
    """Sorts of orders and of timelines have more tasks for more rows; before, always the session's 4, each growing with the table."""
    from quillgraph import session
    from quillgraph.operators import temporal
    from quillgraph.sources.views import contains_relations

    n = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    monkeypatch.setattr(session, "TASK_BYTES", 20 * n)
    placed = temporal.timeline(contains_relations(spark, sf_dir), ["src"])
    assert placed.rdd.getNumPartitions() == 10 and placed.count() == n


def test_blocks_of_names_are_dealt_over_tasks(spark, monkeypatch):
    """300 names of one block meet in several tasks with all pairs of the plain formula; before, a block was one task."""
    from quillgraph.functions import text as T

    monkeypatch.setattr(dedup, "_PIECE", 40)
    monkeypatch.setattr(dedup, "_PAIRS", 9_000)
    rows = [(i, f"Name {i % 97}{'x' * (i % 5)}", "k" if i % 50 else None, [["a"], ["a", "B"], ["b", "a"], [], ["z"]][i % 5], [["t"], [], ["T", "u"], None][i % 4]) for i in range(300)]
    e = spark.createDataFrame(rows, "ord long, name string, entity_type string, observations array<string>, tags array<string>")
    for threshold in (0.5, 0.8, 0.95):
        found = dedup.entity_similarity_pairs(e, threshold)
        low = e.select("ord", F.lower("name").alias("n"), "entity_type", F.transform("observations", F.lower).alias("o"), F.transform("tags", F.lower).alias("g"))
        x, y = (low.select(*[F.col(c).alias(c + s) for c in low.columns]) for s in "12")
        tagged = (F.size("g1") > 0) | (F.size("g2") > 0)
        total = 0.4 * T.similarity(F.col("n1"), F.col("n2")) + 0.2 + 0.3 * T.jaccard(F.col("o1"), F.col("o2")) + F.when(tagged, 0.1 * T.jaccard(F.col("g1"), F.col("g2"))).otherwise(0.0)
        plain = x.join(y, (F.col("entity_type1") == F.col("entity_type2")) & (F.col("ord1") < F.col("ord2"))).select("ord1", "ord2", F.round(total / F.when(tagged, 1.0).otherwise(0.9), 6).alias("s")).filter(F.col("s") >= threshold)
        want = {tuple(r) for r in plain.collect()}
        got = found.withColumn("task", F.spark_partition_id()).collect()
        assert {tuple(r)[:3] for r in got} == want and len(got) == len(want) and want
        assert threshold > 0.5 or len({r.task for r in got}) > 4
