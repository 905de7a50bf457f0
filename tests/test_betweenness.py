from __future__ import annotations

import pytest

from quillgraph.operators import graph


def test_betweenness(spark):
    # A path, and a square with a tail: two shortest paths between opposite corners share the score.
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("b", "b"), (None, "a")], "src string, dst string")
    nodes = spark.createDataFrame([("a",), ("b",), ("c",), ("d",), ("d",), (None,)], "node string")
    got = {r.node: r.score for r in graph.betweenness(nodes, edges).collect()}
    assert got == {"a": 0.0, "b": pytest.approx(4 / 6, abs=1e-6), "c": 0.0, "d": 0.0}
    square = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("d", "a"), ("d", "e")], "src string, dst string")
    nodes = spark.createDataFrame([(x,) for x in "abcde"], "node string")
    got = {r.node: r.score for r in graph.betweenness(nodes, square).collect()}
    # Ordered pairs: a and c carry b-d and b-e halves; b carries a half of a-c; d a half of a-c, and e's paths to a, b, c.
    assert got == {x: pytest.approx(y / 6, abs=1e-5) for x, y in {"a": 2.0, "b": 1.0, "c": 2.0, "d": 7.0, "e": 0.0}.items()}
    assert graph.betweenness(nodes.limit(0), square.limit(0)).count() == 0
