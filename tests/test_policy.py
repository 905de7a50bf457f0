"""Conditions of access rules, and observations made to stand alone."""

from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from quillgraph.functions import observations
from quillgraph.operators import access

#: attribute, op, value: for which of the rows below it holds.
CONDITIONS = [
    (("s", "eq", "ab"), {1}), (("s", "eq", 1), set()), (("s", "eq", None), {3}), (("s", "neq", "ab"), {2, 3}), (("s", "in", ["ab", None]), {1, 3}), (("s", "not-in", ["ab"]), {2, 3}),
    (("s", "contains", "b"), {1}), (("s", "starts-with", "a"), {1}), (("s", "lt", 5), set()), (("tags", "contains", "x"), {1, 2}), (("tags", "contains", 1), set()),
    (("n", "lt", 2), {1}), (("n", "lte", 2.0), {1, 2}), (("n", "gt", 1), {2}), (("n", "gte", "1"), set()), (("n", "eq", 1.0), {1}), (("n", "eq", True), set()), (("f", "gt", 0), {1}), (("f", "present"), {1, 2}), (("f", "absent"), {3}),
    (("b", "eq", True), {1}), (("b", "eq", 1), set()), (("o.k", "eq", "v"), {1}), (("o.k", "absent"), {2, 3}),
    (("gone", "eq", None), set()), (("gone", "neq", 1), {1, 2, 3}), (("gone", "not-in", [1]), {1, 2, 3}), (("gone", "absent"), {1, 2, 3}), (("gone", "present"), set()), (("n", "in", []), set()),
]


@pytest.fixture(scope="module")
def requests(spark):
    rows = [(1, "ab", 1, 0.5, True, ["x", None], ("v",), "read"), (2, "", 2, float("nan"), False, ["x", "y"], None, "write"), (3, None, None, None, None, None, (None,), None)]
    return spark.createDataFrame(rows, "id int, s string, n int, f double, b boolean, tags array<string>, o struct<k:string>, action string").cache()


def test_each_condition(requests):
    held = requests.select("id", *[access.condition(requests, *c).alias(f"c{i}") for i, (c, _) in enumerate(CONDITIONS)]).collect()
    for i, (c, want) in enumerate(CONDITIONS):
        assert {r.id for r in held if r[f"c{i}"]} == want, c
        assert all(r[f"c{i}"] is not None for r in held), c


def test_priority_then_deny_then_id(requests):
    rules = [{"id": "z", "effect": "permit", "action": "*"}, {"id": "y", "effect": "deny", "action": "read"}, {"id": "x", "effect": "deny", "action": "read"}, {"id": "w", "effect": "permit", "action": "write", "priority": 1, "conditions": [("n", "eq", 2)]}]
    got = {r.id: (r.effect, r.rule_id) for r in access.evaluate(requests, rules).collect()}
    assert got == {1: ("deny", "x"), 2: ("permit", "w"), 3: ("permit", "z")}
    got = {r.id: (r.effect, r.rule_id) for r in access.evaluate(requests, rules[1:2]).collect()}
    assert got == {1: ("deny", "y"), 2: ("not-applicable", None), 3: ("not-applicable", None)}
    assert {r.effect for r in access.evaluate(requests, []).collect()} == {"not-applicable"}
    assert access.evaluate(requests.limit(0), rules).collect() == []


@pytest.mark.parametrize("bad", [("s", "in", "ab"), ("s", "not-in", None), ("s", "like", "a")])
def test_a_malformed_condition_is_an_error(requests, bad):
    with pytest.raises(ValueError):
        access.condition(requests, *bad)
    with pytest.raises(ValueError):
        access.evaluate(requests, [{"id": "a", "effect": "allow", "action": "*"}])


def test_observations_stand_alone(spark):
    clock = datetime.datetime(2024, 3, 31, 12)
    rows = [
        (1, "He met her YESTERDAY, yesterday\nand today", "Bob $1\\", "person", clock),
        (2, "Their shed: they left them last month; this weekend", "Depot", "place", clock),
        (3, "They saw her", "Mary", "person", clock),
        (4, "he was here today", "Bob", "person", None),
        (5, None, "Bob", "person", clock),
        (6, "", None, None, clock),
        (7, "😀 theirs last week " + "x " * 100_000, "They today", "team", datetime.datetime(2024, 1, 3)),
        (8, "he left today", None, "place", clock),
    ]
    df = spark.createDataFrame(rows, "id int, obs string, name string, kind string, at timestamp").withColumn("keywords", F.lit(1))
    got = {r.id: r for r in observations.normalise(df, "obs", "name", "kind", "at").collect()}
    assert got[1].normalized == "Bob $1\\ met her 2024-03-30, yesterday\nand 2024-03-31"
    assert got[1].changes == ["Resolved pronouns to 'Bob $1\\'", "'YESTERDAY' -> '2024-03-30'", "'today' -> '2024-03-31'"]
    # 31 February runs over into March.
    assert got[2].normalized == "Depot shed: Depot left Depot 2024-03; this weekend"
    assert got[2].keywords == ["depot", "shed", "left", "202403", "this", "weekend"]
    assert got[3].normalized == "They saw Mary" and got[4].normalized == "Bob was here today"
    assert got[5].normalized is None and got[5].changes == [] and got[6].normalized == "" and got[6].keywords == []
    assert got[7].normalized.startswith("😀 They 2024-01-03 week of 2023-12-27 x") and len(got[7].normalized) > 200_000
    assert got[8].normalized == "he left 2024-03-31"
    plain = observations.normalise(df, "obs", "name", "kind", "at", pronouns=False, dates=False)
    assert {r.id: r.normalized for r in plain.collect()} == {r[0]: r[1] for r in rows}
