"""Order-dependent choices and templates against brute force; groups longer than a batch."""

from __future__ import annotations

import itertools
import random
from collections import defaultdict

import pytest

from quillgraph.operators import patterns, streamed


@pytest.fixture
def small_batches(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    yield
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_knapsack_skips(spark):
    rows = [("s", 1, 10.0, 6), ("s", 2, 9.0, 5), ("s", 3, 1.0, 4), ("t", 4, 1.0, 99)]
    got = streamed.budget_knapsack(spark.createDataFrame(rows, "g string, id long, v double, c long"), "g", "id", "v", "c", 10)
    assert {r.id for r in got.collect()} == {2, 3}


def test_knapsack_equals_brute_force(spark, small_batches):
    r = random.Random(1)
    rows = [(r.choice(["a", "a", "b", None]), i, r.choice([None, 1.0, 2.0, 5.0]), r.choice([None, 0, 1, 3, 8]), r.choice([True, False, False, False, None])) for i in range(300)]
    got = streamed.budget_knapsack(spark.createDataFrame(rows, "g string, id long, v double, c long, m boolean").repartition(3), "g", "id", "v", "c", 60, "m")
    want = set()
    for g in ("a", "b", None):
        mine = [(i, v or 0.0, c or 0, bool(m)) for h, i, v, c, m in rows if h == g]
        used = sum(c for _, _, c, m in mine if m)
        want |= {(g, i, True) for i, _, _, m in mine if m}
        for i, _, c, _ in sorted((x for x in mine if not x[3]), key=lambda x: (-(x[1] / x[2] if x[2] else 0.0), x[0])):
            if used + c <= 60:
                used += c
                want.add((g, i, False))
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_chunks(spark, small_batches):
    rows = [("c", i, "x" * n) for i, n in enumerate([5, 5, 1, 20, 2])] + [("d", 0, None)] + [("long", i, "xyz") for i in range(50)]
    got = streamed.chunks_by_size(spark.createDataFrame(rows, "g string, i long, t string").repartition(2), "g", "i", "t", 10).collect()
    by = defaultdict(list)
    for r in sorted(got, key=lambda r: (r.g, r.i)):
        by[r.g].append(r.chunk)
    assert by == {"c": [0, 0, 1, 2, 3], "d": [0], "long": [i // 3 for i in range(50)]}


def test_diverse_selection_and_leaders(spark, small_batches):
    r = random.Random(5)
    rows = [(r.choice("gh"), i, r.choice([0.1, 0.5, None]), r.sample("abcdef", r.randint(0, 4))) for i in range(80)]
    df = spark.createDataFrame(rows, "g string, id long, s double, w array<string>")
    near = lambda a, b: len(a & b) / len(a | b) if a | b else 0.0
    want, leaders = set(), set()
    for g in "gh":
        chosen = []
        for _, i, _, w in sorted((x for x in rows if x[0] == g), key=lambda x: (-(x[2] or 0.0), x[1])):
            if len(chosen) < 6 and all(near(set(w), c) <= 0.4 for c in chosen):
                chosen.append(set(w))
                want.add((g, i, len(chosen)))
        heads = []
        for _, i, _, w in sorted(x for x in rows if x[0] == g):
            at = next((n for n, h in enumerate(heads) if near(set(w), h) >= 0.5), None)
            if at is None:
                at = len(heads)
                heads.append(set(w))
            leaders.add((g, i, at + 1))
    assert {tuple(x) for x in streamed.diverse_selection(df, "g", "id", "s", "w", 6, 0.4).collect()} == want
    assert {tuple(x) for x in streamed.leader_clusters(df, "g", "id", "w", 0.5).collect()} == leaders


def test_sections_end_at_a_sentence(spark):
    rows = [("a", 1, "One. Two"), ("a", 2, "Yes! No more. Nothing"), ("a", 3, "x"), ("b", 1, "no sentence here"), ("b", 2, "."), ("c", 1, None), ("c", 2, "ok")]
    got = {(r.g, r.i): r.section for r in streamed.clipped_sections(spark.createDataFrame(rows, "g string, i int, t string"), "g", "i", "t", 15).collect()}
    assert got == {("a", 1): "One. Two", ("a", 2): "Yes!", ("c", 1): "", ("c", 2): "ok"}
    assert streamed.clipped_sections(spark.createDataFrame([], "g string, i int, t string"), "g", "i", "t", 5).count() == 0


def brute_templates(rows, least, most, longest):
    once = {}
    for i, t in rows:
        if t is not None:
            once[t] = min(once.get(t, i), i)
    texts = sorted((i, t.split()) for t, i in once.items())
    keys = set()
    for (_, a), (_, b) in itertools.combinations(texts, 2):
        if len(a) == len(b) and 2 <= len(a) <= longest:
            differ = tuple(k for k, (x, y) in enumerate(zip(a, b, strict=True)) if x.lower() != y.lower())
            if 1 <= len(differ) <= most and len(differ) <= len(a) - len(differ):
                keys.add((differ, tuple("{X}" if k in differ else x.lower() for k, x in enumerate(a))))
    out = set()
    for differ, key in keys:
        mine = [(i, t) for i, t in texts if len(t) == len(key) and all(k in differ or x.lower() == key[k] for k, x in enumerate(t))]
        if len(mine) >= least:
            shown = " ".join("{X}" if k in differ else x for k, x in enumerate(mine[0][1]))
            out.add((shown, len(mine), round(min(1, len(mine) / len(rows)), 9)))
    return out


@pytest.mark.parametrize("most, least, seed", [(1, 2, 1), (2, 2, 2), (2, 4, 3)])
def test_templates_equal_all_pairs(spark, most, least, seed):
    r = random.Random(seed)
    texts = [" ".join(r.choice([["user", "User", "bot"], ["likes", "hates"], ["tea", "Tea", "jam"], ["now", "{X}"], ["a", "b"]][k]) for k in range(r.randint(1, 5))) for _ in range(150)]
    rows = [*enumerate(texts), (900, None), (901, ""), (902, " \t"), (903, " user  likes\ttea "), (904, "w " * 40)]
    df = spark.createDataFrame(rows, "ord long, text string").repartition(3)
    found = patterns.templates(df, least, most)
    assert {(x.pattern, x.occurrences, round(x.confidence, 9)) for x in found.collect()} == brute_templates(rows, least, most, 32)
    for x in patterns.matches(df, found, most).collect():
        assert len(x.variables) == x.pattern.split(" ").count("{X}") or "{X}" in dict(rows)[x.ord]


def test_a_template_that_all_texts_share(spark):
    rows = [(i, f"order {i} shipped") for i in range(3000)] + [(3000, "order x lost")]
    got = {x.pattern: x.occurrences for x in patterns.templates(spark.createDataFrame(rows, "ord long, text string")).collect()}
    assert got == {"order {X} shipped": 3000}
    with pytest.raises(ValueError, match="one or two"):
        patterns.templates(spark.createDataFrame(rows[:1], "ord long, text string"), max_variables=3)
