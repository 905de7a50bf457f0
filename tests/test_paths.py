"""Communities, cliques, chains and evidence paths against brute force."""

from __future__ import annotations

import itertools
import random
from collections import defaultdict

import pytest

from quillgraph.operators import chains, cliques, communities, evidence
from quillgraph.registry import QUERIES


def graph(spark, edges):
    return spark.createDataFrame([(a, b, "r", i) for i, (a, b) in enumerate(edges)], "src string, dst string, relation_type string, ord long")


def nodes(spark, names):
    return spark.createDataFrame([(n,) for n in names], "node string")


def modularity(edges, label):
    m = len(edges)
    degree, inside = defaultdict(int), 0
    for a, b in edges:
        degree[label[a]] += 1
        degree[label[b]] += 1
        inside += label[a] == label[b]
    return inside / m - sum((d / (2 * m)) ** 2 for d in degree.values())


def test_louvain_two_cliques_with_a_bridge(spark):
    edges = [*itertools.combinations("abcde", 2), *itertools.combinations("vwxyz", 2), ("e", "v"), ("a", "a"), ("nobody", "a"), ("q", "q")]
    members, levels = communities.louvain(nodes(spark, [*"abcdevwxyzq", "lone", None, "a"]), graph(spark, edges))
    got = {r.node: r.community for r in members.collect()}
    assert got == {**dict.fromkeys("abcde", "a"), **dict.fromkeys("vwxyz", "v"), "q": "q", "lone": "lone"}
    known = [e for e in edges if "nobody" not in e]
    assert levels[-1] == pytest.approx(modularity(known, got)) and levels == sorted(levels)


@pytest.mark.parametrize("seed", [1, 2])
def test_louvain_never_falls_and_is_as_good_as_one_by_one(spark, seed):
    r = random.Random(seed)
    names = [f"n{i:02d}" for i in range(40)]
    edges = [(a, b) for a, b in itertools.combinations(names, 2) if r.random() < (0.5 if int(a[1:]) // 10 == int(b[1:]) // 10 else 0.03)]
    edges += [("n00", x) for x in names[10:30]]  # a hub
    members, levels = communities.louvain(nodes(spark, names), graph(spark, edges))
    got = {x.node: x.community for x in members.collect()}
    assert set(got) == set(names) and levels == sorted(levels)
    best = modularity(edges, got)
    assert levels[-1] == pytest.approx(best) and best >= 0.95 * modularity(edges, {n: int(n[1:]) // 10 for n in names})
    # No single node can gain by a move to another community.
    for n in r.sample(names, 15):
        for c in set(got.values()):
            assert modularity(edges, {**got, n: c}) <= best + 0.02


def test_louvain_without_relations(spark):
    members, levels = communities.louvain(nodes(spark, ["a", "b"]), graph(spark, []))
    assert {tuple(r) for r in members.collect()} == {("a", "a"), ("b", "b")} and levels == []


def test_louvain_query(spark, sf_dir):
    rows = QUERIES["louvain_communities"](spark, sf_dir).collect()
    label = {r.node: r.community for r in rows}
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").count()
    # Nations hold together what is located in them: no community mixes two nations' customers without their region.
    assert len(rows) == len(label) and 5 <= len(set(label.values())) <= n + 5


def brute_cliques(edges, least):
    around = defaultdict(set)
    for a, b in edges:
        if a != b:
            around[a].add(b)
            around[b].add(a)
    found = set()

    def grow(r, p, x):
        if not p and not x:
            if len(r) >= least:
                found.add(tuple(sorted(r)))
            return
        for v in sorted(p):
            grow(r | {v}, p & around[v], x & around[v])
            p, x = p - {v}, x | {v}

    grow(set(), set(around), set())
    return found


@pytest.mark.parametrize("n, share, least", [(14, 0.5, 2), (25, 0.3, 3), (12, 0.9, 3), (9, 1.0, 4)])
def test_cliques_equal_brute_force(spark, n, share, least):
    r = random.Random(n)
    edges = [(f"v{a}", f"v{b}") for a, b in itertools.combinations(range(n), 2) if r.random() < share]
    edges += [(b, a) for a, b in edges[::3]] + [("v1", "v1"), ("v0", "leaf"), *(("hub", f"x{i}") for i in range(20))]
    rows = cliques.maximal_cliques(graph(spark, edges), least).collect()
    assert len(rows) == len({tuple(x.clique) for x in rows})
    assert {tuple(x.clique) for x in rows} == brute_cliques(edges, least) and all(x.size == len(x.clique) for x in rows)


def test_core_numbers(spark):
    edges = [*itertools.combinations("abcd", 2), ("d", "e"), ("e", "f"), ("f", "d"), ("g", "a"), ("g", "g"), *(("h", f"x{i}") for i in range(9))]
    got = {x.node: x.core for x in cliques.core_numbers(graph(spark, edges)).collect()}
    assert got == {**dict.fromkeys("abcd", 3), "e": 2, "f": 2, "g": 1, "h": 1, **{f"x{i}": 1 for i in range(9)}}


def test_cliques_of_nothing(spark):
    assert cliques.maximal_cliques(graph(spark, []), 3).collect() == []
    with pytest.raises(ValueError, match="two nodes"):
        cliques.maximal_cliques(graph(spark, []), 1)


def brute_chains(links, most):
    out = set()
    for start in links:
        met, now, place = {start}, start, 0
        while links.get(now) is not None and links[now] not in met and (most is None or place < most):
            now, place = links[now], place + 1
            met.add(now)
            out.add((start, place, now))
    return out


@pytest.mark.parametrize("most", [None, 1, 5])
def test_chains_equal_brute_force(spark, most):
    r = random.Random(4)
    links = {i: r.choice([None, r.randint(0, 60), i - 1, i - 1]) for i in range(60)}
    links |= {100: 100, 101: 102, 102: 101, 110: 111, 111: 112, 112: 113, 113: 111} | {i: i - 1 for i in range(201, 240)}
    rows = spark.createDataFrame([*links.items(), (None, 3)], "node long, next long")
    assert {tuple(x) for x in chains.chains(rows, most).collect()} == brute_chains(links, most)


def test_first_links_and_lessons(spark):
    edges = spark.createDataFrame(
        [("f", "z", "caused_by", 2), ("f", "m", "caused_by", 1), ("f", "a", "part_of", 0), ("m", "m", "caused_by", 0), ("m", "r", "caused_by", 5), ("r", "gone", "caused_by", 1)],
        "src string, dst string, relation_type string, ord int",
    )
    links = chains.first_links(edges, "caused_by")
    assert {tuple(x) for x in links.collect()} == {("f", "m"), ("m", "r"), ("r", "gone")}
    content = spark.createDataFrame([("f", "no disk"), ("m", "log grew"), ("r", None), ("z", "z"), ("h", "hot")], "node string, content string")
    got = {x.node: tuple(x)[1:] for x in chains.failure_lessons(nodes(spark, ["f", "h"]), content, links).collect()}
    assert got["f"] == ("r", 2, "Failure: no disk (root cause: r)", 'To prevent "no disk", address root cause: "r"')
    assert got["h"] == (None, 0, "Failure: hot", "Avoid: hot")


def brute_evidence(edges, results, anchors, depth, most):
    near = defaultdict(list)
    for a, b in edges:
        if a != b:
            near[a].append(b)
            near[b].append(a)

    def search(source, target):
        if source not in near:
            return None, False
        parent, frontier = {source: None}, [source]
        for _ in range(depth):
            following = []
            for n in frontier:
                for o in near[n]:
                    if o not in parent:
                        parent[o] = n
                        following.append(o)
                        if o == target:
                            path = [o]
                            while parent[path[-1]] is not None:
                                path.append(parent[path[-1]])
                            return path[::-1], False
            frontier = following
        return None, any(o not in parent for n in frontier for o in near[n])

    first = {}
    for a in anchors:
        first.setdefault(a[0], a)
    ordered = sorted(first.values(), key=lambda a: -(a[1] or 0))
    out = {}
    for result in results:
        paths, cut = [], False
        for name, *_ in ordered:
            if len(paths) >= most:
                cut = True
                break
            path, limited = ([result], False) if name == result else search(name, result)
            if path:
                paths.append((name, tuple(path)))
            cut = cut or limited
        out[result] = (paths, cut)
    return out


@pytest.mark.parametrize("seed, depth, most", [(1, 3, 3), (2, 2, 3), (3, 1, 2), (4, 3, 1), (5, 0, 3)])
def test_evidence_equals_a_search_with_a_queue(spark, seed, depth, most):
    r = random.Random(seed)
    names = [f"e{i}" for i in range(14)]
    edges = [(r.choice(names), r.choice(names)) for _ in range(16)] + [("island", "shore"), ("e1", "e1")]
    anchors = [(r.choice([*names, "nowhere", "island"]), r.choice([None, 0.5, 1.0, 2.0]), "lexical", i) for i in range(6)]
    table = spark.createDataFrame(anchors, "name string, score double, via string, ord long")
    results = [*names, "shore", "unknown"]
    paths, flags = evidence.evidence_paths(graph(spark, edges), spark.createDataFrame([(n,) for n in results], "name string"), table, depth, most)
    want = brute_evidence(edges, results, anchors, depth, most)
    got = defaultdict(list)
    for x in sorted(paths.collect(), key=lambda x: (x.result, x["rank"])):
        got[x.result].append((x.anchor, tuple(x.nodes)))
        assert len(x.types) == len(x.nodes) - 1
    assert {n: got[n] for n in results} == {n: p for n, (p, _) in want.items()}
    assert {x.result: (x.n_paths, x.truncated) for x in flags.collect()} == {n: (len(p), cut) for n, (p, cut) in want.items()}


def test_lists_meet_instead_of_pairs_of_neighbours(spark):
    """Where 60 nodes are all linked, 1,770 relations make rows, not 34,220 pairs of relations, which were shuffled before."""
    from quillgraph.operators import graph as g

    rows = spark.createDataFrame([(a, b) for a in range(60) for b in range(60) if a != b] + [(7, 99), (99, 7)], "src long, dst long")
    lists = g.later_neighbours(rows)
    found = g.common_later(lists).collect()
    assert len(found) == 60 * 59 // 2 - 59 and sum(len(r.common) for r in found) == 60 * 59 * 58 // 6
    assert {r.node: len(r.later) for r in lists.collect()}[99] == 1
    assert g.triangles(rows).distinct().count() == g.triangles(rows).count() == 60 * 59 * 58 // 6


def test_cliques_need_no_rounds(spark, monkeypatch):
    """A path of triangles takes no rounds over all relations; before, core numbers were found in rounds and written each time."""
    monkeypatch.setattr(cliques, "core_numbers", lambda relations: pytest.fail("rounds over all relations"))
    rows = spark.createDataFrame([(i, i + k) for i in range(40) for k in (1, 2)], "src long, dst long")
    assert {tuple(r.clique) for r in cliques.maximal_cliques(rows, 3).collect()} == {(i, i + 1, i + 2) for i in range(39)}


@pytest.mark.parametrize("array,most", [(1, None), (2, None), (4, 7), (64, None), (64, 70), (64, 1)])
def test_chains_of_arrays_and_rows(spark, monkeypatch, array, most):
    """Chains longer than an array, ones into cycles, and cycles longer and shorter than an array."""
    monkeypatch.setattr(chains, "_ARRAY", array)
    links = {i: i + 1 for i in range(75)} | {100: 101, 101: 102, 102: 100, 103: 101, 104: 104, 105: 104} | {200 + i: 200 + (i + 1) % 9 for i in range(9)}
    rows = spark.createDataFrame(list(links.items()), "node long, next long")
    assert {tuple(x) for x in chains.chains(rows, most).collect()} == brute_chains(links, most)


def test_rounds_of_chains_write_no_row_for_each_record(spark, monkeypatch):
    """Before, all records of all chains were grouped and written anew in each round."""
    kept = []
    monkeypatch.setattr(chains, "written", lambda df, name, f=chains.written: (kept.append(f(df, name)), kept[-1])[1])
    rows = spark.createDataFrame([(i, i + 1) for i in range(40)], "node long, next long")
    assert chains.chains(rows).count() == 40 * 41 // 2
    assert {"place" in t.columns for t in kept} == {False}
