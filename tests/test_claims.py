"""Conflicts, facts and abbreviations against brute force and cases by hand."""

from __future__ import annotations

import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillgraph.functions import facts
from quillgraph.llm import textarrays as ta
from quillgraph.operators import abbreviate, contradictions
from quillgraph.registry import QUERIES

MEMORY = "ord long, name string, agent string, entity_type string, observations array<string>, confidence double, confirmations int"


def _words(text):
    return {w for w in text.lower().split() if len(w) > 2}


def _like(a, b):
    return len(a & b) / len(a | b) if a | b else 0.0


def _brute(rows, threshold):
    out = set()
    for a, b in itertools.combinations(sorted(rows), 2):
        if a[2] == b[2]:
            continue
        x, y = (_words(" ".join([r[1] or "", r[3] or "", *[o for o in r[4] or [] if o is not None]])) for r in (a, b))
        if not x or not y or _like(x, y) < threshold:
            continue
        said = [[o.lower() for o in r[4] or [] if o is not None] for r in (a, b)]
        no = lambda o: any(re.search(rf"\b{n}\b", o) for n in contradictions.NEGATIONS)
        if any(_like(_words(o), _words(p)) > 0.5 and no(o) != no(p) for o in said[0] for p in said[1]):
            out.add((a[0], b[0], "negation"))
        elif sorted(o for o in a[4] or [] if o is not None) != sorted(o for o in b[4] or [] if o is not None):
            out.add((a[0], b[0], "similarity"))
    return out


@pytest.mark.parametrize(("threshold", "hot"), [(0.7, 2000), (0.5, 2), (1.0, 3)])
def test_conflicts_equal_brute_force(spark, threshold, hot):
    rng = random.Random(int(threshold * 10))
    vocabulary = ["not", "never", *[f"word{i}" for i in range(12)]]
    line = lambda: " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 7)))
    rows = [(i, rng.choice(["same", "other", None]), rng.choice(["x", "y", None]), rng.choice(["kind", None]), [rng.choice([line(), "shared words that all have here", None]) for _ in range(rng.randint(0, 3))], None, None) for i in range(70)]
    rows += [(100 + i, "same", f"agent{i % 3}", "kind", ["shared words that all have here" + " more" * (i % 2)], None, None) for i in range(12)]
    rows += [(200, "m", "x", "t", None, None, None)]
    got = contradictions.conflicts(spark.createDataFrame(rows, MEMORY), threshold, hot=hot).select("a", "b", "method").collect()
    assert len(got) == len(set(got))
    assert {tuple(r) for r in got} == _brute(rows, threshold)


def test_conflict_strategies_and_odd_tables(spark):
    said = ["the server runs on the old host"]
    rows = [
        (1, "a", "x", "t", said, 0.9, 1), (2, "b", "y", "t", ["the server runs not on the old host"], 0.5, 1),
        (3, "c", "z", "t", [*said, "the host"], None, 5), (4, "d", "x", "t", [], None, None), (5, None, None, None, None, None, None),
    ]
    got = {(r.primary, r.conflicting): (r.method, r.strategy) for r in contradictions.conflicts(spark.createDataFrame(rows, MEMORY)).collect()}
    assert got == {("a", "b"): ("negation", "highest_confidence"), ("a", "c"): ("similarity", "highest_confidence"), ("b", "c"): ("negation", "most_confirmations")}
    assert contradictions.conflicts(spark.createDataFrame([], MEMORY)).count() == 0
    quiet = contradictions.conflicts(spark.createDataFrame(rows, MEMORY), negation=False).filter("method = 'negation'")
    assert quiet.count() == 0
    with pytest.raises(ValueError):
        contradictions.similar_pairs(spark.createDataFrame([], "id long, agent string, words array<string>"), 0)


def _facts(spark, texts, **kw):
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    found = rows.select("id", F.explode(facts.facts(F.col("text"), **kw)).alias("f")).select("id", "f.*").collect()
    return sorted((r.id, r.subject, r.relation, r.object, r.confidence) for r in found)


def test_facts(spark):
    got = _facts(spark, [
        "Alice works at Google on Mondays.", "The team is located in  New York, and uses Spark!", "US-East is a region", "the car was created by Bob (who knows)",
        "Hello! Dr. Smith manages US-East; Bob prefers tea", None, "", "works at", "a\nb depends on c\n", "no facts here",
    ])
    assert got == [
        (0, "alice", "works_at", "google", 0.9), (1, "and", "uses", "spark", 0.7), (1, "the team", "located_in", "new york", 0.9), (2, "us-east", "is_a", "region", 0.85),
        (4, "bob", "prefers", "tea", 0.75), (4, "smith", "manages", "us-east", 0.7), (8, "a b", "depends_on", "c", 0.75),
    ]
    assert _facts(spark, ["Bob  Jones uses Vim"], normalise=False) == [(0, "Bob  Jones", "uses", "Vim", 0.7)]
    assert _facts(spark, ["Bob uses Vim"], min_confidence=0.75) == []


def test_facts_of_very_long_texts(spark):
    long = "word " * 200_000
    got = _facts(spark, [long + ": x uses y", " " * 500_000 + "x uses y", long])
    assert got == [(0, "x", "uses", "y", 0.7), (1, "x", "uses", "y", 0.7)]


def test_facts_are_distinct_and_persist(spark):
    rows = spark.createDataFrame([("k", "A uses B"), ("k", "a  uses b."), ("k", "A manages C"), ("l", "A uses B")], "key string, text string")
    found = facts.extract(rows, "key", "text")
    assert sorted(map(tuple, found.collect())) == [("k", "a", "manages", "c", 0.7), ("k", "a", "uses", "b", 0.7), ("l", "a", "uses", "b", 0.7)]
    entities, relations = spark.createDataFrame([("a",)], "name string"), spark.createDataFrame([("a", "c", "manages")], "src string, dst string, relation_type string")
    names, new = facts.persist(found, entities, relations)
    assert sorted(r.name for r in names.collect()) == ["b", "c"]
    assert [tuple(r) for r in new.collect()] == [("a", "b", "uses", 0.7)]
    assert facts.normalise_name(F.lit("x")) is not None
    assert spark.range(1).select(facts.normalise_name(F.lit(" Dr. Ann   LEE "))).first()[0] == "ann lee"


def _gram_counts(texts, min_length):
    counts = {}
    for t in texts:
        k = re.findall(r"""\s+|[{}()\[\]<>:;,."'`|=]|[^\s{}()\[\]<>:;,."'`|=]+""", t or "")
        for n in range(1, 7):
            for i in range(len(k) - n + 1):
                g = "".join(k[i : i + n])
                opened, closed = (sum(c in p for c in g) for p in ("{([<", "})]>"))
                if min_length <= len(g) <= 50 and len(g.strip(" ")) >= 3 and len(re.findall(r"\s", g)) * 2 <= len(g) and opened == closed and "§" not in g:
                    counts[g] = counts.get(g, 0) + 1
    return counts


def _gain(text, subs, at=0, memo=None):
    """Most characters that codes save from a place on, by trying everything."""
    memo = {} if memo is None else memo
    for i in range(len(text), at - 1, -1):
        memo[i] = max([memo.get(i + 1, 0), *[len(s) - 2 + memo[i + len(s)] for s in subs if text.startswith(s, i)]])
    return memo[at]


@pytest.mark.parametrize("pool", [5000, 3])
def test_legend_equals_brute_force(spark, pool):
    rng = random.Random(3)
    phrases = ["the server /var/log/app is down", "call(arg, other)", "[x] = {y: 1}", "aaaa aaaa aaaa", "ünïcode wörds here"]
    texts = [" ".join(rng.choice([*phrases, "§0 mark", "§", "filler", "\n"]) for _ in range(rng.randint(0, 12))) for _ in range(60)] + [None, ""]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    entries = abbreviate.legend(rows, "text", pool=pool)
    want = []
    counts = _gram_counts(texts, 8)
    for g, n in sorted(counts.items(), key=lambda x: (-((len(x[0]) - 2) * x[1] - len(x[0]) - 6), x[0])):
        saved = (len(g) - 2) * n - len(g) - 6
        if n >= 3 and saved > 5 and len(want) < 36 and not any(abbreviate._overlaps(g, w[0]) for w in want):
            want.append((g, n, saved))
    assert [(e.substring, e.count, e.savings) for e in entries] == want and want
    coded = abbreviate.compress(rows, "text", entries)
    for r in coded.withColumn("back", abbreviate.expand(F.col("compressed"), entries)).collect():
        assert r.back == r.text
        if r.text:
            assert len(r.text) + r.text.count("§") - len(r.compressed) == _gain(r.text, [e.substring for e in entries])


def test_nothing_to_abbreviate(spark):
    rows = spark.createDataFrame([(1, "all words differ here"), (2, None), (3, ""), (4, "§ § §0")], "id long, text string")
    assert abbreviate.legend(rows, "text") == [] == abbreviate.legend(rows.limit(0), "text")
    coded = abbreviate.compress(rows, "text", [])
    got = {r.id: (r.compressed, r.back) for r in coded.withColumn("back", abbreviate.expand(F.col("compressed"), [])).collect()}
    assert got == {1: ("all words differ here",) * 2, 2: (None, None), 3: ("", ""), 4: ("§§ §§ §§0", "§ § §0")}
    with pytest.raises(ValueError):
        abbreviate.legend(rows, "text", most=37)


def test_abbreviated_documents_expand(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    entries = abbreviate.legend(docs, "text")
    coded = QUERIES["abbreviated_documents"](spark, sf_dir)
    both = docs.join(coded.withColumn("back", abbreviate.expand(F.col("compressed"), entries)), "doc_id")
    assert both.count() == docs.count() and both.filter("not (text <=> back)").count() == 0
    assert both.agg(F.sum("saved")).first()[0] > 0


def test_rare_runs_are_not_shuffled(spark, monkeypatch):
    """Runs that can't be among the best stay in their tasks; before, every run of every text was shuffled by its hash."""
    rng = random.Random(5)
    monkeypatch.setattr(abbreviate, "_PROPOSING", 2)
    texts = [f"{' '.join(str(rng.randrange(10**9)) for _ in range(200))} the same phrase in every text" for _ in range(60)] + [None, "", "« § »  { x"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    found, whole = abbreviate.candidates(rows, "text", pool=5)
    counts = _gram_counts(texts, 8)
    savings = {g: (len(g) - 2) * n - len(g) - 6 for g, n in counts.items()}
    least = sorted(savings.values())[-5]
    assert not whole and {r.substring: r.count_ for r in found.withColumnRenamed("count", "count_").collect()} == {g: counts[g] for g, s in savings.items() if s >= least}
    # The rows that the strings' tasks hand on are those of a few frequent runs, not the texts' 60,000 places.
    handed = found._jdf.queryExecution().optimizedPlan().toString()
    assert "xxhash64" not in handed and "zip_with" not in handed


def test_tables_of_savings_do_not_grow_with_the_files(spark):
    """Texts in 150 pieces hand on as many tables as there are tasks for, a byte a place; before, each piece had one of its own."""
    rng = np.random.default_rng(3)
    texts = [" ".join(map(str, rng.integers(0, 10**9, 40))) + " the same phrase" for _ in range(300)]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").repartition(150)
    keys = np.zeros(0, np.uint64)
    handed = abbreviate._tables(rows, 8, keys)
    assert handed.rdd.getNumPartitions() <= max(32, 2 * spark.sparkContext.defaultParallelism)
    assert handed.agg(F.max(F.length("sums"))).first()[0] == abbreviate._ROW
    exact = np.zeros(abbreviate.PLACES, np.int64)
    for piece in ta.slices(pa.array(texts)):
        _, _, size, key = abbreviate._runs(piece, 8)
        np.add.at(exact, abbreviate._place(key), size - 2)
    got = np.zeros(abbreviate.PLACES, np.int64)
    for r in abbreviate._summed(rows, 8, keys).collect():
        got[r["at"] * abbreviate._ROW :][: abbreviate._ROW] = np.frombuffer(r["sums"], np.int64)
    assert (got >= exact).all() and (got <= exact * 1.13 + 40).all() and not got[exact == 0].any()


def test_pairs_that_share_a_few_rare_words_are_no_candidates(spark):
    """Every two sets share two of their rarest words, among the first of both; only the two alike are candidates."""
    rows = [(i, f"agent{i}", [f"c{i}", "rare1", "rare2", *(f"w{i}-{j}" for j in range(27))]) for i in range(12)]
    rows.append((99, "other", rows[3][2][:28] + ["x", "y"]))
    sets = spark.createDataFrame(rows, "id long, agent string, words array<string>")
    assert [tuple(r) for r in contradictions.similar_pairs(sets, 0.5).collect()] == [(3, 99)]


def test_statements_are_read_once_and_as_apart(spark):
    """Both ends of a statement come from one reading; zero characters, long runs and texts without a statement do no harm."""
    from quillgraph.functions import facts as f

    texts = ["Ann works at  Acme Corp on Monday. Bob works for Beta", "Ann works at b\0c", "x\0y. Ann uses tea ; Bob", " works at ", "Works at uses it", "a-b IS  A \t big\n dog , cat", "a is part of", "İs uses\u00a0tea. Dr. Who uses a box", None, "",
             "word " * 3000 + "uses tea", "- -Ann created by Bob", "Price $1 and cost manages it since then", "no\0thing. Ann prefers tea\0"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    apart = docs.select("id", F.explode(F.array(*[F.struct(F.lit(r).alias("relation"), *[f.normalise_name(F.regexp_extract("text", f.statement_pattern(p), i)).alias(n) for i, n in ((1, "subject"), (2, "object"))]) for r, p, _ in f.RULES])).alias("s")).select("id", "s.*")
    wanted = sorted((r.id, r.subject, r.relation, r.object) for r in apart.filter("subject <> '' and object <> ''").collect())
    found = f.extract(docs, "id", "text")
    assert sorted((r.id, r.subject, r.relation, r.object) for r in found.collect()) == wanted and len(wanted) > 5
    arrays = docs.select("id", F.explode(f.facts(F.col("text"))).alias("s")).select("id", "s.*")
    assert sorted((r.id, r.subject, r.relation, r.object) for r in arrays.collect()) == wanted
    # One regular expression in compiled code finds both ends, where each had its own within an array.
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(text") == len(f.RULES)


def test_words_of_near_copies_are_sent_a_bounded_number_of_times(spark, monkeypatch):
    """In a group of near copies every two are a pair; words go to groups of pairs, not along with each pair."""
    monkeypatch.setattr(contradictions, "PARTS", (2, 2))
    rows = [(i, f"m{i}", f"agent{i}", "kind", [" ".join(f"word{j}" for j in range(40)) + f" own{i}"], None, None) for i in range(30)]
    sets = spark.createDataFrame([(r[0], [hash(w) for w in sorted(_words(r[4][0]))]) for r in rows], "id long, words array<long>")
    pairs = spark.createDataFrame([(a, b, True) for a, b in itertools.combinations(range(30), 2)], "a long, b long, may boolean")
    alike = contradictions.with_similarity(pairs, sets, 0.9)
    joined = alike._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in joined
    got = alike.collect()
    assert len(got) == 30 * 29 // 2 and {round(r.similarity, 9) for r in got} == {round(40 / 42, 9)} and got[0].may
    assert contradictions.with_similarity(pairs, sets, 0.96).count() == 0
    found = contradictions.conflicts(spark.createDataFrame(rows, MEMORY), 0.7)
    assert {tuple(r) for r in found.select("a", "b", "method").collect()} == _brute(rows, 0.7)


def test_words_of_one_memory_are_not_dealt(spark, tmp_path, monkeypatch):
    seen = []
    keep = contradictions.written
    monkeypatch.setattr(contradictions, "written", lambda df, name: seen.append((name, keep(df, name))) or seen[-1][1])
    sets = spark.createDataFrame([(i, f"agent{i}", [f"own{i}-{j}" for j in range(9)] + ["both"]) for i in range(6)], "id long, agent string, words array<string>")
    assert contradictions.similar_pairs(sets, 0.5).collect() == []
    assert dict(seen)["set-keys"].count() == 0
