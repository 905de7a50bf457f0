"""Language ID, quality, context mixing: held-out accuracy, brute force and edge cases."""

from __future__ import annotations

import collections
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgraph.llm import context_mixing, language_id, quality
from quillgraph.llm import textarrays as ta

WORDS = {"en": "the of and to in that is was for with house water".split(), "de": "der die und das ist nicht ein zu haus wasser über schön".split(), "fr": "le la et les des est une pour dans maison eau été".split()}


@pytest.fixture(scope="module")
def spoken(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choices(WORDS[lang], k=30)), lang, "s") for i, lang in enumerate(rng.choices(list(WORDS), k=240))]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")


def test_language_id_held_out(spark, spoken):
    model = language_id.fit(spoken.filter("doc_id % 4 <> 0"))
    got = language_id.predict(spoken.filter("doc_id % 4 = 0"), model).join(spoken.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == 60 and np.mean([r.lang_pred == r.lang for r in got]) > 0.95
    assert all(0 <= r.score <= 1 for r in got)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 !? \n"), (4, "…"), (None, "the house"), (5, "das haus"), (5, "das haus")], "doc_id long, text string")
    rows = language_id.predict(odd, model).collect()
    assert [r.lang_pred for r in rows] == ["und"] * 4 + ["en", "de", "de"] and [r.score for r in rows[:4]] == [0.0] * 4
    assert language_id.keep_identified(odd, model).count() == 3
    assert language_id.predict(odd.limit(0), model).collect() == []
    assert {r.lang_pred for r in language_id.predict(odd, None).collect()} == {"und"}
    assert language_id.fit(spoken.limit(0)) is None


def test_codewords_are_apart():
    for k in (2, 3, 4, 5, 9, 30):
        code = language_id.codewords(k)
        distance = (code.shape[1] - code @ code.T) / 2 + 1e9 * np.eye(k)
        assert distance.min() >= 1 and all(len(set(c)) == 2 for c in code.T)


def test_fold_is_crc32_of_the_text(spark):
    rows = spark.range(50).select("id", language_id.fold(F.col("id"), 4).alias("f")).collect()
    assert all(r.f == zlib.crc32(str(r.id).encode()) % 4 for r in rows)


def test_quality_separates_junk(spark):
    rng = random.Random(7)
    good = lambda: " ".join(rng.choices(WORDS["en"], k=40)).capitalize() + "."
    bad = lambda: " ".join(w.upper() + "!!" for w in rng.choices(WORDS["en"], k=40))
    rows = [(i, good() if i % 3 else bad(), int(i % 3 > 0)) for i in range(300)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows if i % 2] + [(None, 1), (1, None)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    got = {r.doc_id: r for r in quality.predict(docs, model).collect()}
    assert all(got[i].predicted == q for i, _, q in rows if i % 2 == 0)
    odd = spark.createDataFrame([(1, None), (2, ""), (None, "text")], "doc_id long, text string")
    rows = quality.predict(odd, model).collect()
    assert rows[0].score == rows[1].score and len(rows) == 3
    assert quality.fit(docs, labels.limit(0)) is None
    assert {r.score for r in quality.predict(odd, None).collect()} == {0.5}


def test_flattened_trees_equal_a_plain_walk():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    trees = quality.boost(x, y, rounds=20, depth=3)
    margins = []
    for row in x:
        total = trees.start
        for f, c, v in zip(trees.feature, trees.cut, trees.leaf, strict=True):
            node = 0
            while node < len(f):
                node = 2 * node + 1 + int(row[f[node]] > c[node])
            total += v[node - len(f)]
        margins.append(total)
    assert np.allclose(trees.margin(x), margins) and ((trees.margin(x) > 0) == y).mean() > 0.95


def test_statistics_do_not_depend_on_slices():
    import pyarrow as pa

    texts = ["One two.\nOne two.\n\nThree", "", "x y x y x y", None, "éé 12"]
    whole = np.concatenate([quality.statistics(p) for p in ta.slices(pa.array(texts))])
    alone = np.concatenate([quality.statistics(p) for t in texts for p in ta.slices(pa.array([t], pa.string()))])
    assert np.allclose(whole, alone)


def test_context_mixing_base_scores(spark):
    rng = random.Random(9)
    texts = [" ".join(rng.choices(WORDS["en"] + ["Rare%d" % rng.randint(0, 99)], k=rng.randint(0, 40))) for _ in range(60)] + [None, "", "THE the\tThe", "new-word"]
    rows = [(i, t, 1.0) for i, t in enumerate(texts)] + [(None, "the", 1.0), (0, texts[0], 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    training = F.coalesce(F.col("doc_id") % 5 != 0, F.lit(False))
    got = context_mixing.score_corpus(docs, training).collect()
    assert len(got) == len(rows)
    low = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    tokens = lambda t: [*(t or "").encode().translate(low).split(), b""]
    count = collections.Counter(w for i, t, _ in rows if i is not None and i % 5 for w in tokens(t))
    n, v = sum(count.values()), len(count)
    want = sorted((len(tokens(t)), sum(count[w] > 0 for w in tokens(t)), round(sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens(t)), 6)) for _, t, _ in rows)
    assert sorted((r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == want
    assert {r.train_tokens for r in got} == {n} and all(r.score < 0 for r in got)
    assert context_mixing.score_corpus(docs.limit(0), training).collect() == []


def learnt(bits):
    model = context_mixing.Mixer(bits)
    model.begin()
    return model


def frozen(model):
    """As ``freeze`` makes it of one task's counters."""
    codes = np.searchsorted(context_mixing._CUTS, model.counts.astype(np.float64)).astype(np.uint16)
    model.pairs = codes[::2] << np.uint16(8) | codes[1::2]
    return model


def test_codes_are_prefix_free_and_their_probabilities_sum_to_one():
    import pyarrow as pa

    words = [b"", *(f"w{i}".encode() for i in range(40))]
    counts = np.array([30, *(2 + 40 // (i + 1) for i in range(40))])
    d = context_mixing.Dictionary.of(context_mixing.token_hashes(words), counts, int(counts.sum()) + 9)
    spelt = [format(int(c), f"0{n}b") for c, n in zip(d.code, d.size, strict=True)]
    assert not any(x != y and y.startswith(x) for x in spelt for y in spelt) and len(set(spelt)) == 42
    model = learnt([16] * 3)
    text = "w1 w2 w3 w1 w2 zz w0 " * 30
    (piece,) = ta.slices(pa.array([text]))
    t = context_mixing.Tokens(piece, d)
    for low in range(0, len(t.hash), 16):
        _, bit, slots = t.bits(d, model, low, min(low + 16, len(t.hash)))
        model.learn(slots, bit)
    frozen(model)
    # After "w1" each symbol in turn: what all of them have together can't be more than one.
    total = {}
    for w in [*(x.decode() for x in words[1:]), "zz", ""]:
        (piece,) = ta.slices(pa.array([f"w1 {w}"]))
        t = context_mixing.Tokens(piece, d)
        _, bit, slots = t.bits(d, model, 1, 2)
        total[w] = 10 ** float(model.log10(slots, bit).sum())
    assert 0.9 < sum(total.values()) <= 1 + 1e-3 and max(total, key=total.get) == "w2"


def test_codes_are_shortest_and_three_bits_share_a_line():
    import pyarrow as pa

    words = [b"", *(f"w{i}".encode() for i in range(300))]
    counts = np.array([900, *(2 + 4000 // (i + 1) for i in range(300))])
    d = context_mixing.Dictionary.of(context_mixing.token_hashes(words), counts, int(counts.sum()) + 9)
    assert sum(0.5 ** int(n) for n in d.size) == 1.0  # a code of Huffman leaves no beginning unused
    weight = np.append(d.counts, 9)
    entropy = -(weight / weight.sum() * np.log2(weight / weight.sum())).sum()
    assert entropy <= (weight * d.size).sum() / weight.sum() < entropy + 0.1
    (piece,) = ta.slices(pa.array([" ".join(w.decode() for w in words[1:])]))
    t = context_mixing.Tokens(piece, d)
    model = learnt([16, 16, 16])
    first, bit, slots = t.bits(d, model, 0, len(t.hash))
    for i, n in zip(first.tolist(), d.size[t.symbol].tolist(), strict=True):
        for row in slots:
            assert len(set((row[i : i + n] // 8).tolist())) <= -(-n // 3) and len(set(row[i : i + n].tolist())) >= min(n, 3)
    # What the counts of all words tell of a code by itself is each word's share.
    alone = context_mixing.Mixer([16, 16], d.known)
    first, bit, slots = t.bits(d, alone, 0, len(t.hash))
    odds = d.known[slots[0]].astype(np.float64)
    share = np.exp(np.add.reduceat(np.where(bit == 1, -np.log1p(np.exp(-odds)), -np.log1p(np.exp(odds))), first))
    assert np.allclose(share, weight[t.symbol] / weight.sum(), rtol=0.35)


def test_spellings():
    model = learnt([16, 16, 16, 16, 16])
    s = context_mixing.Spelling([b"abc", b"abd"] * 20)
    for low in range(0, len(s.data), 16):
        _, bit, slots = s.bits(model, low, min(low + 16, len(s.data)))
        model.learn(slots, bit)
    frozen(model)
    one = [bytes([b]) for b in range(256) if b != 0x20]
    ends = 10 ** context_mixing.log10_spellings([b""], model)[0]
    assert 0 < ends < 1 and ends + sum(10**x for x in context_mixing.log10_spellings(one, model)) <= 1 + 1e-3
    words = [b"abc", b"xyz", b"", b"q" * 100_000, b"abd"]
    together = context_mixing.log10_spellings(words, model)
    assert np.allclose(together, [context_mixing.log10_spellings([w], model)[0] for w in words], rtol=1e-5)
    assert together[0] > together[1]


def test_a_very_long_token_is_scored(spark):
    docs = spark.createDataFrame([(1, "a b a b a b " + "x" * 1_000_000), (2, "\u3000" * 1000), (3, "a b")], "doc_id long, text string")
    got = {r.doc_id: r for r in context_mixing.score_corpus(docs, F.col("doc_id") < 3).collect()}
    assert got[1].n_tokens == 8 and got[3].n_known == 3 and all(r.score < 0 for r in got.values())


def test_samples_stay_bounded_with_null_and_repeated_ids(spark):
    rows = [(None, "the and of to", "en"), (1, "der und von zu", "de")] * 300
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(docs, per_language=20)
    assert {r.lang_pred for r in language_id.predict(docs.filter("lang = 'de'"), model).collect()} <= {"de", "en"}
    labels = spark.createDataFrame([(1, 1, "x")], "doc_id long, quality int, text string")
    many = spark.createDataFrame([(1, "good text here", 5)] * 200, "doc_id long, text string, quality int")
    assert quality.fit(many, labels, sample=10) is not None
    assert quality.predict(many.limit(0), None).collect() == []


def test_every_block_teaches_the_weights():
    from quillgraph.llm.context_mixing import Mixer

    rng = np.random.default_rng(1)
    model = Mixer([16] * 3)
    model.begin()
    slots, bit = np.stack([model.slots(k, rng.integers(0, 50, 400).astype(np.uint64)) for k in range(3)]), rng.integers(0, 2, 400)
    for n in range(1, 6):
        before = model.weights.copy()
        model.learn(slots, bit)
        assert model.adapted == n and (n == 1 or (model.weights != before).any())
