"""BPE, packing and the token store against the tokenizers library and brute force."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from quillgraph.llm import bpe, packing, token_store
from quillgraph.llm import textarrays as ta

PATH = bpe.public_path("word_bpe_49k.json")
TEXTS = [
    "Hello, world! It's they'RE 's''d x've 12²½Ⅷ", None, "", "   \t\n", "ΑΣ ΣΑΣ İI ǅ é é Å", "<|endoftext|>x<|startoftext|> <|endoftext|>",
    "a\0b \0 \x1c\x1d nul", "日本語 русский текст naïve", "word " * 3000, "x" * 5000, "Hello, world!", "Hello, world!",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i if i != 3 else None, t, "x") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string")


@pytest.mark.parametrize("library_coder", [False, True])
def test_ids_equal_the_library(library, library_coder):
    coder = bpe.load(PATH, library_coder)
    for piece in ta.slices(pa.array(TEXTS, pa.string()), 100):
        ids, offsets = coder.chunks_of(piece).documents()
        for i in range(len(piece)):
            want = library.encode(TEXTS[piece.first + i] or "", add_special_tokens=False).ids
            assert ids[offsets[i] : offsets[i + 1]].tolist() == want


def test_encode_decode(spark, docs, library):
    got = bpe.encode_decode(docs, PATH).collect()
    assert len(got) == len(TEXTS)
    want = sorted((library.encode(t or "", add_special_tokens=False).ids for t in TEXTS), key=str)
    assert sorted((np.frombuffer(r.ids, "<u4").tolist() for r in got), key=str) == want
    for r in got:
        assert r.decoded == library.decode(np.frombuffer(r.ids, "<u4").tolist(), skip_special_tokens=False)
    assert bpe.encode_decode(docs.limit(0), PATH).collect() == []


def optimum(lengths, capacity):
    best = [(0, 0)] + [(99, 0)] * (2 ** len(lengths) - 1)
    for m in range(len(best)):
        for i, x in enumerate(lengths):
            if not m >> i & 1:
                bins, room = best[m]
                new = (bins, room - x) if room >= x else (bins + 1, capacity - x)
                if (new[0], -new[1]) < (best[m | 1 << i][0], -best[m | 1 << i][1]):
                    best[m | 1 << i] = new
    return best[-1][0]


def test_bin_completion_is_optimal_on_small_sets():
    rng = random.Random(3)
    for _ in range(150):
        capacity = rng.choice([10, 20, 100])
        lengths = [rng.randint(1, capacity) for _ in range(rng.randint(0, 9))]
        bins = packing.complete(lengths, capacity)
        assert sorted(sum(bins, [])) == sorted(lengths) and all(sum(b) <= capacity for b in bins)
        assert packing.least_bins(lengths, capacity) <= len(bins) == optimum(lengths, capacity)


def test_exhaustive_completion_is_optimal():
    rng = random.Random(5)
    for _ in range(100):
        capacity = rng.choice([10, 20, 40])
        lengths = [rng.randint(1, capacity) for _ in range(rng.randint(1, 9))]
        assert len(packing.complete(lengths, capacity, None, None)) == optimum(lengths, capacity)


@pytest.mark.parametrize("kind, worse", [("triplets", 0.025), ("with small", 0.01), ("large", 0.012), ("mixed", 0.01), ("seven", 0.01), ("six", 0.01), ("twelve", 0.01)])
def test_bin_completion_comes_near_the_bound(kind, worse):
    capacity, found, bound = 2048, 0, 0
    for seed in range(6):
        rng = random.Random(seed)
        full = lambda k, r=rng: [b - a for _ in range(60) for x in [sorted(r.sample(range(1, capacity), k - 1))] for a, b in zip([0, *x], [*x, capacity], strict=True)]
        lengths = {
            "triplets": lambda: full(3), "with small": lambda r=rng: full(3) + [r.randint(20, 60) for _ in range(100)], "large": lambda r=rng: [r.randint(300, 1000) for _ in range(400)],
            "mixed": lambda r=rng: [r.randint(100, 900) for _ in range(400)], "seven": lambda r=rng: [r.choice([190, 240, 301, 377, 455, 560, 683]) for _ in range(600)],
            "six": lambda: full(6), "twelve": lambda: full(12),
        }[kind]()
        bins = packing.complete(lengths, capacity)
        assert sorted(sum(bins, [])) == sorted(lengths) and all(sum(b) <= capacity for b in bins)
        found, bound = found + len(bins), bound + packing.least_bins(lengths, capacity)
    assert found <= bound * (1 + worse)


def test_segment_tree_equals_the_library_on_odd_and_long_words(library):
    import pyarrow as pa

    rng = random.Random(8)
    texts = ["\xa0", "\x85", "\u3000\u2003", "<|endoftext|>\xa0", "\u2028<|endoftext|>", "=" * 5000, "ab" * 3000, "".join(rng.choices("etaoin", k=6000)), None]
    texts += ["".join(rng.choices("abcXYZ 0'’s\n\xa0\u3000éßΣσς.,-=!\0日😀", k=rng.randint(0, 50))) for _ in range(300)]
    for coder in (bpe.SegmentTreeBpe(PATH), bpe.LibraryBpe(PATH)):
        for piece in ta.slices(pa.array(texts)):
            ids, offsets = coder.chunks_of(piece).documents()
            for i in range(len(piece)):
                assert ids[offsets[i] : offsets[i + 1]].tolist() == library.encode(texts[piece.first + i] or "", add_special_tokens=False).ids


def test_packing_covers_all_pieces(spark, docs, library):
    rows = packing.pack_documents(docs, PATH, capacity=64, end_id=0).collect()
    want = []
    for i, t in enumerate(TEXTS):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        want += [(i if i != 3 else None, n, 64 * n, len(ids[64 * n : 64 * n + 64]), zlib.crc32(np.array(ids[64 * n : 64 * n + 64], "<u4").tobytes())) for n in range(-(-len(ids) // 64))]
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.piece, r.start, r.length, r.ids_crc32)) for r in rows)
    by: dict[int, list] = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    total = sum(r.length for r in rows)
    assert len(by) <= -(-total // 64) + 1
    assert packing.pack_documents(docs.limit(0), PATH).collect() == []


def test_packed_sequences_hold_the_ids(spark, library):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    pieces = packing.cut_pieces(docs, PATH, 64)
    places = packing.pack_documents(docs, PATH, 64)
    rows = packing.sequences(pieces, places).collect()
    assert sum(len(r.ids) // 4 for r in rows) == sum(r.length for r in rows) == sum(len(library.encode(t or "", add_special_tokens=False).ids) + 1 for t in TEXTS)


def test_token_store_round_trip(spark, docs, library):
    docs = docs.unionByName(docs.filter("doc_id = 2"))
    manifest = token_store.write_store(docs.repartition(3), PATH, end_id=1)
    got = token_store.read_store(manifest).orderBy("start").collect()
    assert len(got) == len(TEXTS) + 1
    ids = [r.doc_id for r in got]
    assert ids == sorted(ids, key=lambda i: -1 if i is None else i)
    at = 0
    for r in got:
        text = TEXTS[3 if r.doc_id is None else r.doc_id]
        assert r.start == at and np.frombuffer(r.ids, "<u4").tolist() == [*library.encode(text or "", add_special_tokens=False).ids, 1]
        assert r.n_tokens == len(r.ids) // 4
        at += r.n_tokens
    wanted = spark.createDataFrame([(2,), (5,), (77,)], "doc_id long")
    assert sorted(r.key for r in token_store.lookup(manifest, wanted).collect()) == [2, 2, 5]
    wanted = spark.createDataFrame([(None,), (2,), (None,)], "doc_id long")
    assert sorted(str(r.key) for r in token_store.lookup(manifest, wanted).collect()) == ["2", "2", "None"]
    assert token_store.read_store(token_store.write_store(docs.limit(0), PATH)).collect() == []


def test_keys_that_share_a_hash_are_found(spark, monkeypatch):
    monkeypatch.setattr(token_store, "key_hashes", lambda keys: np.arange(len(keys), dtype=np.uint64) // 2 if len(keys) > 1 else np.zeros(1, np.uint64))
    column = __import__("pyarrow").array([3, 3, 4, 9])
    assert token_store._run_starts(column, np.array([1, 1, 1, 1], np.uint64)).tolist() == [0, 2, 3]


def test_perfect_hash_is_minimal():
    hashes = np.unique(np.random.default_rng(1).integers(0, 2**64, 5000, dtype=np.uint64))
    index = token_store.PerfectHash.build(hashes)
    assert sorted(index.slots(hashes).tolist()) == list(range(len(hashes)))
