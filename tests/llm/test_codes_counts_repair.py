"""Vector codes, token counts and conversation repair against brute force."""

from __future__ import annotations

import hashlib
import itertools
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import types as T

from quillgraph.llm import bpe, conversation_repair, queries, token_counts, vector_codes

# -- vector codes ------------------------------------------------------------------------

VECTORS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType())), T.StructField("label", T.IntegerType()), T.StructField("code", T.StringType()), T.StructField("x", T.StringType())])


def brute_codes(rows, parts, entries, rounds):
    """Every distance, in Python's integers."""
    kept = [r for r in rows if r[1] is not None and all(x is not None and np.isfinite(x) for x in r[1])]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return []
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    width = -(-len(kept[0][1]) // parts)
    scaled = lambda x: int(x) * 256 if abs(x) >= 2**52 else int(np.floor(x * 256))
    cut = []
    for r in kept:
        v = [scaled(x) for x in r[1]] + [0] * (parts * width - len(r[1]))
        cut.append([v[p * width : (p + 1) * width] for p in range(parts)])
    book = [[c[p] for c in cut[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    assign = lambda: [[min((far(c[p], e), i) for i, e in enumerate(book[p])) for p in range(parts)] for c in cut]
    for _ in range(rounds):
        near = assign()
        for p in range(parts):
            for i in range(len(book[p])):
                mine = [c[p] for c, n in zip(cut, near, strict=True) if n[p][1] == i]
                if mine:
                    book[p][i] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    near = assign()
    most = 2**63 - 1
    errors = [min(sum(d for d, _ in n), most) for n in near]
    of_label = defaultdict(int)
    for r, e in zip(kept, errors, strict=True):
        of_label[r[2]] += e
    sha = hashlib.sha256(",".join(str(x) for b in book for e in b for x in e).encode()).hexdigest()
    return sorted(map(str, ((r[0], "".join(f"{i:02x}" for _, i in n), e, min(of_label[r[2]], most), sha) for r, n, e in zip(kept, near, errors, strict=True))))


@pytest.mark.parametrize("case", ["plain", "outliers", "huge", "ties", "few", "odd", "empty", "uneven"])
def test_codes_equal_brute_force(spark, case):
    rng = np.random.default_rng(5)
    n, dim, entries = (9 if case == "few" else 150), (10 if case == "uneven" else 8), 16
    x = rng.normal(size=(n, dim))
    if case == "outliers":
        x[3], x[40], x[100, 2] = x[3] * 2.0**33, x[40] * 2.0**20, -(2.0**45)
    if case == "huge":
        x[1, 0], x[77, 5], x[80] = 1e300, -1e200, 3.4e38
    if case == "ties":
        x = np.round(x)
    rows = [(int(i), v.tolist(), int(i) % 3, "a", "b") for i, v in zip(rng.permutation(n), x, strict=True)]
    if case == "odd":
        rows += [(None, [0.0] * dim, None, None, None), (500, None, 1, "", ""), (501, [1.0, None] * 4, 1, "", ""), (502, [float("nan")] * dim, 1, "", ""), (503, [float("-inf")] * dim, 1, "", "")]
        rows += [(504, [1.0], 1, "", ""), (505, [], None, "", ""), (7, [0.5] * dim, None, "", ""), (7, [0.5] * dim, None, "", "")]
    if case == "empty":
        rows = []
    got = vector_codes.compress(spark.createDataFrame(rows, VECTORS).repartition(3), parts=4, entries=entries, rounds=2)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(str, map(tuple, got.collect()))) == brute_codes(rows, 4, entries, 2)


def test_search_reads_part_of_the_lists():
    rng = np.random.default_rng(1)
    book = vector_codes.Codebooks(np.floor(rng.normal(size=(4, 64, 4)) * 256).astype(np.int64))
    x = np.floor(rng.normal(size=(500, 4, 4)) * 256).astype(np.int64)
    codes, least, _ = book.nearest(x, np.zeros((500, 4), np.uint8))
    again, same, read = book.nearest(x, codes)
    all_ = ((x[:, :, None, :] - book.entries[None]) ** 2).sum(axis=3)
    assert (codes == all_.argmin(axis=2)).all() and (again == codes).all() and (least == all_.min(axis=2)).all() and (same == least).all()
    assert read < 500 * 4 * 32  # less than half of all distances from the right entries


# -- token counts ------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.public_path("byte_bpe_50k.json"))


def test_counts_equal_the_library(spark, library):
    r = random.Random(3)
    alphabet = ["'"] * 6 + list("stmdrevlSTxyz") + list(" \n\t\r\x0b\x1c") + [" "] * 8 + list("Ab1٣²½é中!?-_🙂é\u0085 　​͸") + ["<|endoftext|>", "<|endof", "text|>", "'ll", "Ᲊ", "\U00010d40"]
    texts = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 40))) for _ in range(3000)]
    texts += [None, "", " ", "\n\n", "<|endoftext|>", "<|endoftext|><|endoftext|>  ", "a" * 200_000, " \n" * 50_000 + "x", "word " * 100_000, "é" * 513, "x y" * 256]
    rows = [(None if i % 97 == 0 else i % 2000, t, i, "n") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, slice int, n_tokens string").repartition(3)
    got = token_counts.count_tokens(docs, bpe.public_path("byte_bpe_50k.json"), limit=512)
    want = []
    for i, t, *_ in rows:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        want.append((i, len((t or "").encode()), n, n > 512))
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_special_strings_do_not_join_texts(spark, library):
    docs = spark.createDataFrame([(1, "a<|endof"), (2, "text|>b"), (3, "<|endoftext|>")], "doc_id long, text string").coalesce(1)
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs, bpe.public_path("byte_bpe_50k.json")).collect()}
    assert got == {i: len(library.encode(t, add_special_tokens=False).ids) for i, t in ((1, "a<|endof"), (2, "text|>b"), (3, "<|endoftext|>"))}


def test_counts_of_nothing_and_of_other_files(spark):
    empty = spark.createDataFrame([], "doc_id string, text string")
    got = token_counts.count_tokens(empty, bpe.public_path("byte_bpe_50k.json"))
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"] and got.count() == 0
    with pytest.raises(ValueError, match="byte-level"):
        token_counts.ByteLevel(bpe.public_path("word_bpe_49k.json"))


def test_op12_equals_the_library(spark, sf_dir, library):
    docs = {r.doc_id: r.text or "" for r in queries.table(spark, sf_dir, "documents").collect()}
    for r in queries.op12_token_counts(spark, sf_dir).collect():
        n = len(library.encode(docs[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(docs[r.doc_id].encode()), n, n > 512)


# -- conversation repair -----------------------------------------------------------------


def all_edits(rows):
    """Every audit of rows (role initial, fault) with at most two insertions at a place: cost, letters, repaired turns."""
    legal = lambda s: s == "" or (s.lstrip("s") == s[s[:1] == "s" :] and len(s.lstrip("s")) > 0 and s.lstrip("s") == "ua" * (len(s.lstrip("s")) // 2))
    best = None
    inserts = ["", "u", "a", "ua", "au"]
    options = []
    for initial, fault in rows:
        mine = [("D", "", 4)]
        if fault != "doomed":
            extra = 3 if fault == "truncated" else 0
            mine += [("K", initial or "?", extra), ("R", "u", 3 + extra), ("R", "a", 3 + extra)]
        options.append([("I" * len(i) + letter, i + role, cost + 3 * len(i)) for i in inserts for letter, role, cost in mine])
    options.append([("I" * len(i), i, 3 * len(i)) for i in inserts])
    for way in itertools.product(*options):
        roles = "".join(w[1] for w in way)
        if legal(roles):
            found = (sum(w[2] for w in way), "".join(w[0] for w in way), roles)
            best = min(best, found) if best else found
    return best


def brute_repair(rows):
    """rows: turn, role, text in any order."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    seen, found, count = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
    for _, role, text in rows:
        solid = text.strip(" \t\n\v\f\r")
        fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else ""
        seen.add((role, text))
        if fault:
            count[fault] += 1
        found.append((role[:1], "doomed" if fault in ("blank", "duplicate") else fault))
    cost, audit, roles = all_edits(found)
    left, out = list(roles), []
    i = 0
    for letter in audit:
        if letter != "D":
            role = left.pop(0)
            spoken = {"u": "user", "a": "assistant"}.get(role)
        if letter == "I":
            out.append(f"{spoken}:")
        else:
            if letter != "D":
                out.append(f"{rows[i][1] if letter == 'K' else spoken}:{rows[i][2]}")
            i += 1
    turns = {r[0] for r in rows if r[0] is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in itertools.pairwise(found))
    return (gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


def conversations(n, most, seed):
    r = random.Random(seed)
    for c in range(n):
        conv = None if c == 3 else c
        for _ in range(r.randint(0 if c else 2, most)):
            role = r.choice(["user", "assistant", "system", "tool", "ursula", "", " ", None])
            text = r.choice(["Yes.", "No!  ", "open", "", " \n", "Why?", None, "a "])
            yield conv, r.choice([None, 0, 1, 2, 3, 7]), role, text


@pytest.mark.parametrize("segment", [4096, 2])
def test_repairs_equal_brute_force(spark, monkeypatch, segment):
    """Also with conversations cut into segments of two rows."""
    monkeypatch.setattr(conversation_repair, "SEGMENT_ROWS", segment)
    rows = list(conversations(60, 4, 11))
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    table = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, audit string").repartition(3)
    ids = spark.createDataFrame([(c,) for c in [*range(3), *range(4, 60), None]], "conv_id long")
    got = {r[0]: tuple(r)[1:] for r in conversation_repair.repair(table, ids).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    by_id = defaultdict(list)
    for c, turn, role, text in rows:
        by_id[c].append((turn, " " if role is None else role, " " if text is None else text))
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert set(got) == {*range(3), *range(4, 60), None}
    for c, found in got.items():
        assert found == (brute_repair(by_id[c]) if c in by_id else nothing), c


def test_one_conversation_holds_most_rows(spark, monkeypatch):
    """Segments give what the whole conversation gives, repeated rows and rows repeated far apart included."""
    r = random.Random(2)
    rows = [(1, t, r.choice(["user", "assistant", "assistant", "system"]), r.choice(["Yes.", "cut", "", f"Turn {t}.", f"Turn {t}."])) for t in range(400)] + [(1, 5, "user", "same")] * 300
    rows += [(c, 0, "user", "Hello.") for c in range(2, 50)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    want = {x.conv_id: tuple(x) for x in conversation_repair.repair(table).collect()}
    monkeypatch.setattr(conversation_repair, "SEGMENT_ROWS", 32)
    got = {x.conv_id: tuple(x) for x in conversation_repair.repair(table).collect()}
    assert got == want and len(got) == 49


def test_no_conversations(spark):
    empty = spark.createDataFrame([], "conv_id string, turn int, role string, text string")
    assert conversation_repair.repair(conversation_repair.damaged(empty), empty).count() == 0
