"""Repeated substrings of all texts, abbreviated by one legend.

Candidates are runs of one to six tokens.  Nearly all runs of a corpus are rare, so they are
not shuffled.  What runs save is summed in a table of fixed size by their hash: a run whose
place in it has less than the wanted savings can't have them.  How much is wanted comes from
exact counts of runs that are frequent in some of the texts: the pool's last is a bound that
the best can't be under.  Only runs at places above it are counted, as strings and exactly.
The legend has 36 entries at most; where the pool does not fill it a larger one is taken, so
the bound of the pool changes no result.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..llm import textarrays as ta
from ..session import forget, written

#: The mark of a code, and the second characters of codes in order.
MARK = "§"
DIGITS = "0123456789abcdefghijklmnopqrstuvwxyz"
#: Characters that are tokens by themselves (fixed values).
_SINGLE = r"""{}()\[\]<>:;,."'`|="""
LONGEST = 50
#: Places of the table of savings (32 MB in a task), and those of one row of it.
PLACES, _ROW = 1 << 22, 1 << 12
#: Of so many texts one proposes runs whose counts give the bound, or about so many in all; the bound is exact whatever it proposes.
_PROPOSING, _PROPOSERS = 64, 2048
#: Tasks that have a table of savings each: so many, or twice the cores, whatever the input and its files.
_TABLES = 32
#: Sums that a task hands on as one byte: zero, then steps of an eighth or less, rounded up.
_LEVELS = np.unique(np.concatenate([[0], np.ceil(1.12 ** np.arange(400))]))[:255].astype(np.int64)
_BYTES = np.arange(256)
_KIND = np.where(ta.BLANK, 0, np.where(np.isin(_BYTES, [ord(c) for c in _SINGLE.replace("\\", "")]), 2, 1)).astype(np.int8)
_BRACKET = np.isin(_BYTES, [ord(c) for c in "{([<"]).astype(np.int8) - np.isin(_BYTES, [ord(c) for c in "})]>"]).astype(np.int8)


class Entry(NamedTuple):
    code: str
    substring: str
    count: int
    savings: int


def _runs(piece: ta.TextSlice, min_length: int) -> tuple[np.ndarray, ...]:
    """``starts, ends, lengths, keys`` of each place of each run of one to six tokens that can be an entry.

    Tokens are blanks, single punctuation marks and what is between; joined they are the
    text.  Lengths are in characters.  Equal runs have equal keys, as they have equal tokens.
    """
    data = piece.data
    sums = lambda x: np.concatenate([[0], np.cumsum(x, dtype=np.int64)])
    kind = _KIND[data]
    first = kind == 2
    first[1:] |= kind[1:] != kind[:-1]
    first[piece.starts[piece.starts < len(data)]] = True
    starts = np.flatnonzero(first)
    ends = np.append(starts[1:], len(data))[: len(starts)]
    doc = np.searchsorted(piece.starts, starts, side="right") - 1
    token = ta.hash_spans(data, starts, ends)
    chars, blanks, open_ = sums((data & 0xC0) != 0x80), sums(kind == 0), sums(_BRACKET[data])
    marks = sums((data == 0xC2) & (np.append(data[1:], 0) == 0xA7)) if len(data) else sums(first)
    solid = np.flatnonzero(data != 0x20)
    after = np.append(solid, len(data))[np.searchsorted(solid, starts)] - starts  # spaces that a token begins with
    before = ends - 1 - np.append(solid, -1)[np.searchsorted(solid, ends) - 1]  # and ends with
    out, key = [], np.zeros(len(starts), np.uint64)
    for n in range(1, 7):
        m = len(starts) - n + 1
        if m <= 0:
            break
        key = ta.mix64(key[:m] * np.uint64(0x9E3779B97F4A7C15) + token[n - 1 :])
        s, e = starts[:m], ends[n - 1 :]
        size = chars[e] - chars[s]
        at = np.flatnonzero((size >= min_length) & (size <= LONGEST) & (doc[:m] == doc[n - 1 :]))
        s, e, size = s[at], e[at], size[at]
        fits = ((blanks[e] - blanks[s]) * 2 <= size) & (open_[e] == open_[s]) & (marks[e] == marks[s]) & (size - after[at] - before[at + n - 1] >= 3)
        out.append((s[fits], e[fits], size[fits], key[at[fits]]))
    if not out:
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(np.uint64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _place(keys: np.ndarray) -> np.ndarray:
    return (keys >> np.uint64(20)).astype(np.int64) & (PLACES - 1)


def _savings(length: Column, n: Column) -> Column:
    """Characters that codes of two save, less the entry of the legend."""
    return (length - 2) * n - (length + 6)


def _proposed(texts: DataFrame, min_length: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys, ascending, and lengths of the runs that save most in some of the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in ta.slices(batch.column(0)):
                _, _, size, key = _runs(piece, min_length)
                keys, at, n = np.unique(key, return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(size[at]), pa.array(n.astype(np.int64))], ["key", "length", "n"])

    one_of = max(_PROPOSING, texts.count() // _PROPOSERS)
    some = texts.filter(F.pmod(F.xxhash64("text"), F.lit(one_of)) == 0).mapInArrow(run, "key long, length long, n long")
    best = some.groupBy("key", "length").agg(F.sum("n").alias("n")).orderBy(F.desc((F.col("length") - 2) * F.col("n"))).limit(most).toArrow()
    keys, lengths = (np.asarray(best.column(c)) if best.num_rows else np.zeros(0, np.int64) for c in ("key", "length"))
    keys, at = np.unique(keys.view(np.uint64), return_index=True)
    return keys, lengths[at]


def _tables(texts: DataFrame, min_length: int, keys: np.ndarray) -> DataFrame:
    """``at, sums`` of each task: its table of savings in rows, a byte a place and none too small, and after it its counts of ``keys``.

    There are only some tasks, however many files the texts have: what they hand on has a fixed size.
    """
    known = texts.sparkSession.sparkContext.broadcast(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = known.value
        total, counts, maybe = np.zeros(PLACES, np.int64), np.zeros(-(-len(keys) // _ROW) * _ROW, np.int64), np.zeros(PLACES, bool)
        maybe[_place(keys)] = True
        for batch in batches:
            for piece in ta.slices(batch.column(0)):
                _, _, size, key = _runs(piece, min_length)
                place = _place(key)
                total += np.bincount(place, weights=np.maximum(size - 2, 0), minlength=PLACES).astype(np.int64)
                key = key[maybe[place]]
                at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                if len(keys):
                    counts += np.bincount(at[keys[at] == key], minlength=len(counts))
        first = PLACES // _ROW
        for i, row in enumerate([*total.reshape(-1, _ROW), *counts.reshape(-1, _ROW)]):
            if row.any():
                level = np.searchsorted(_LEVELS, row)
                # Sums beyond the last level go as they are, like the counts.
                raw = row.tobytes() if i >= first or level.max() == len(_LEVELS) else level.astype(np.uint8).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([raw], pa.binary())], ["at", "sums"])

    return texts.coalesce(max(_TABLES, 2 * texts.sparkSession.sparkContext.defaultParallelism)).mapInArrow(run, "at int, sums binary")


def _summed(texts: DataFrame, min_length: int, keys: np.ndarray) -> DataFrame:
    """``at, sums``: the table of savings in rows, none too small, and after it the counts of ``keys``."""

    def add(group: pa.Table) -> pa.Table:
        total = np.zeros(_ROW, np.int64)
        for raw in group.column("sums").to_pylist():
            total += _LEVELS[np.frombuffer(raw, np.uint8)] if len(raw) == _ROW else np.frombuffer(raw, np.int64)
        return pa.table({"at": group.column("at").slice(0, 1), "sums": pa.array([total.tobytes()], pa.binary())})

    return _tables(texts, min_length, keys).groupBy("at").applyInArrow(add, "at int, sums binary")


def candidates(texts: DataFrame, text_col: str, min_length: int = 8, min_occurrences: int = 3, pool: int = 5000) -> tuple[DataFrame, bool]:
    """``substring, count, savings`` of the runs that save most, and whether these are all there are.

    If not, there are about ``pool`` of them, and all others save less.  Counts are of
    places that start at a token, of all texts; those that overlap themselves count each.
    """
    sc = texts.sparkSession.sparkContext
    texts = texts.select(F.col(text_col).alias("text"))
    keys, lengths = _proposed(texts, min_length, 4 * pool)
    table = written(_summed(texts, min_length, keys), "run-savings")
    least, first = 6, PLACES // _ROW
    if len(keys) >= pool:
        counts = np.zeros(-(-len(keys) // _ROW) * _ROW, np.int64)
        for r in table.filter(F.col("at") >= first).collect():
            counts[(r["at"] - first) * _ROW :][:_ROW] = np.frombuffer(r["sums"], np.int64)
        counts = counts[: len(keys)]
        saved = np.where(counts >= min_occurrences, (lengths - 2) * counts - (lengths + 6), 0)
        least = max(least, int(np.sort(saved)[-pool]))

    def above(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = [np.packbits(np.frombuffer(raw, np.int64) > least).tobytes() for raw in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits, pa.binary())], ["at", "bits"])

    flags = np.zeros(PLACES, bool)
    for r in table.filter(F.col("at") < first).mapInArrow(above, "at int, bits binary").collect():
        flags[r["at"] * _ROW : (r["at"] + 1) * _ROW] = np.unpackbits(np.frombuffer(r["bits"], np.uint8)).astype(bool)
    forget(table)
    wanted = sc.broadcast(flags)

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in ta.slices(batch.column(0)):
                start, end, _, key = _runs(piece, min_length)
                some = np.flatnonzero(wanted.value[_place(key)])
                one, which = ta.distinct_spans(piece.data, start[some], end[some])
                n = np.bincount(which, minlength=len(one)).astype(np.int64)
                for low in range(0, len(one), 50_000):
                    each = some[one[low : low + 50_000]]
                    grams = [piece.data[i:j].tobytes().decode() for i, j in zip(start[each].tolist(), end[each].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(grams, pa.string()), pa.array(n[low : low + 50_000])], ["gram", "n"])

    counted = texts.mapInArrow(strings, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("count"))
    found = counted.select(F.col("gram").alias("substring"), "count", _savings(F.length("gram"), F.col("count")).alias("savings"))
    return found.filter((F.col("count") >= min_occurrences) & (F.col("savings") >= least)), least == 6


def _overlaps(a: str, b: str) -> bool:
    """Whether the longer has the first seven tenths of the shorter; blanks around are no part."""
    short, long = sorted((a.strip(), b.strip()), key=len)
    return short[: len(short) * 7 // 10] in long


def legend(texts: DataFrame, text_col: str, min_length: int = 8, min_occurrences: int = 3, most: int = len(DIGITS), pool: int = 5000) -> list[Entry]:
    """The substrings that save most in all texts, none overlapping a better one; ties to the lesser string.

    Null texts have none; without any repeated substring the legend is empty.
    """
    if not 0 < most <= len(DIGITS):
        raise ValueError(f"a legend has 1 to {len(DIGITS)} entries")
    while True:
        found, whole = candidates(texts, text_col, min_length, min_occurrences, pool)
        out: list[Entry] = []
        for row in sorted(found.collect(), key=lambda r: (-r["savings"], r["substring"])):
            if len(out) < most and not any(_overlaps(row["substring"], e.substring) for e in out):
                out.append(Entry(MARK + DIGITS[len(out)], *row))
        if whole or len(out) == most:
            return out
        pool *= 4


def encode(text: str, entries: list[tuple[str, str]]) -> str:
    """The text with codes for occurrences that don't overlap and together save most; the mark itself is doubled."""
    spans = []
    for code, sub in entries:
        at = text.find(sub)
        while at >= 0:
            spans.append((at + len(sub), at, code))
            at = text.find(sub, at + 1)
    # Of spans by their ends, the best total so far, the span that reached it and the step before it.
    ends, totals, steps = [0], [0], [(0, 0, "", 0)]
    for end, start, code in sorted(spans):
        before = bisect_right(ends, start) - 1
        total = totals[before] + end - start - 2
        if total > totals[-1]:
            ends.append(end), totals.append(total), steps.append((start, end, code, before))
    chosen, i = [], len(steps) - 1
    while i:
        chosen.append(steps[i])
        i = steps[i][3]
    out, at = [], 0
    for start, end, code, _ in reversed(chosen):
        out += [text[at:start].replace(MARK, MARK * 2), code]
        at = end
    return "".join([*out, text[at:].replace(MARK, MARK * 2)])


def compress(texts: DataFrame, text_col: str, entries: list[Entry], out_col: str = "compressed") -> DataFrame:
    """Adds the texts with codes of a legend (null stays null); ``expand`` gives each back exactly."""
    pairs = [(e.code, e.substring) for e in entries]

    @F.pandas_udf("string")
    def coded(text: pd.Series) -> pd.Series:
        return text.map(lambda t: None if t is None else encode(t, pairs))

    return texts.withColumn(out_col, coded(F.col(text_col)))


def expand(text: Column, entries: list[Entry]) -> Column:
    """Texts of ``compress`` with their codes replaced by the legend's strings."""
    known = {MARK: MARK, **{e.code[1]: e.substring for e in entries}}
    full = F.create_map(*[F.lit(x) for item in known.items() for x in item])
    pieces = F.split(text, f"(?s){MARK}.")
    codes = F.regexp_extract_all(text, F.lit(f"(?s){MARK}(.)"), F.lit(1))
    rest = F.zip_with(codes, F.slice(pieces, F.lit(2), F.size(pieces) - 1), lambda c, p: F.concat(full[c], p))
    return F.concat(pieces[0], F.array_join(rest, ""))
