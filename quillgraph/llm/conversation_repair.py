"""Cheapest repair of conversation structure by lazy weighted determinisation.

A conversation should be nothing, or turns of user and assistant in pairs after at most
one system turn.  Edits have costs; the automaton of edits is nondeterministic (a row
may be kept, given another role, deleted, and turns inserted before it).  Its vectors of
the costs of all states, less their minimum, are the states of a deterministic automaton,
made when they are first met and cached in a transition table with the cost taken off.
A table scan over the rows, from the last to the first, gives costs; walking back over
the scan along tight arcs, from the first row to the last, gives the edits.

Conversations of ordinary size are dealt out whole.  Larger ones are cut into segments of
bounded size: tables of costs between the states at both ends of a segment are joined up
along the conversation, then all segments trace their edits at once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written

#: Rows, and bytes of text, from which a conversation is cut into segments; also the size of these.
SEGMENT_ROWS, SEGMENT_BYTES = 4096, 4 << 20
#: What edits cost.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
_BLANKS = " \t\n\v\f\r"
_NEVER = 1 << 60

#: States of the roles written so far: none, a system turn, a user turn last, an assistant turn last.
_NONE, _SYSTEM, _USER, _ASSISTANT = range(4)
_ACCEPTS = (0, _NEVER, _NEVER, 0)
#: The state after the user or assistant turn that may come next.
_NEXT = (_USER, _USER, _ASSISTANT, _USER)
#: The state after a kept row of each role initial, where it may come.
_KEEPS = {"s": {_NONE: _SYSTEM}, "u": {_NONE: _USER, _SYSTEM: _USER, _ASSISTANT: _USER}, "a": {_USER: _ASSISTANT}}
_ROLE = {_USER: "user", _ASSISTANT: "assistant"}
#: Faults of rows; blank and duplicate rows must be deleted.
SOUND, CUT_OFF, DOOMED = range(3)

Symbol = tuple[str, int]
Vector = tuple[int, ...]


def _closed(costs: list[int]) -> Vector:
    """Costs where turns may be inserted first."""
    for _ in range(3):
        costs = [min(c, costs[_NEXT[q]] + INSERT) for q, c in enumerate(costs)]
    return tuple(min(c, _NEVER) for c in costs)


def _arcs(state: int, symbol: Symbol) -> Iterator[tuple[str, int, int]]:
    """Edits of a row in a state, in the order of their letters: letter, cost, state after."""
    role, fault = symbol
    yield "D", DELETE, state
    if fault == DOOMED:
        return
    extra = TRUNCATED if fault == CUT_OFF else 0
    after = _KEEPS.get(role, {}).get(state)
    if after is not None:
        yield "K", extra, after
    yield "R", REROLE + extra, _NEXT[state]


class Automaton:
    """States are normalised vectors of costs to go; transitions and tight arcs are worked out once."""

    def __init__(self) -> None:
        self.vectors: list[Vector] = []
        self._number: dict[Vector, int] = {}
        self._steps: dict[tuple[int, Symbol], tuple[int, int]] = {}
        self._tight: dict[tuple[int, Symbol, int], tuple[str, int]] = {}

    def state(self, costs: Vector) -> tuple[int, int]:
        """The state of a vector, and what is taken off it."""
        least = min(costs)
        shape = tuple(c - least if c < _NEVER else _NEVER for c in costs)
        if shape not in self._number:
            self._number[shape] = len(self.vectors)
            self.vectors.append(shape)
        return self._number[shape], least

    def step(self, after: int, symbol: Symbol) -> tuple[int, int]:
        """State and cost taken off before a row, from the state after it."""
        key = (after, symbol)
        if key not in self._steps:
            to_go = self.vectors[after]
            costs = [min(c + to_go[q] for _, c, q in _arcs(p, symbol)) for p in range(4)]
            self._steps[key] = self.state(_closed(costs))
        return self._steps[key]

    def scan(self, rows: list[tuple[Symbol, int]], end: int) -> tuple[list[int], int]:
        """States before each row and after the last, and the cost taken off on the way."""
        states, total = [end], 0
        for symbol, times in reversed(rows):
            state, off = self.step(states[-1], symbol)
            # Further deletions of the same row cost as much each and change nothing else.
            total += off * times
            states.append(state)
        return states[::-1], total

    def edit(self, after: int, symbol: Symbol, state: int) -> tuple[str, int]:
        """The least letter that is tight before a row, and the state it leads to."""
        key = (after, symbol, state)
        if key not in self._tight:
            before, off = self.step(after, symbol)
            here, to_go = self.vectors[before][state] + off, self.vectors[after]
            options = [(letter, q) for letter, c, q in _arcs(state, symbol) if c + to_go[q] == here]
            if self.vectors[before][_NEXT[state]] + off + INSERT == here:
                options.append(("I", _NEXT[state]))
            self._tight[key] = min(options)
        return self._tight[key]

    def trace(self, rows: list[tuple[Symbol, int]], states: list[int], state: int) -> tuple[list[tuple[str, int, int]], int]:
        """Cheapest edits from a state on, least letters first: letter, row (of an insertion the one after it), state after."""
        out: list[tuple[str, int, int]] = []
        for i, (symbol, times) in enumerate(rows):
            while True:
                letter, state = self.edit(states[i + 1], symbol, state)
                out.append((letter * times if letter == "D" else letter, i, state))
                if letter != "I":
                    break
        return out, state


def closing(state: int) -> list[int]:
    """States after the turns that must be inserted at the very end."""
    out = []
    while _ACCEPTS[state]:
        state = _NEXT[state]
        out.append(state)
    return out


def faults(rows: list[tuple[int | None, str, str, int]], seen: set, stale: frozenset = frozenset()) -> tuple[list[tuple[Symbol, int]], dict[str, int], list[int]]:
    """Symbols with repetitions, counts of faults, and the row of each symbol.

    Rows are turn, role, text and how often they repeat; ``seen`` has roles and texts of
    earlier rows (as hashes where they must be small), ``stale`` those met in other segments.
    """
    symbols: list[tuple[Symbol, int]] = []
    count = {"blank": 0, "duplicate": 0, "truncated": 0}
    where: list[int] = []
    for i, (_, role, text, times) in enumerate(rows):
        solid, key = text.rstrip(_BLANKS), _key(role, text)
        kept = bool(solid) and key not in seen and key not in stale
        seen.add(key)
        if kept:
            fault = SOUND if solid[-1] in ".!?" else CUT_OFF
            count["truncated"] += fault == CUT_OFF
            symbols.append(((role[:1], fault), 1))
            where.append(i)
        doomed = times - kept
        count["duplicate" if solid else "blank"] += doomed
        if doomed:
            symbols.append(((role[:1], DOOMED), doomed))
            where.append(i)
    return symbols, count, where


def _key(role: str, text: str) -> bytes:
    return hashlib.md5(f"{len(role)}:{role}{text}".encode("utf-8", "surrogatepass"), usedforsecurity=False).digest()


_LEGAL = {"su", "ua", "au"}


def illegal_pairs(symbols: list[tuple[Symbol, int]]) -> int:
    """Neighbours whose role initials are none of su, ua and au."""
    inside = sum(times - 1 for _, times in symbols)
    return inside + sum(a[0][0] + b[0][0] not in _LEGAL for a, b in zip(symbols, symbols[1:], strict=False))


def gaps(turns: set[int]) -> int:
    return max(turns) - min(turns) + 1 - len(turns) if turns else 0


def lines(edits: list[tuple[str, int, int]], rows: list[tuple[int | None, str, str, int]], where: list[int]) -> list[str]:
    """The repaired turns of edits, as role and text."""
    out = []
    for letter, i, state in edits:
        if letter == "I":
            out.append(f"{_ROLE[state]}:")
        elif letter in ("K", "R"):
            _, role, text, _ = rows[where[i]]
            out.append(f"{role if letter == 'K' else _ROLE[state]}:{text}")
    return out


RESULT = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
_NUMBERS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def repair_rows(automaton: Automaton, rows: list[tuple[int | None, str, str, int]]) -> tuple[list[int], str, list[str]]:
    """Numbers, audit and repaired lines of one whole conversation, its rows in order."""
    symbols, count, where = faults(rows, set())
    end, base = automaton.state(_closed(list(_ACCEPTS)))
    states, off = automaton.scan(symbols, end)
    cost = base + off + automaton.vectors[states[0]][_NONE]
    edits, state = automaton.trace(symbols, states, _NONE)
    edits += [("I", -1, q) for q in closing(state)]
    numbers = [gaps({r[0] for r in rows if r[0] is not None}), count["blank"], count["duplicate"], count["truncated"], illegal_pairs(symbols), cost]
    return numbers, "".join(e[0] for e in edits), lines(edits, rows, where)


# -- Spark jobs --------------------------------------------------------------------------


def damaged(conversations: DataFrame) -> DataFrame:
    """A test's damage, by crc32 of ``conv_id:turn`` modulo 20 (nulls as one space).

    0 drops a row, 1 empties its text, 2 removes ``[.!?]`` from it, 3 repeats it, 4 makes
    it a user's.  Null roles and texts are one space.
    """
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    d = F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn"))) % 20
    rows = conversations.select("conv_id", "turn", name("role").alias("role"), name("text").alias("text"), d.alias("d")).filter("d <> 0")
    role = F.when(F.col("d") == 4, "user").otherwise(F.col("role"))
    text = F.when(F.col("d") == 1, "").when(F.col("d") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    twice = F.explode(F.when(F.col("d") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), twice.alias("copy")).drop("copy")


def _runs(batches: Iterator[pa.RecordBatch], most_rows: int, most_bytes: int) -> Iterator[tuple[object, list[tuple[int | None, str, str, int]], bool, bool]]:
    """Sorted rows as runs of one conversation, equal neighbours as one row: id, rows, whether the run begins and ends the conversation here.

    A run ends where ``most_rows`` or ``most_bytes`` are full, so memory is bounded.
    """
    now, rows, size, begins, any_ = None, [], 0, True, False
    for batch in batches:
        for conv, *row in zip(*(batch.column(j).to_pylist() for j in range(5)), strict=True):
            if any_ and conv != now:
                yield now, rows, begins, True
                rows, size, begins = [], 0, True
            elif rows and rows[-1][:3] == tuple(row[:3]):
                rows[-1] = (*rows[-1][:3], rows[-1][3] + row[3])
                continue
            elif rows and (len(rows) >= most_rows or size > most_bytes):
                yield now, rows, begins, False
                rows, size, begins = [], 0, False
            now, any_ = conv, True
            rows.append(tuple(row))
            size += len(row[2])
    if rows:
        yield now, rows, begins, True


def _whole(rows: DataFrame, kind: str) -> DataFrame:
    """Repairs conversations that fit a segment: one shuffle by id, one pass."""
    limits = (SEGMENT_ROWS, SEGMENT_BYTES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton()
        found, type_ = [], None

        def table() -> pa.RecordBatch:
            ids, numbers, audits, digests = zip(*found, strict=True)
            columns = [pa.array(ids, type_), *(pa.array(c, pa.int64()) for c in zip(*numbers, strict=True)), pa.array(audits, pa.string()), pa.array(digests, pa.string())]
            return pa.RecordBatch.from_arrays(columns, ["conv_id", *_NUMBERS, "audit", "repaired_sha256"])

        def noted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            nonlocal type_
            for b in batches:
                type_ = b.schema.field(0).type
                yield b

        for conv, turns, _, _ in _runs(noted(batches), *limits):
            numbers, audit, text = repair_rows(automaton, turns)
            found.append((conv, numbers, audit, _sha(text)))
            if len(found) >= 1024:
                yield table()
                found = []
        if found:
            yield table()

    order = ["conv_id", F.asc_nulls_first("turn"), "role", "text"]
    return rows.withColumn("times", F.lit(1).cast("bigint")).repartition("conv_id").sortWithinPartitions(*order).mapInArrow(run, f"conv_id {kind}, {RESULT}")


def _sha(text: list[str]) -> str:
    return hashlib.sha256("\n".join(text).encode("utf-8", "surrogatepass")).hexdigest()


def _combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Equal rows of a batch as one with their number, before anything is dealt out."""
    for batch in batches:
        keys = batch.schema.names
        grouped = pa.Table.from_batches([batch.append_column("n", pa.array(np.ones(batch.num_rows), pa.int64()))]).group_by(keys).aggregate([("n", "sum")])
        yield from grouped.select([*keys, "n_sum"]).rename_columns([*keys, "times"]).to_batches()


_SEGMENT = "conv_id {kind}, part int, n int, turns array<bigint>, roles array<string>, texts array<string>, times array<bigint>, keys array<binary>"


def _segments(rows: DataFrame, kind: str) -> DataFrame:
    """Large conversations cut into segments, in order of (part, n): one range shuffle, then bounded rows."""
    limits = (SEGMENT_ROWS, SEGMENT_BYTES)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, types = TaskContext.get().partitionId(), []

        def noted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                types[:] = [b.schema.field(0).type]
                yield b

        for n, (conv, turns, _, _) in enumerate(_runs(noted(batches), *limits)):
            t, r, x, m = (list(c) for c in zip(*turns, strict=True))
            keys = list(dict.fromkeys(_key(a, b) for a, b in zip(r, x, strict=True)))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([conv], types[0]), pa.array([part], pa.int32()), pa.array([n], pa.int32()), pa.array([t], pa.list_(pa.int64())), pa.array([r], pa.list_(pa.string())),
                    pa.array([x], pa.list_(pa.string())), pa.array([m], pa.list_(pa.int64())), pa.array([keys], pa.list_(pa.binary())),
                ],
                ["conv_id", "part", "n", "turns", "roles", "texts", "times", "keys"],
            )

    combined = rows.mapInArrow(_combined, f"conv_id {kind}, turn bigint, role string, text string, times bigint")
    order = ["conv_id", F.asc_nulls_first("turn"), "role", "text"]
    return combined.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(cut, _SEGMENT.format(kind=kind))


def _rows_of(segment: dict) -> tuple[list[tuple[Symbol, int]], dict[str, int], list[int], list]:
    rows = list(zip(segment["turns"], segment["roles"], segment["texts"], segment["times"], strict=True))
    return *faults(rows, set(), frozenset(segment["stale"] or ())), rows


def _large(rows: DataFrame, kind: str) -> DataFrame:
    """Repairs conversations of any size, segment by segment.

    What meets along a conversation are a few numbers for each segment; texts are read by
    one task for each segment, and hashed at the end as a sorted stream.
    """
    cut = written(_segments(rows, kind), "segments")
    at = ["conv_id", "part", "n"]
    met = cut.select(*at, F.explode("keys").alias("key"))
    first = met.groupBy("conv_id", "key").agg(F.min(F.struct("part", "n")).alias("first"))
    pairs = met.join(first.withColumnRenamed("conv_id", "c").withColumnRenamed("key", "k"), F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("key") == F.col("k")))
    stale = pairs.filter(F.struct("part", "n") > F.col("first")).groupBy(*at).agg(F.collect_list("key").alias("stale"))
    flagged = written(_join(cut.drop("keys"), stale, at, "left"), "segments-flagged")

    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton()
        for batch in batches:
            for i, s in enumerate(batch.to_pylist()):
                symbols, count, _, _ = _rows_of(s)
                # costs[p][q]: from state p before the segment to state q after it.
                columns = []
                for q in range(4):
                    end, base = automaton.state(tuple(0 if p == q else _NEVER for p in range(4)))
                    states, off = automaton.scan(symbols, end)
                    columns.append([c if c >= _NEVER else c + base + off for c in automaton.vectors[states[0]]])
                costs = [columns[q][p] for p in range(4) for q in range(4)]
                numbers = [count["blank"], count["duplicate"], count["truncated"], illegal_pairs(symbols)]
                ends = [symbols[0][0][0], symbols[-1][0][0]]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, 1), *(pa.array([s[c]], pa.int32()) for c in ("part", "n")), pa.array([costs], pa.list_(pa.int64())), pa.array([numbers], pa.list_(pa.int64())), pa.array([ends], pa.list_(pa.string()))],
                    [*at, "costs", "numbers", "ends"],
                )

    summaries = written(flagged.mapInArrow(summary, f"conv_id {kind}, part int, n int, costs array<bigint>, numbers array<bigint>, ends array<string>"), "segment-costs")

    def chain(group: pa.Table) -> pa.Table:
        """Costs to go after each segment; with the first one the numbers of the conversation."""
        s = sorted(group.to_pylist(), key=lambda r: (r["part"], r["n"]))
        to_go: list[Vector] = [_closed(list(_ACCEPTS))]
        for r in reversed(s):
            c = r["costs"]
            to_go.append(_closed([min(c[4 * p + q] + to_go[-1][q] for q in range(4)) for p in range(4)]))
        to_go.reverse()
        totals = [sum(r["numbers"][j] for r in s) for j in range(4)]
        totals[3] += sum(a["ends"][1] + b["ends"][0] not in _LEGAL for a, b in zip(s, s[1:], strict=False))
        whole = [[*totals, to_go[0][_NONE]], *[None] * (len(s) - 1)]
        return pa.table(
            {
                "conv_id": group.column("conv_id"), "part": pa.array([r["part"] for r in s], pa.int32()), "n": pa.array([r["n"] for r in s], pa.int32()),
                "to_go": pa.array([list(v) for v in to_go[1:]], pa.list_(pa.int64())), "final": pa.array([i == len(s) - 1 for i in range(len(s))]), "whole": pa.array(whole, pa.list_(pa.int64())),
            }
        )

    chained = written(summaries.groupBy("conv_id").applyInArrow(chain, f"conv_id {kind}, part int, n int, to_go array<bigint>, final boolean, whole array<bigint>"), "segment-chain")

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton()
        for batch in batches:
            for i, s in enumerate(batch.to_pylist()):
                symbols, _, where, turns = _rows_of(s)
                end, _ = automaton.state(tuple(s["to_go"]))
                states, _ = automaton.scan(symbols, end)
                for start in range(4):
                    if automaton.vectors[states[0]][start] >= _NEVER:
                        continue
                    edits, state = automaton.trace(symbols, states, start)
                    edits += [("I", -1, q) for q in (closing(state) if s["final"] else [])]
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).slice(i, 1), *(pa.array([v], pa.int32()) for v in (s["part"], s["n"], start, state)), pa.array(["".join(e[0] for e in edits)], pa.string()),
                            pa.array(["".join(t + "\n" for t in lines(edits, turns, where))], pa.string()),
                        ],
                        [*at, "start", "stop", "audit", "text"],
                    )

    traced = written(_join(flagged, chained, at, "inner").mapInArrow(trace, f"conv_id {kind}, part int, n int, start int, stop int, audit string, text string"), "segment-edits")

    def choose(group: pa.Table) -> pa.Table:
        """The state in which each segment begins."""
        moves: dict[tuple[int, int], dict[int, int]] = {}
        for r in group.select(["part", "n", "start", "stop"]).to_pylist():
            moves.setdefault((r["part"], r["n"]), {})[r["start"]] = r["stop"]
        state, out = _NONE, []
        for key in sorted(moves):
            out.append((*key, state))
            state = moves[key][state]
        columns = list(zip(*out, strict=True))
        return pa.table({"conv_id": group.column("conv_id").slice(0, len(out)), **{c: pa.array(v, pa.int32()) for c, v in zip(("part", "n", "start"), columns, strict=True)}})

    chosen = traced.select(*at, "start", "stop").groupBy("conv_id").applyInArrow(choose, f"conv_id {kind}, part int, n int, start int")
    pieces = _join(traced, chosen, [*at, "start"], "inner").select(*at, "audit", "text")

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, audit, digest, open_, type_ = None, [], hashlib.sha256(), b"", None

        def row() -> pa.RecordBatch:
            digest.update(open_[:-1])
            return pa.RecordBatch.from_arrays([pa.array([now], type_), pa.array(["".join(audit)], pa.string()), pa.array([digest.hexdigest()], pa.string())], ["conv_id", "audit", "repaired_sha256"])

        for batch in batches:
            type_ = batch.schema.field(0).type
            for conv, letters, text in zip(*(batch.column(j).to_pylist() for j in (0, 3, 4)), strict=True):
                if audit and conv != now:
                    yield row()
                    audit, digest, open_ = [], hashlib.sha256(), b""
                now = conv
                audit.append(letters)
                # All but the last newline, which ends nothing where no line follows.
                if text:
                    digest.update(open_)
                    open_ = text.encode("utf-8", "surrogatepass")
        if audit:
            yield row()

    text = pieces.repartition("conv_id").sortWithinPartitions(*at).mapInArrow(joined, f"conv_id {kind}, audit string, repaired_sha256 string")
    spans = rows.groupBy("conv_id").agg(F.min("turn").alias("low"), F.max("turn").alias("high"), F.countDistinct("turn").alias("turns"))
    numbers = chained.filter("whole is not null").select("conv_id", "whole")
    whole = _join(_join(text, numbers, ["conv_id"], "inner"), spans, ["conv_id"], "inner")
    counts = [F.col("whole")[i].alias(c) for i, c in enumerate(["blank", "duplicate", "truncated", "illegal", "cost"])]
    return whole.select("conv_id", F.coalesce(F.expr("high - low + 1 - turns"), F.lit(0)).alias("gaps"), *counts, "audit", "repaired_sha256")


def _join(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """An equi-join on keys of which the first may be null; keys once."""
    other = right.toDF(*[f"r_{c}" if c in keys else c for c in right.columns])
    on = left[keys[0]].eqNullSafe(other[f"r_{keys[0]}"])
    for k in keys[1:]:
        on = on & (left[k] == other[f"r_{k}"])
    return left.join(other, on, how).drop(*[f"r_{k}" for k in keys])


def repair(conversations: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Faults and cheapest repair of conversations (``conv_id, turn, role, text``): ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``.

    Rows are taken by turn, null turns first; rows of one turn by role and text.  Null
    roles and texts are one space; rows with a null id are one conversation.  A row that
    repeats an earlier one's role and text is a duplicate.  ``audit`` has the initials of
    the cheapest edits (Delete, Insert, Keep, Rerole), the ASCII-least of these.
    ``ids`` names conversations that have a result even if they have no rows: zeros, an
    empty audit and the hash of nothing; an empty table gives none.  Columns of other
    names are not carried.

    Conversations of up to ``SEGMENT_ROWS`` rows and ``SEGMENT_BYTES`` bytes are dealt out
    whole, and their texts shuffled once; others are cut into segments (see ``_large``).
    A row's own text must fit in memory.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select("conv_id", F.col("turn").cast("bigint").alias("turn"), text("role").alias("role"), text("text").alias("text"))
    kind = rows.schema["conv_id"].dataType.simpleString()
    large = _oversized(rows)
    if large is None:
        out = _whole(rows, kind)
    else:
        apart = rows.withColumnRenamed("conv_id", "c").join(large, F.col("c").eqNullSafe(F.col("conv_id")), "left_semi").withColumnRenamed("c", "conv_id")
        rest = rows.withColumnRenamed("conv_id", "c").join(large, F.col("c").eqNullSafe(F.col("conv_id")), "left_anti").withColumnRenamed("c", "conv_id")
        out = _whole(rest, kind).unionByName(_large(apart, kind))
    if ids is None:
        return out
    all_ = ids.select("conv_id").distinct().withColumnRenamed("conv_id", "id")
    filled = all_.join(out, F.col("id").eqNullSafe(F.col("conv_id")), "left")
    zero = [F.coalesce(F.col(c), F.lit(0).cast("bigint")).alias(c) for c in _NUMBERS]
    return filled.select(F.col("id").alias("conv_id"), *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(_sha([]))).alias("repaired_sha256"))


def _oversized(rows: DataFrame) -> DataFrame | None:
    """Ids of conversations too large for one segment, as a written table; nothing where there are none."""
    sizes = rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text").cast("decimal(38,0)")).alias("size"))
    large: Column = (F.col("n") > SEGMENT_ROWS) | (F.col("size") > SEGMENT_BYTES)
    found = written(sizes.filter(large).select("conv_id"), "large-conversations")
    return None if found.isEmpty() else found
