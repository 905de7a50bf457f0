"""Order-dependent choices, as sorted partitions streamed past a carry of bounded size.

Rows are dealt out by group and sorted; a task reads them batch by batch and keeps what the
operator needs to know of the rows before: a remaining budget, a running length, the rows
chosen so far.  A group may be longer than a batch, and than memory.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stream_groups(rows: DataFrame, group: str, order: list[Column], begin: Callable[[], object], step: Callable[[object, dict], list[tuple]], out: list[str], schema: str) -> DataFrame:
    """Applies ``step(carry, row)`` to the rows of each group in order; it changes the carry and gives the row's results.

    ``out`` names the columns that a result row starts with, as they are; what ``step``
    gives follows, with the names in ``schema``.  A null group is a group.
    """
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in out)
    sorted_ = rows.repartition(group).sortWithinPartitions(F.asc_nulls_first(group), *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, carry, first = None, None, True
        for batch in batches:
            kept, more = [], []
            columns = batch.to_pydict()
            names = list(columns)
            for i, values in enumerate(zip(*columns.values(), strict=True)):
                row = dict(zip(names, values, strict=True))
                if first or row[group] != now:
                    now, carry, first = row[group], begin(), False
                for result in step(carry, row):
                    kept.append(i)
                    more.append(result)
            same = [batch.column(c).take(pa.array(kept, pa.int64())) for c in out]
            added = [pa.array([m[j] for m in more], t) for j, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([*same, *added], [*out, *fields])

    fields = [p.split()[0] for p in schema.split(",")] if schema else []
    known = {"bigint": pa.int64(), "boolean": pa.bool_(), "string": pa.string(), "double": pa.float64()}
    types = [known[p.split()[1]] for p in schema.split(",")] if schema else []
    return sorted_.mapInArrow(run, f"{kinds}, {schema}" if schema else kinds)


def budget_knapsack(rows: DataFrame, group: str, key: str, value: str, cost: str, budget: int, required: str | None = None) -> DataFrame:
    """``group, key, required`` of a greedy choice under a budget for each group.

    ``required`` rows (a boolean column) come first and are taken whatever they cost; then
    rows by value / cost (0 where the cost is 0), ties by key, each if it still fits: what
    does not fit is skipped, and later ones may fit.  Null values and costs are 0.
    """
    must = F.coalesce(F.col(required), F.lit(False)) if required else F.lit(False)
    v, c = F.coalesce(F.col(value).cast("double"), F.lit(0.0)), F.coalesce(F.col(cost).cast("bigint"), F.lit(0))
    rate = F.when(c > 0, v / c).otherwise(0.0)
    some = rows.select(group, key, must.alias("must"), rate.alias("rate"), c.alias("cost"))

    def step(carry: dict, row: dict) -> list[tuple]:
        if not row["must"] and carry["used"] + row["cost"] > budget:
            return []
        carry["used"] += row["cost"]
        return [(row["must"],)]

    order = [F.desc("must"), F.when(F.col("must"), 0.0).otherwise(-F.col("rate")), F.asc(key)]
    return stream_groups(some, group, order, lambda: {"used": 0}, step, [group, key], "required boolean")


def chunks_by_size(turns: DataFrame, group: str, order: str, text: str, most: int = 2000) -> DataFrame:
    """``group, order, chunk``: a new chunk begins where the running length would pass ``most``; a longer text is one by itself."""
    some = turns.select(group, order, F.coalesce(F.length(text), F.lit(0)).cast("bigint").alias("n"))

    def step(carry: dict, row: dict) -> list[tuple]:
        if carry["used"] and carry["used"] + row["n"] > most:
            carry["chunk"], carry["used"] = carry["chunk"] + 1, 0
        carry["used"] += row["n"]
        return [(carry["chunk"],)]

    return stream_groups(some, group, [F.asc_nulls_first(order), F.asc("n")], lambda: {"used": 0, "chunk": 0}, step, [group, order], "chunk bigint")


def diverse_selection(rows: DataFrame, group: str, key: str, score: str, words: str, size: int, threshold: float) -> DataFrame:
    """``group, key, rank``: the best ``size`` rows of each group of which no two are too similar.

    By score, ties by key; a row whose word set's Jaccard similarity with a chosen one is
    over the threshold gives way to the next best.  The carry is the chosen rows' words.
    """
    some = rows.select(group, key, F.coalesce(F.col(score).cast("double"), F.lit(0.0)).alias("s"), F.coalesce(F.col(words), F.array().cast("array<string>")).alias("w"))

    def step(carry: list, row: dict) -> list[tuple]:
        own = set(row["w"])
        if len(carry) >= size or any(len(own & c) > threshold * len(own | c) for c in carry):
            return []
        carry.append(own)
        return [(len(carry),)]

    return stream_groups(some, group, [F.desc("s"), F.asc(key)], list, step, [group, key], "rank bigint")


def leader_clusters(rows: DataFrame, group: str, key: str, words: str, threshold: float) -> DataFrame:
    """``group, key, leader`` (place of the leader in the group, from 1): a row joins the first leader that is similar enough, or leads.

    By key; the carry is the leaders' words, so it grows with them and not with the rows.
    """
    some = rows.select(group, key, F.coalesce(F.col(words), F.array().cast("array<string>")).alias("w"))

    def step(carry: list, row: dict) -> list[tuple]:
        own = set(row["w"])
        for n, other in enumerate(carry):
            union = len(own | other)
            if union and len(own & other) / union >= threshold:
                return [(n + 1,)]
        carry.append(own)
        return [(len(carry),)]

    return stream_groups(some, group, [F.asc(key)], list, step, [group, key], "leader bigint")


def clipped_sections(rows: DataFrame, group: str, order: str, text: str, budget: int) -> DataFrame:
    """``group, order, section``: texts in order under a budget of characters for each group.

    A text that does not fit any more is cut after its last sentence that does, and the
    group ends there; without one it is left out.  Null texts are empty.
    """
    some = rows.select(group, order, F.coalesce(F.col(text), F.lit("")).alias("t"))

    def step(carry: dict, row: dict) -> list[tuple]:
        left, t = budget - carry["used"], row["t"]
        if carry["full"]:
            return []
        if len(t) <= left:
            carry["used"] += len(t)
            return [(t,)]
        carry["full"] = True
        end = max(t.rfind(mark, 0, left) for mark in ".!?")
        return [(t[: end + 1],)] if end >= 0 else []

    return stream_groups(some, group, [F.asc_nulls_first(order), F.asc("t")], lambda: {"used": 0, "full": False}, step, [group, order], "section string")
