"""Timers of a replayed stream equal the batch, with rows out of order, too late, and a restart."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quillgraph.session import shared_path
from quillgraph.streaming import timers

SCHEMA = "key string, op string, at timestamp, due timestamp, expires timestamp"
T0 = datetime(2024, 1, 1)


def minute(m):
    return None if m is None else T0 + timedelta(minutes=m)


def replay(spark, parts, late, checkpoint, source, out):
    for part in parts:
        spark.createDataFrame([(k, op, minute(a), minute(d), minute(e)) for k, op, a, d, e in part], SCHEMA).coalesce(1).write.mode("append").parquet(source)
        found = timers.watch(spark.readStream.schema(SCHEMA).parquet(source), late)
        # Each part is a run of its own: the next one starts again from the checkpoint.
        found.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").outputMode("append").start(out).awaitTermination()
    return sorted(map(str, map(tuple, spark.read.schema("key string, event string, put_at timestamp, time timestamp").parquet(out).collect())))


def batch(spark, rows, until):
    df = spark.createDataFrame([(k, op, minute(a), minute(d), minute(e)) for k, op, a, d, e in rows], SCHEMA)
    return sorted(map(str, map(tuple, timers.due_by(df, F.lit(minute(until))).collect())))


@pytest.mark.parametrize("seed", [1])
def test_a_stream_equals_the_batch(spark, seed):
    r = random.Random(seed)
    source, out, checkpoint = (shared_path(spark, n) for n in ("timer-rows", "timer-out", "timer-progress"))
    rows = []
    for at in range(0, 60, 2):
        rows.append((r.choice("abc"), r.choice(["put", "put", "put", "take"]), at, r.choice([None, at + r.randint(0, 9)]), r.choice([None, at + r.randint(0, 25)])))
    # Out of order within ten minutes, over three runs; then a tick, and a row that is too late.
    mixed = sorted(rows, key=lambda x: x[2] + r.uniform(0, 9))
    parts = [mixed[:10], mixed[10:20], mixed[20:], [("tick", "take", 200, None, None)], [("a", "put", 3, 4, 5), ("tick", "take", 201, None, None)]]
    got = replay(spark, parts, "10 minutes", checkpoint, source, out)
    assert got == batch(spark, rows, 191) and got


def test_what_ends_a_record(spark):
    rows = [("a", "put", 0, 5, 20), ("a", "put", 10, None, 12), ("b", "put", 0, 5, 9), ("b", "take", 5, None, None), ("c", "put", 0, 90, 95), ("d", "take", 0, 1, 2)]
    assert batch(spark, rows, 60) == sorted(map(str, [("a", "fired", minute(0), minute(5)), ("a", "expired", minute(10), minute(12))]))


def test_one_pass_settles_a_key(spark):
    """A key of many rows is one timer; before, each time was a timer that went through all rows."""
    records = [(at, at + 30, at + 360) for at in range(0, 200_000, 20)]
    out, left = timers._settled(records, 199_970)
    assert out == [] and left == [(199_980, 200_010, 200_340)]
    assert timers._wakes(left) == 200_010 and timers._wakes([(7, -1, -1)]) == 7 and timers._wakes([]) is None
    assert timers._settled(left, 200_010) == ([("fired", 199_980, 200_010)], [(199_980, -1, 200_340)])


def test_a_late_put_is_ended_by_what_came_before_it(spark):
    source, out, checkpoint = (shared_path(spark, n) for n in ("timer-rows", "timer-out", "timer-progress"))
    parts = [[("a", "take", 10, None, None)], [("a", "put", 5, 12, 9)], [("tick", "take", 60, None, None)]]
    got = replay(spark, parts, "10 minutes", checkpoint, source, out)
    assert got == batch(spark, [x for p in parts for x in p], 50) and len(got) == 1
