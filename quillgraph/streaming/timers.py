"""Expiry and due triggers of records with event-time timers.

A record is put with a time at which it is due and one at which it expires, either of
which may be null.  A later put of the same key, or a ``take``, ends the earlier record.
Timers fire when the watermark passes them, by which time all rows up to then are there
or too late, so what fires does not depend on the order of arrival.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: A key's records in the state, as one array of ``at, due, expires``: milliseconds, -1 where there is no time or it is over.
_RECORDS = StructType([StructField("records", BinaryType())])
_NEVER = -1


def _settled(records: list[tuple], now: int) -> tuple[list[tuple], list[tuple]]:
    """``event, at, time`` of what came due up to ``now``, and the records that may still matter.

    One pass over the rows by time.  A row ends the times of an earlier one from its own
    on, and rows to come can only end more of them, so those are crossed out at once.  A
    row without open times stays until ``now`` passes it: one that comes late may be before it.
    """
    out, left, following, at_before = [], [], None, None
    for at, *times in sorted(records, reverse=True):
        if at != at_before:
            following, at_before = at_before, at
        for i, event in enumerate(("fired", "expired")):
            if times[i] != _NEVER and following is not None and times[i] >= following:
                times[i] = _NEVER
            if times[i] != _NEVER and times[i] <= now:
                out.append((event, at, times[i]))
                times[i] = _NEVER
        if at > now or max(times) > _NEVER:
            left.append((at, *times))
    return sorted(out, key=lambda x: x[2]), left


def _wakes(records: list[tuple]) -> int | None:
    """When a key's timer is due: at the first open time, or else when its last row can go."""
    if not records:
        return None
    return min((t for r in records for t in r[1:] if t != _NEVER), default=max(r[0] for r in records))


class _Timers(StatefulProcessor):
    """Open records of one key, and a single timer for the first of their times."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._records = handle.getValueState("records", _RECORDS)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        before = self._kept()
        new = []
        for frame in rows:
            puts = frame["op"] == "put"
            due, expires = (frame[c].where(puts).fillna(_NEVER).astype("int64").tolist() for c in ("due_ms", "expires_ms"))
            new += zip(frame["at_ms"].tolist(), due, expires, strict=True)
        # What is due by now comes from the timer, which is called after the rows.
        self._keep(_settled(before + new, _NEVER)[1], _wakes(before))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        out, left = _settled(self._kept(), now)
        self._keep(left)
        if out:
            yield pd.DataFrame([(key[0], *o) for o in out], columns=["key", "event", "put_ms", "time_ms"])

    def _kept(self) -> list[tuple]:
        stored = self._records.get()
        return [tuple(r) for r in np.frombuffer(stored[0], "<i8").reshape(-1, 3).tolist()] if stored else []

    def _keep(self, records: list[tuple], timer: int | None = None) -> None:
        """Keeps the records and moves the timer, if there is one."""
        wakes = _wakes(records)
        if timer != wakes:
            if timer is not None:
                self._handle.deleteTimer(timer)
            if wakes is not None:
                self._handle.registerTimer(wakes)
        if records:
            self._records.update((np.array(records, "<i8").tobytes(),))
        else:
            self._records.clear()

    def close(self) -> None:
        pass


def _millis(column: str) -> F.Column:
    return F.unix_millis(F.col(column).cast("timestamp"))


def watch(changes: DataFrame, late: str = "0 seconds") -> DataFrame:
    """``key, event, put_at, time`` of a stream of ``key, op, at, due, expires``: event ``fired`` or ``expired``.

    ``op`` is ``put``, or anything else to end a record.  Rows that come later than ``late``
    behind the greatest ``at`` are dropped.  The state is in RocksDB, as Spark asks for
    with timers, so a restart goes on where the checkpoint is.
    """
    spark = changes.sparkSession
    if "RocksDB" not in spark.conf.get(_PROVIDER, ""):
        spark.conf.set(_PROVIDER, _ROCKS)
    rows = changes.withWatermark("at", late).select(F.col("key").cast("string").alias("key"), "op", "at", _millis("at").alias("at_ms"), _millis("due").alias("due_ms"), _millis("expires").alias("expires_ms"))
    schema = StructType([StructField("key", StringType()), StructField("event", StringType()), StructField("put_ms", LongType()), StructField("time_ms", LongType())])
    found = rows.groupBy("key").transformWithStateInPandas(_Timers(), schema, "append", "eventTime")
    return found.select("key", "event", F.timestamp_millis("put_ms").alias("put_at"), F.timestamp_millis("time_ms").alias("time"))


def due_by(changes: DataFrame, until: F.Column) -> DataFrame:
    """The same of a table, for all times up to ``until``: a record lives until the key's next row."""
    times = changes.select(F.col("key").cast("string").alias("key"), "op", *[_millis(c).alias(c) for c in ("at", "due", "expires")])
    following = F.min("at").over(Window.partitionBy("key").orderBy("at").rangeBetween(1, Window.unboundedFollowing))
    both = F.explode(F.array(F.struct(F.lit("fired").alias("event"), F.col("due").alias("time")), F.struct(F.lit("expired").alias("event"), F.col("expires").alias("time"))))
    rows = times.withColumn("following", following).filter("op = 'put'").select("key", "at", "following", both.alias("e"))
    lives = F.col("following").isNull() | (F.col("following") > F.col("e.time"))
    limit = F.unix_millis(until.cast("timestamp"))
    return rows.filter((F.col("e.time") <= limit) & lives).select("key", "e.event", F.timestamp_millis("at").alias("put_at"), F.timestamp_millis("e.time").alias("time"))
