"""Quiet keys and missed deadlines of a stream, told by event-time timers over the state of each key.

Rows may come in any order within the watermark's delay; what is told does not depend on how they fell into
micro-batches. State is kept by Spark's RocksDB store, and a restart goes on from it.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def timer_store(spark: SparkSession) -> Iterator[None]:
    """Timers need the RocksDB store; a query takes the setting along when it starts, so the session's own comes back after."""
    before = spark.conf.get(_STORE)
    spark.conf.set(_STORE, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_STORE, before)


class _Quiet(StatefulProcessor):
    """Heartbeats wait until the watermark has passed them and are then taken in order.

    One timer a key: for the first that waits, or for the end of the last one's gap.
    """

    def __init__(self, gap_us: int, gaps: bool):
        self.gap, self.gaps = gap_us, gaps

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "us long")
        self.seen = handle.getValueState("seen", "last long, told boolean")
        self.due = handle.getValueState("due", "ms long")

    def _rest(self, ms: int) -> None:
        """Moves the key's timer to ``ms``."""
        old = self.due.get()
        if old is None or old[0] != ms:
            if old is not None:
                self.handle.deleteTimer(old[0])
            self.handle.registerTimer(ms)
            self.due.update((ms,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        came = [r["us"] for r in rows]
        self.waiting.appendList([(us,) for us in came])
        first, old = -(-min(came) // 1000), self.due.get()
        if old is None or first < old[0]:
            self._rest(first)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.due.clear()
        now = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = sorted(r[0] for r in self.waiting.get())
        ready, rest = [us for us in waiting if us <= now], [us for us in waiting if us > now]
        last, told = self.seen.get() or (None, False)
        out = []
        for us in ready:
            if last is not None and us - last > self.gap:
                if not self.gaps and not told:
                    out.append((last, None))
                if self.gaps:
                    out.append((last, us))
            if last is None or us > last:
                last, told = us, False
        if last is not None and not told and last + self.gap < now:
            told = True
            if not self.gaps:
                out.append((last, None))
        if rest:
            self.waiting.put([(us,) for us in rest])
        else:
            self.waiting.clear()
        if told and not self.gaps:
            self.seen.clear()  # nothing is known of a key that is told to be quiet, until it comes again
        elif last is not None:
            self.seen.update((last, told))
        ends = [] if last is None or told or self.gaps else [(last + self.gap) // 1000 + 1]
        following = [-(-rest[0] // 1000)] if rest else []
        if ends or following:
            self._rest(min(ends + following))
        return iter([Row(key=key[0], quiet_from_us=a, quiet_to_us=b) for a, b in out])


def _told(stream: DataFrame, key: str, ts: str, delay: str, processor: StatefulProcessor) -> DataFrame:
    kind = stream.schema[key].dataType.simpleString()
    timed = stream.where(F.col(ts).isNotNull()).select(F.col(key).alias("key"), F.col(ts).cast("timestamp").alias("ts")).withWatermark("ts", delay)
    rows = timed.withColumn("us", F.unix_micros("ts"))
    found = rows.groupBy("key").transformWithState(processor, f"key {kind}, quiet_from_us long, quiet_to_us long", "Append", "EventTime")
    return found.select(F.col("key").alias(key), F.timestamp_micros("quiet_from_us").alias("quiet_from"), F.timestamp_micros("quiet_to_us").alias("quiet_to"))


def heartbeat_gaps(stream: DataFrame, key: str, ts: str, gap_seconds: int, delay: str) -> DataFrame:
    """Stretches longer than the gap between neighbouring heartbeats, once the watermark has passed their end.

    A key's last heartbeat is kept. Rows without a time are left out; a null key is a key.
    """
    return _told(stream, key, ts, delay, _Quiet(gap_seconds * 1_000_000, gaps=True))


def expirations(stream: DataFrame, key: str, ts: str, ttl_seconds: int, delay: str) -> DataFrame:
    """The last row before every stretch of quiet of over ``ttl_seconds``, told as soon as the watermark has passed that long.

    ``quiet_to`` is null. A key's state goes when it is told, so that state holds keys in use only.
    """
    return _told(stream, key, ts, delay, _Quiet(ttl_seconds * 1_000_000, gaps=False))


class _Deadline(StatefulProcessor):
    """A start sets a timer for its deadline; an end that came by then keeps it silent."""

    def init(self, handle) -> None:
        self.handle = handle
        # one value, since every call of a key's state goes to the JVM and back: earliest deadline and end, and the timer that is set
        self.known = handle.getValueState("known", "limit long, ended long, due long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        old = self.known.get()
        limit, ended, due = old or (None, None, None)
        for r in rows:
            us, more = r["us"], r["limit_us"]
            if more is None:
                ended = us if ended is None else min(ended, us)
            else:
                limit = us + more if limit is None else min(limit, us + more)
        # an end without a start is forgotten once no start can come any more
        timer = (ended if limit is None else limit) // 1000 + 1
        if timer != due:
            if due is not None:
                self.handle.deleteTimer(due)
            self.handle.registerTimer(timer)
        if old is None or (limit, ended, timer) != tuple(old):
            self.known.update((limit, ended, timer))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        limit, ended, _ = self.known.get()
        self.known.clear()
        missed = limit is not None and (ended is None or ended > limit)
        return iter([Row(key=key[0], deadline_us=limit)] if missed else [])


#: Stands for no deadline and for no end.
_NONE = (1 << 63) - 1
#: Pieces of a group's state that are kept before they become one.
_PIECES = 32


def _least(rows: pa.Table) -> pa.Table:
    """Earliest deadline and end of every key."""
    found = rows.group_by("key").aggregate([("limit", "min"), ("ended", "min")])
    return found.select(["key", "limit_min", "ended_min"]).rename_columns(["key", "limit", "ended"])


def _packed(rows: pa.Table) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, rows.schema) as writer:
        writer.write_table(rows)
    return out.getvalue().to_pybytes()


def _due(rows: pa.Table) -> np.ndarray:
    """Of every key the timer that ``_Deadline`` sets."""
    limit = rows["limit"].to_numpy()
    return np.where(limit < _NONE, limit, rows["ended"].to_numpy()) // 1000 + 1


class _Deadlines(StatefulProcessor):
    """As ``_Deadline``, for all keys of a group: a call that goes to the JVM and back tells of many keys.

    What comes is kept in pieces, which are read once the earliest timer of any key is due.
    """

    def init(self, handle) -> None:
        self.handle = handle
        self.kept = handle.getListState("kept", "rows binary")
        self.at = handle.getValueState("at", "due long, pieces long")

    def _rows(self, key, frames) -> pa.Table:
        # the null key is the only one of its group
        tables = (pa.table({"key": np.zeros(len(f), np.int64) if key[0] < 0 else pa.array(f["key"]), "limit": f["limit"].to_numpy(np.int64), "ended": f["ended"].to_numpy(np.int64)}) for f in frames)
        return _least(pa.concat_tables([_least(t) for t in tables]))

    def _all(self) -> pa.Table:
        return _least(pa.concat_tables([pa.ipc.open_stream(r[0]).read_all() for r in self.kept.get()]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        came = self._rows(key, rows)
        due, pieces = self.at.get() or (None, 0)
        self.kept.appendList([(_packed(came),)])
        pieces += 1
        if pieces > _PIECES:
            self.kept.put([(_packed(self._all()),)])
            pieces = 1
        first = int(_due(came).min())
        if due is None or first < due:
            if due is not None:
                self.handle.deleteTimer(due)
            self.handle.registerTimer(first)
            due = first
        self.at.update((due, pieces))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self._all()
        timer = _due(held)
        done = timer <= timerValues.getCurrentWatermarkInMs()
        if done.all():
            self.kept.clear()
            self.at.clear()
        else:
            self.kept.put([(_packed(held.filter(pa.array(~done))),)])
            due = int(timer[~done].min())
            self.handle.registerTimer(due)
            self.at.update((due, 1))
        limit = held["limit"].to_numpy()
        told = held.filter(pa.array(done & (limit < _NONE) & (held["ended"].to_numpy() > limit)))
        if told.num_rows:
            yield pd.DataFrame({"key": told["key"].to_pandas() if key[0] >= 0 else pd.Series([None] * told.num_rows, dtype=object), "deadline_us": told["limit"].to_numpy()})


def missed_deadlines(stream: DataFrame, key: str, ts: str, limit_seconds: str, delay: str, groups: int = 1024) -> DataFrame:
    """Keys that started and had no end by their deadline, told once the watermark has passed it.

    A row with ``limit_seconds`` starts its key, one without ends it; of several starts or ends the earliest counts.
    Keys are dealt to ``groups`` whose state is read as one; a group is held in memory. With 0 every key has a state of its own, which
    costs calls for every key. The number stays as long as a checkpoint does.
    """
    kind = stream.schema[key].dataType
    limit = (F.col(limit_seconds) * 1_000_000).cast("long").alias("limit_us")
    timed = stream.where(F.col(ts).isNotNull()).select(F.col(key).alias("key"), F.col(ts).cast("timestamp").alias("ts"), limit).withWatermark("ts", delay)
    us, told = F.unix_micros("ts"), f"key {kind.simpleString()}, deadline_us long"
    if groups:
        group = F.when(F.col("key").isNull(), -1).otherwise(F.pmod(F.xxhash64("key"), F.lit(groups)).cast("int")).alias("group")
        # a whole number without nulls stays one on its way
        named = F.coalesce("key", F.lit(0).cast(kind)).alias("key") if isinstance(kind, T.IntegralType) else F.col("key")
        starts = F.col("limit_us").isNotNull()
        rows = timed.select(group, named, "ts", F.when(starts, us + F.col("limit_us")).otherwise(_NONE).alias("limit"), F.when(starts, _NONE).otherwise(us).alias("ended"))
        found = rows.groupBy("group").transformWithStateInPandas(_Deadlines(), told, "Append", "EventTime")
    else:
        found = timed.withColumn("us", us).groupBy("key").transformWithState(_Deadline(), told, "Append", "EventTime")
    return found.select(F.col("key").alias(key), F.timestamp_micros("deadline_us").alias("deadline"))
