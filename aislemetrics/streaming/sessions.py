"""User sessions with a greatest length, by own state and timers.

Built-in session windows have no greatest length, and cannot be asked for what is still open. Users are
dealt over a fixed number of slots, and a slot is the key of the state: its users are handled together with
arrays, so that a batch costs a few calls of the state store per slot instead of several per user. The events
of a slot wait until the watermark has passed them, so that they are taken in order however they arrive. A
timer per slot wakes it when the first gap has passed, and what has ended leaves the state then.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SLOTS = 1024  # stays the same for the life of a stream's state
_WAITING = "user_id array<long>, at array<long>, value array<double>"  # one element for what a batch brings
_OPEN = "user_id array<long>, start array<long>, last array<long>, n array<long>, total array<double>"
_OUT = "user_id long, session_start timestamp, session_end timestamp, n long, total double"


def with_state_store(spark: SparkSession) -> None:
    """Own state needs the state store that keeps its data outside the JVM heap."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def _stacked(rows: list[tuple], kinds: tuple) -> list[np.ndarray]:
    """The arrays of several state elements, column by column."""
    return [np.concatenate([np.asarray(row[i], kind) for row in rows] or [np.empty(0, kind)]) for i, kind in enumerate(kinds)]


def folded(user, start, last, n, total, gap: int, longest: int):
    """Sessions of rows ordered by user and time; an open session is its user's first row, an event has ``start`` = ``last``.

    Returns user, start, last, n, total per session in the same order.
    """
    if not len(user):
        return user, start, last, n, total
    new = np.ones(len(user), bool)
    new[1:] = (user[1:] != user[:-1]) | (last[1:] >= last[:-1] + gap)
    first = np.flatnonzero(new)
    end = np.append(first[1:], len(user))
    long = last[end - 1] >= start[first] + longest
    cuts = []
    for i, stop in zip(first[long].tolist(), end[long].tolist()):
        while (i := i + 1 + int(np.searchsorted(last[i + 1 : stop], start[i] + longest))) < stop:
            cuts.append(i)
    first = np.sort(np.concatenate([first, np.array(cuts, first.dtype)]))
    end = np.append(first[1:], len(user))
    return user[first], start[first], last[end - 1], np.add.reduceat(n, first), np.add.reduceat(total, first)


class Sessions(StatefulProcessor):
    """Times are microseconds since 1970. ``gap`` and ``longest`` are too."""

    def __init__(self, gap: int, longest: int):
        self.gap, self.longest = gap, longest

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", _WAITING)
        self.open = handle.getValueState("open", _OPEN)

    def _timer(self, at: int) -> None:
        """One timer for the slot, at the first millisecond by which ``at`` is over."""
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(-(-at // 1000))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        parts = []
        for batch in rows:
            known = batch["known"].to_numpy(bool)
            value = np.nan_to_num(batch["value"].to_numpy(float, na_value=np.nan), nan=0.0, posinf=np.inf, neginf=-np.inf)
            parts.append((batch["user"].to_numpy("int64")[known], batch["at"].to_numpy("int64")[known], value[known]))
        user, at, value = _stacked(parts, ("int64", "int64", "float64"))
        if not len(user):
            return iter([])
        self.waiting.appendValue((user.tolist(), at.tolist(), value.tolist()))
        first = int(at.min()) + self.gap
        timers = list(self.handle.listTimers())
        if not timers or -(-first // 1000) < min(timers):
            self._timer(first)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        user, at, value = _stacked(list(self.waiting.get()), ("int64", "int64", "float64"))
        begun = [tuple(self.open.get())] if self.open.exists() else []
        open_user, start, last, n, total = _stacked(begun, ("int64",) * 4 + ("float64",))
        ready = at <= mark
        rest = user[~ready], at[~ready], value[~ready]
        user, at, value = user[ready], at[ready], value[ready]
        event = np.repeat([0, 1], [len(open_user), len(user)])
        rows = [np.concatenate(x) for x in ((open_user, user), (start, at), (last, at), (n, np.ones_like(at)), (total, value))]
        order = np.lexsort((rows[4], rows[2], event, rows[0]))
        user, start, last, n, total = folded(*[x[order] for x in rows], self.gap, self.longest)
        newest = np.ones(len(user), bool)
        newest[:-1] = user[1:] != user[:-1]
        stays = newest & (last + self.gap > mark)
        self.waiting.clear()
        if len(rest[0]):
            self.waiting.put([tuple(x.tolist() for x in rest)])
        if stays.any():
            self.open.update(tuple(x[stays].tolist() for x in (user, start, last, n, total)))
        else:
            self.open.clear()
        nexts = np.concatenate([last[stays], rest[1]])
        if len(nexts):
            self._timer(int(nexts.min()) + self.gap)
        if not stays.all():
            user, start, last, n, total = (x[~stays] for x in (user, start, last, n, total))
            yield pd.DataFrame({
                "user_id": user, "session_start": pd.to_datetime(start, unit="us"),
                "session_end": pd.to_datetime(last, unit="us"), "n": n, "total": total,
            })

    def close(self) -> None:
        pass


def bounded_sessions(
    events: DataFrame, gap_minutes: int = 30, longest_minutes: int = 120, late: str = "10 minutes", slots: int = SLOTS
) -> DataFrame:
    """user_id, session_start, session_end (its last event), n, total of every session that has ended.

    A session ends after ``gap_minutes`` without an event, and goes on in a new one at the first event
    that is ``longest_minutes`` or more after its start. Rows without a user are left out.
    """
    # rows without a user are passed over in the processor: a filter would be moved below the watermark
    user = F.col("user_id").cast("long")
    rows = events.withWatermark("ts", late).select(
        F.pmod(F.xxhash64(user), F.lit(slots)).alias("slot"), "ts", F.coalesce(user, F.lit(0)).alias("user"), user.isNotNull().alias("known"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.col("value").cast("double").alias("value"),
    )
    return rows.groupBy("slot").transformWithStateInPandas(
        statefulProcessor=Sessions(gap_minutes * 60_000_000, longest_minutes * 60_000_000),
        outputStructType=_OUT, outputMode="append", timeMode="EventTime",
    )


def open_sessions(spark: SparkSession, state: str) -> DataFrame:
    """Users with a session that has not ended, read from the checkpoint of a stream of :func:`bounded_sessions`.

    user_id, session_start, last_event, n, total; events that the watermark has not passed are counted in.
    """

    def variable(name: str) -> DataFrame:
        return spark.read.format("statestore").option("stateVarName", name).load(state)

    begun = variable("open").select("value.*").select(F.inline(F.arrays_zip("user_id", "start", "last", "n", "total")))
    waiting = variable("waiting").select("list_element.*").select(F.inline(F.arrays_zip("user_id", "at", "value"))).select(
        "user_id", F.col("at").alias("start"), F.col("at").alias("last"), F.lit(1).cast("long").alias("n"), F.col("value").alias("total")
    )
    return begun.unionByName(waiting).groupBy("user_id").agg(
        F.timestamp_micros(F.min("start")).alias("session_start"), F.timestamp_micros(F.max("last")).alias("last_event"),
        F.sum("n").alias("n"), F.sum("total").alias("total"),
    )
