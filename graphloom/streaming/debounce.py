"""Debounce and batches of a stream of file events as keyed state with timers.

``debounce`` keeps the events of a path in a list until the path is quiet for ``gap``, and gives one row a burst then. In processing time the
gap runs from the arrival of the path's last event, as a watcher wants it. In event time bursts are cut by the events' own times once the
watermark is past their end, so a replay gives the same rows in whatever order events arrive before it; later ones are dropped by Spark.

``capped`` hands rows on in batches of at most ``most`` distinct paths a lane and micro-batch. What is over waits in the lane's state, in
the order of arrival, and goes first into the next micro-batch; a path that waits takes later bursts into its row. Nothing is lost, and
both states are empty when all is handed on: that is how ``pending`` tells when a stop has drained them.

State is in RocksDB below the query's checkpoint, so a restart goes on with what was waiting. A burst's events and a lane's paths are held
by one task each; more lanes divide a storm of changes.

Defined results: rows with a null path or time are left out; events of equal time count by their type's order; repeated events count each.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

RELEASED = "path string, started timestamp, released timestamp, n long, last_type string"
BATCHED = "lane int, path string, started timestamp, released timestamp, n long, last_type string"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextlib.contextmanager
def rocks(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB."""
    was = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, was) if was else spark.conf.unset(_PROVIDER)


def bursts(events: list[tuple[int, str]], gap: int) -> list[tuple[int, int, int, str]]:
    """(first, last, number, type of the last) of the runs of (time, type) in which neighbours are less than ``gap`` apart."""
    out: list[tuple[int, int, int, str]] = []
    for at, kind in sorted(events):
        if out and at - out[-1][1] < gap:
            out[-1] = (out[-1][0], at, out[-1][2] + 1, kind)
        else:
            out.append((at, at, 1, kind))
    return out


def _rows(path: str, found: list[tuple[int, int, int, str]], gap: int) -> pd.DataFrame:
    first, last, n, kind = zip(*found, strict=True) if found else ((), (), (), ())
    time = lambda us: pd.to_datetime(pd.Series(us, dtype="int64"), unit="us")
    return pd.DataFrame({"path": [path] * len(n), "started": time(first), "released": time([x + gap for x in last]), "n": pd.Series(n, dtype="int64"), "last_type": pd.Series(kind, dtype="object")})


class _Debounce(StatefulProcessor):
    """Times in microseconds, timers in milliseconds."""

    def __init__(self, gap_us: int, event_time: bool) -> None:
        self.gap, self.event_time = gap_us, event_time

    def init(self, handle) -> None:
        self.handle = handle
        self.events = handle.getListState("events", "at long, event_type string")
        self.timer = handle.getValueState("timer", "at long")

    def _wake(self, at: int) -> None:
        held = self.timer.get() if self.timer.exists() else None
        if held and held[0] != at:
            self.handle.deleteTimer(held[0])
        if not held or held[0] != at:
            self.handle.registerTimer(at)
            self.timer.update((at,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = [(int(a), k) for frame in rows for a, k in zip(frame["at"], frame["event_type"], strict=True)]
        self.events.appendList(new)
        if self.event_time:
            held = [tuple(e) for e in self.events.get()]
            self._wake(min(b[1] for b in bursts(held, self.gap)) // 1000 + -(-self.gap // 1000))
        else:
            self._wake(timerValues.getCurrentProcessingTimeInMs() + -(-self.gap // 1000))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = [tuple(e) for e in self.events.get()]
        self.timer.clear()
        if not self.event_time:
            found, left = bursts(held, self.gap), []
            # quiet by arrival: one burst, whatever the events' own times
            found = [(found[0][0], found[-1][1], len(held), found[-1][3])]
        else:
            until = timerValues.getCurrentWatermarkInMs() * 1000
            runs = bursts(held, self.gap)
            found = [b for b in runs if b[1] + self.gap <= until]
            first = min((b[0] for b in runs if b[1] + self.gap > until), default=None)
            left = [e for e in held if first is not None and e[0] >= first]
        if left:
            self.events.put(left)
            self._wake(min(b[1] for b in bursts(left, self.gap)) // 1000 + -(-self.gap // 1000))
        else:
            self.events.clear()
        if found:
            yield _rows(key[0], found, self.gap)

    def close(self) -> None:
        """Nothing is held open."""


def debounce(events: DataFrame, gap_ms: int = 200, watermark: str | None = None) -> DataFrame:
    """(path, started, released, n, last_type) of a stream of (path, ts, event_type); with a ``watermark`` in event time."""
    known = events.where("path is not null and ts is not null").select("path", "ts", F.unix_micros("ts").alias("at"), F.coalesce("event_type", F.lit("")).alias("event_type"))
    source = known.withWatermark("ts", watermark) if watermark else known
    return source.groupBy("path").transformWithStateInPandas(_Debounce(gap_ms * 1000, bool(watermark)), RELEASED, "append", "EventTime" if watermark else "ProcessingTime")


class _Capped(StatefulProcessor):
    def __init__(self, most: int) -> None:
        self.most = most

    def init(self, handle) -> None:
        self.handle = handle
        self.queue = handle.getListState("queue", "path string, started timestamp, released timestamp, n long, last_type string")

    def _turn(self, held: list[tuple], now: int) -> tuple[list[tuple], bool]:
        """At most ``most`` rows to hand on; the others are kept, and a timer calls for them in the next micro-batch."""
        out, left = held[: self.most], held[self.most :]
        if left:
            self.queue.put(left)
            self.handle.registerTimer(now + 1)
        else:
            self.queue.clear()
        return out, bool(left)

    def _hand_on(self, key, new: list[tuple], now: int) -> Iterator[pd.DataFrame]:
        held: dict[str, tuple] = {}
        for row in [tuple(r) for r in self.queue.get()] + new:
            was = held.get(row[0])
            if was is None:
                held[row[0]] = row
            else:  # one row a path that waits
                last = row if row[2] >= was[2] else was
                held[row[0]] = (row[0], min(was[1], row[1]), last[2], was[3] + row[3], last[4])
        out, _ = self._turn(list(held.values()), now)
        if out:
            frame = pd.DataFrame(out, columns=["path", "started", "released", "n", "last_type"])
            frame.insert(0, "lane", key[0])
            yield frame

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for t in list(self.handle.listTimers()):  # this micro-batch has its turn here
            self.handle.deleteTimer(t)
        columns = ["path", "started", "released", "n", "last_type"]
        new = [(p, s.to_pydatetime(), r.to_pydatetime(), int(n), k) for frame in rows for p, s, r, n, k in frame[columns].itertuples(index=False)]
        yield from self._hand_on(key, new, timerValues.getCurrentProcessingTimeInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._hand_on(key, [], timerValues.getCurrentProcessingTimeInMs())

    def close(self) -> None:
        """Nothing is held open."""


def capped(released: DataFrame, most: int = 50, lanes: int = 1) -> DataFrame:
    """Released rows with their lane, at most ``most`` paths a lane and micro-batch."""
    dealt = released.withColumn("lane", F.pmod(F.xxhash64("path"), F.lit(lanes)).cast("int"))
    return dealt.groupBy("lane").transformWithStateInPandas(_Capped(most), BATCHED, "append", "ProcessingTime")


def pending(query: StreamingQuery) -> int:
    """Rows of state that wait for their time or turn, as of the last micro-batch."""
    held = query.lastProgress
    return sum(int(s["numRowsTotal"]) for s in held["stateOperators"]) if held else 0
