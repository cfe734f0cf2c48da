"""Keyed state in event time: limiter, history, result cache.

Decisions that depend on earlier ones need a key's events in order, but a stream brings them out of order and in batches of
any size. So events wait by key and slot of time, in a windowed aggregation; when the watermark passes a slot's end, it goes
to the key's fold, which takes all slots that a batch closes at once, sorts their stamps and goes on from the key's state. A
result therefore does not depend on how the stream was cut into batches. A key costs a few state calls a batch, however
many slots it has; a task holds the stamps that one batch closes for one key. What a key keeps besides is bounded (a
limiter's log by its limit, a history's last time), and a last timer drops it when it can no longer matter. Events whose
slot has closed are dropped, as everywhere in Structured Streaming; decisions on the last slots wait for the watermark.

State lies in RocksDB: run these jobs inside :func:`rocksdb`, or set the provider for the session.
"""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterator
from math import floor
from typing import Any

from pyspark.sql import Column, DataFrame, GroupedData, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from hanji import config
from hanji.operators.limits import sliding_log, spaced

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Seconds of a slot.
SLOT = 60
DECIDED = "key string, t array<double>, taken array<boolean>"
#: Decisions of a key that a row of the fold's output holds at most.
ROW = 10_000


@contextlib.contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams that start in here keep their state in RocksDB, which need not count its rows; the session's settings come back afterwards."""
    with config.during(spark, "spark.sql.streaming.stateStore.providerClass", ROCKSDB), config.during(spark, "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows", "false"):
        yield


class Slots(StatefulProcessor):
    """A fold over closed slots in order. ``keep`` says how long a state matters; without one the fold begins with ``new``."""

    new: Any = ()

    def __init__(self, step: Callable[[Any, float], tuple[Any, bool]], keep: float, slot: int):
        self.step, self.keep, self.slot = step, keep, slot

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.log = handle.getListState("log", "at double")

    def load(self) -> Any:
        return [r[0] for r in self.log.get()]

    def save(self, state: Any) -> None:
        self.log.put([(s,) for s in state])

    def last(self, state: Any) -> float | None:
        return state[-1] if state else None

    def keep_until_timer(self, state: Any, had: bool, watermark: float) -> None:
        """Save the state and drop it a second after the slot in which it matters for the last time, which may have passed."""
        at = None if self.last(state) is None else (floor((self.last(state) + self.keep) / self.slot) + 1) * self.slot + 1
        if at is not None and at * 1000 > watermark:
            self.save(state)
            self.handle.registerTimer(at * 1000)
        elif had:
            self.log.clear()

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        stamps = sorted(t for row in rows for t in row["stamps"])
        had, taken = self.log.exists(), []
        state = self.load() if had else self.new
        for t in stamps:
            state, ok = self.step(state, t)
            taken.append(ok)
        self.keep_until_timer(state, had, timerValues.getCurrentWatermarkInMs())
        for i in range(0, len(stamps), ROW):
            yield Row(key=key[0], t=stamps[i : i + ROW], taken=taken[i : i + ROW])

    def handleExpiredTimer(self, key: Any, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        if self.log.exists() and self.last(self.load()) + self.keep < expiredTimerInfo.getExpiryTimeInMs() // 1000:
            self.log.clear()
        return iter(())


class Log(Slots):
    """State is a log of accepted stamps, which may begin with those of an earlier run."""

    def handleInitialState(self, key: Any, initialState: Row, timerValues: TimerValues) -> None:
        self.keep_until_timer(initialState["stamps"], False, timerValues.getCurrentWatermarkInMs())


class Last(Slots):
    """State is the time of the last event that was taken."""

    new = None

    def load(self) -> float:
        return next(r[0] for r in self.log.get())

    def save(self, state: float) -> None:
        self.log.put([(state,)])

    def last(self, state: float | None) -> float | None:
        return state


def _decided(rows: DataFrame, key: Column, at: str, lateness: str, processor: Slots, initial: GroupedData | None = None) -> DataFrame:
    named = rows.select(key.cast("string").alias("key"), F.col(at).cast("timestamp").alias("at")).filter("key IS NOT NULL AND at IS NOT NULL").withWatermark("at", lateness)
    slots = named.groupBy("key", F.window("at", f"{processor.slot} seconds")).agg(F.collect_list(F.col("at").cast("double")).alias("stamps"))
    closed = slots.select("key", F.window_time("window").alias("closed"), "stamps")
    decided = closed.groupBy("key").transformWithState(processor, DECIDED, "append", "EventTime", initial)
    return decided.selectExpr("key", "inline(arrays_zip(t, taken))").select("key", F.timestamp_micros(F.round(F.col("t") * 1e6).cast("long")).alias("at"), "taken")


def limiter(requests: DataFrame, *, key: str, at: str, limit: int, seconds: int, lateness: str = "1 minute", slot: int = SLOT, accepted: DataFrame | None = None) -> DataFrame:
    """(key, at, taken) of each request under a sliding log of accepted ones.

    ``accepted`` (key, at) are requests that were accepted before the stream began.
    """
    initial = None
    if accepted is not None:
        stamps = F.sort_array(F.collect_list(F.col("at").cast("timestamp").cast("double"))).alias("stamps")
        initial = accepted.groupBy(F.col("key").cast("string").alias("key")).agg(stamps).groupBy("key")
    return _decided(requests, F.col(key), at, lateness, Log(sliding_log(limit, seconds), seconds, slot), initial)


def history(searches: DataFrame, *, query: str, at: str, seconds: int = 300, lateness: str = "1 minute", slot: int = SLOT) -> DataFrame:
    """(key, at, taken): whether a search is stored, which it is not within five minutes of the same query's last stored one."""
    asked = F.trim(F.col(query))
    return _decided(searches.filter(F.length(asked) >= 2), asked, at, lateness, Last(spaced(seconds), seconds, slot))


def cache_step(ttl: float, factor: float = 2.0) -> Callable[[list[float], float], tuple[list[float], bool]]:
    """A cache's step for one key; its state is the time of the entry and how often it was used.

    A use finds the entry if it is younger than its life, which grows by a tenth of ``ttl`` with each use after the first,
    up to ``factor`` times; else it is made anew. ``taken`` means that the entry was found.
    """

    def step(state: list[float], t: float) -> tuple[list[float], bool]:
        if state and t - state[0] <= ttl * min(factor, 1 + 0.1 * max(0, state[1] - 1)):
            return [state[0], state[1] + 1], True
        return [t, 0.0], False

    return step


class Entry(Slots):
    """State is an entry's time and how often it was used."""

    def last(self, state: list[float]) -> float | None:
        return state[0] if state else None


def cached(uses: DataFrame, *, key: str, at: str, ttl: float, factor: float = 2.0, lateness: str = "1 minute", slot: int = SLOT) -> DataFrame:
    """(key, at, taken): which uses of a key find its result in the cache."""
    return _decided(uses, F.col(key), at, lateness, Entry(cache_step(ttl, factor), ttl * factor, slot))
