"""Accept-dependent state over ordered events, as folds per key: limiter, history dedupe; a cache and a queue on the driver.

A key's events are folded in time order, which is sequential by nature; keys spread over tasks. Events come to the fold
sorted, a batch at a time, and only the current key's state is held: a limiter's accepted stamps, of which there are
at most as many as its limit, or the time a query was last stored. So a key may have any number of events.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def folded(events: DataFrame, key: Column, at: Column, new: Callable[[], Any], step: Callable[[Any, float], tuple[Any, bool]], extra: list[str] = ()) -> DataFrame:
    """(key, t, taken, extra ...): whether ``step`` takes each event, given its key's state and its time in seconds.

    Ties in time go by ``extra``. Rows without key or time are left out.
    """
    rows = events.select(key.cast("string").alias("key"), at.cast("timestamp").cast("double").alias("t"), *extra).filter("key IS NOT NULL AND t IS NOT NULL")
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, None
        for batch in batches:
            taken = []
            for k, t in zip(batch["key"], batch["t"], strict=True):
                if k != current:
                    current, state = k, new()
                state, ok = step(state, t)
                taken.append(ok)
            yield batch.assign(taken=taken)

    return rows.repartition("key").sortWithinPartitions("key", "t", *extra).mapInPandas(work, f"{fields}, taken boolean")


def sliding_log(limit: int, seconds: float) -> Callable[[list[float], float], tuple[list[float], bool]]:
    """A limiter's step: stamps older than the window go, and only accepted ones are logged."""

    def step(log: list[float], t: float) -> tuple[list[float], bool]:
        log = [s for s in log if s > t - seconds]
        if len(log) >= limit:
            return log, False
        return [*log, t], True

    return step


def spaced(seconds: float) -> Callable[[float | None, float], tuple[float | None, bool]]:
    """A history's step: an event is stored if the last stored one is at least so long ago."""

    def step(last: float | None, t: float) -> tuple[float | None, bool]:
        return (t, True) if last is None or t - last >= seconds else (last, False)

    return step


def decisions(events: DataFrame, *, key: str, at: str, limit: int, seconds: int, extra: list[str] = ()) -> DataFrame:
    """(key, t, taken, extra ...): each event under a sliding log of accepted ones."""
    return folded(events, F.col(key), F.col(at), list, sliding_log(limit, seconds), extra)


def rate_limited(events: DataFrame, *, key: str, at: str, limit: int, seconds: int) -> DataFrame:
    """(key, allowed, blocked) under a sliding log."""
    decided = decisions(events, key=key, at=at, limit=limit, seconds=seconds)
    return decided.groupBy("key").agg(F.count_if("taken").alias("allowed"), F.count_if(~F.col("taken")).alias("blocked"))


def stored_history(events: DataFrame, *, query: str, at: str, seconds: int = 300) -> DataFrame:
    """(query, stored): how often a query is stored when it is skipped within five minutes of its last stored time."""
    asked = events.withColumn("_q", F.trim(F.col(query))).filter(F.length("_q") >= 2)
    decided = folded(asked, F.col("_q"), F.col(at), lambda: None, spaced(seconds))
    return decided.groupBy(F.col("key").alias("query")).agg(F.count_if("taken").alias("stored"))


class ResultCache:
    """A driver-side cache of results: least recently used goes first; an entry lives longer the more often it is hit."""

    def __init__(self, size: int = 1000, ttl: float = 600.0, factor: float = 2.0, clock=None):
        import time
        from collections import OrderedDict

        self.size, self.ttl, self.factor, self.clock = size, ttl, factor, clock or time.monotonic
        self.entries: OrderedDict = OrderedDict()
        self.hits = self.misses = self.evictions = 0

    def _life(self, uses: int) -> float:
        return self.ttl * min(self.factor, 1 + 0.1 * max(0, uses - 1))

    def get(self, key):
        entry = self.entries.get(key)
        if entry is None:
            self.misses += 1
            return None
        value, stored, uses = entry
        if self.clock() - stored > self._life(uses):
            del self.entries[key]
            self.misses += 1
            self.evictions += 1
            return None
        self.entries[key] = (value, stored, uses + 1)
        self.entries.move_to_end(key)
        self.hits += 1
        return value

    def put(self, key, value) -> None:
        uses = self.entries.pop(key, (None, 0, 0))[2]
        while len(self.entries) >= self.size:
            self.entries.popitem(last=False)
            self.evictions += 1
        self.entries[key] = (value, self.clock(), uses)

    def invalidate(self, source: str) -> int:
        """Forget results in which a source occurs."""
        stale = [k for k, (v, _, _) in self.entries.items() if any(r.get("source") == source for r in v)]
        for k in stale:
            del self.entries[k]
        return len(stale)

    def clear(self) -> None:
        self.entries.clear()

    def stats(self) -> dict:
        total = self.hits + self.misses
        return {"size": len(self.entries), "hits": self.hits, "misses": self.misses, "hit_rate": round(100 * self.hits / total, 2) if total else 0.0}


class SearchQueue:
    """At most so many searches at once; a caller waits up to a time and is then rejected."""

    def __init__(self, most: int = 10):
        import threading

        self.slots, self.lock = threading.Semaphore(most), threading.Lock()
        self.active = self.processed = self.rejected = 0

    def acquire(self, timeout: float) -> bool:
        got = self.slots.acquire(timeout=timeout)
        with self.lock:
            self.active += got
            self.rejected += not got
        return got

    def release(self) -> None:
        with self.lock:
            self.active -= 1
            self.processed += 1
        self.slots.release()

    def stats(self) -> dict:
        return {"active": self.active, "processed": self.processed, "rejected": self.rejected}
