"""Keyed state that is forgotten: stage maps, active jobs, last errors and rate limits of a stream of events.

Each operator keeps typed state (value, list, map) by key with an event-time timer. A key that
is silent for ``ttl_ms`` is forgotten, as a store with expiring keys forgets it: its state goes
when the watermark passes, and an event that comes after such a silence begins anew, in
whatever batch it comes. With ``ttl_ms=None`` nothing is forgotten.

Events are folded in the order of (ts, event_id) within a batch. Across batches a late one counts
as far as it can: an older event never replaces a newer one, and one from before the last
silence is left out. Rows with a null key, time or number are left out.

State is in the RocksDB store, in the query's checkpoint, so that it survives lost executors:
``streaming_session`` gives a session with that setting, without touching the caller's.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

DAY_MS = 86_400_000
LATE = "1 day"


def streaming_session(spark: SparkSession) -> SparkSession:
    """A session with the caller's settings whose streams keep state in RocksDB."""
    own = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if spark.conf.isModifiable(key):
            own.conf.set(key, value)
    own.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return own


NEVER = -(1 << 62)


def _ordered(frames: Iterator[pd.DataFrame], since: int) -> pd.DataFrame:
    """A batch's events of a key that still count, in order, with their times in microseconds."""
    rows = pd.concat(list(frames))
    rows = rows.assign(at=rows["ts"].astype("datetime64[us]").astype("int64"))
    return rows[rows["at"] >= since].sort_values(["at", "event_id"])


class Forgetful(StatefulProcessor):
    """Keeps the time of a key's last event, and one timer: the time at which the key is forgotten."""

    def __init__(self, key: str, ttl_ms: int | None):
        self.key, self.ttl_ms = key, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # the last event's time, and the time from which events count
        self.seen = handle.getValueState("seen", "last long, since long")

    def begin(self) -> tuple[int, int]:
        return self.seen.get() if self.seen.exists() else (NEVER, NEVER)

    def after_silence(self, rows: pd.DataFrame, last: int, since: int) -> tuple[pd.DataFrame, int, int, bool]:
        """The events after a batch's last silence, the last time, the time from which events count, and whether there was a silence."""
        if not len(rows):
            return rows, last, since, False
        at = rows["at"].to_numpy()
        broken = np.zeros(len(at), bool)
        if self.ttl_ms is not None:
            before = np.maximum.accumulate(np.append(last, at[:-1]))
            broken = (before != NEVER) & (at - before >= self.ttl_ms * 1000)
        k = int(np.flatnonzero(broken)[-1]) if broken.any() else 0
        return rows.iloc[k:], max(last, int(at[-1])), int(at[k]) if broken.any() else since, bool(broken.any())

    def end(self, last: int, since: int) -> None:
        self.seen.update((last, since))
        if self.ttl_ms is not None:
            self.expire_at(last // 1000 + self.ttl_ms)

    def expire_at(self, ms: int) -> None:
        """One timer: the earlier ones of a key go."""
        timers = list(self.handle.listTimers())
        for t in timers:
            if t != ms:
                self.handle.deleteTimer(t)
        if ms not in timers:
            self.handle.registerTimer(ms)

    def forget(self) -> None:
        self.seen.clear()

    def gone(self, name) -> dict:
        raise NotImplementedError

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.forget()
        row = self.gone(key[0])
        if row:
            yield pd.DataFrame([row])

    def close(self) -> None:
        pass


class StageMap(Forgetful):
    """A map from each stage to its last event."""

    def init(self, handle):
        super().init(handle)
        self.stages = handle.getMapState("stages", "stage string", "at long, event long")

    def handleInputRows(self, key, rows, timerValues):
        last, since = self.begin()
        events, last, since, anew = self.after_silence(_ordered(rows, since), last, since)
        if anew:
            self.stages.clear()
        for r in events.drop_duplicates("status", keep="last").itertuples():
            new = (int(r.at), int(r.event_id))
            if not self.stages.containsKey((r.status,)) or tuple(self.stages.getValue((r.status,))) < new:
                self.stages.updateValue((r.status,), new)
        self.end(last, since)
        yield pd.DataFrame([{self.key: key[0], "stages": {s[0]: int(v[1]) for s, v in sorted(self.stages.iterator())}, "expired": False}])

    def forget(self):
        super().forget()
        self.stages.clear()

    def gone(self, name):
        return {self.key: name, "stages": {}, "expired": True}


class LastErrors(Forgetful):
    """The last events, newest first."""

    def __init__(self, key: str, most: int, ttl_ms: int | None):
        super().__init__(key, ttl_ms)
        self.most = most

    def init(self, handle):
        super().init(handle)
        self.events = handle.getListState("events", "at long, event long")

    def handleInputRows(self, key, rows, timerValues):
        last, since = self.begin()
        events, last, since, anew = self.after_silence(_ordered(rows, since), last, since)
        held = set() if anew else {tuple(x) for x in self.events.get()}
        newest = events.tail(self.most)
        held = sorted(held.union(zip(newest["at"].tolist(), newest["event_id"].tolist(), strict=True)), reverse=True)[: self.most]
        self.events.put(held)
        self.end(last, since)
        yield pd.DataFrame([{self.key: key[0], "events": [int(e) for _, e in held], "expired": False}])

    def forget(self):
        super().forget()
        self.events.clear()

    def gone(self, name):
        return {self.key: name, "events": [], "expired": True}


class ActiveJobs(Forgetful):
    """Since when a key is in work. One that has ended is kept for ``late_ms``, so that a late beginning does not open it again."""

    def __init__(self, key: str, begin: str, ttl_ms: int | None, late_ms: int):
        super().__init__(key, ttl_ms)
        self.first, self.late_ms = begin, late_ms

    def init(self, handle):
        super().init(handle)
        self.job = handle.getValueState("job", "began_at long, began long, ended_at long, ended long")

    def handleInputRows(self, key, rows, timerValues):
        last, since = self.begin()
        events, last, since, anew = self.after_silence(_ordered(rows, since), last, since)
        began, ended = (-1, -1), (-1, -1)
        if self.job.exists() and not anew:
            j = self.job.get()
            began, ended = (j[0], j[1]), (j[2], j[3])
        for r in events.drop_duplicates("status", keep="last").itertuples():
            new = (int(r.at), int(r.event_id))
            if r.status == self.first:
                began = max(began, new)
            else:
                ended = max(ended, new)
        self.job.update((*began, *ended))
        self.end(last, since)
        if began <= ended:
            self.expire_at(last // 1000 + self.late_ms)
        yield pd.DataFrame([{self.key: key[0], "started_us": began[0] if began > ended else -1, "expired": False}])

    def forget(self):
        super().forget()
        self.job.clear()

    def gone(self, name):
        return {self.key: name, "started_us": -1, "expired": True}


class RateLimit(Forgetful):
    """Calls let through and refused in a batch. The count lives from one call that is let through until ``window_ms`` without one."""

    def __init__(self, key: str, most: int, window_ms: int):
        super().__init__(key, window_ms)
        self.most = most

    def init(self, handle):
        super().init(handle)
        self.count = handle.getValueState("count", "n long")

    def handleInputRows(self, key, rows, timerValues):
        last, since = self.begin()
        n = self.count.get()[0] if self.count.exists() else 0
        allowed = refused = 0
        for at in _ordered(rows, since)["at"].tolist():  # each call depends on the one before
            if last != NEVER and at - last >= self.ttl_ms * 1000:
                n = 0
            if n < self.most:
                n, last, allowed = n + 1, max(last, at), allowed + 1
            else:
                refused += 1
        self.count.update((n,))
        self.end(last, since)
        yield pd.DataFrame([{self.key: key[0], "allowed": allowed, "refused": refused}])

    def forget(self):
        super().forget()
        self.count.clear()

    def gone(self, name):
        return {}


def _apply(rows: DataFrame, key: str, processor: StatefulProcessor, out: str, late: str) -> DataFrame:
    kind = rows.schema[key].dataType.simpleString()
    held = rows.where(F.col(key).isNotNull() & F.col("ts").isNotNull() & F.col("event_id").isNotNull()).withWatermark("ts", late)
    return held.groupBy(key).transformWithStateInPandas(processor, f"{key} {kind}, {out}", "update", "eventTime")


def stage_map(key: str, ttl_ms: int | None = DAY_MS, late: str = LATE) -> Callable[[DataFrame], DataFrame]:
    """Each key's stages (rows: key, status, ts, event_id) with the number of the last event of each."""
    return lambda rows: _apply(rows.select(key, "status", "ts", "event_id").where("status IS NOT NULL"), key, StageMap(key, ttl_ms), "stages map<string,bigint>, expired boolean", late)


def last_errors(key: str, error: str, most: int = 10, ttl_ms: int | None = DAY_MS, late: str = LATE) -> Callable[[DataFrame], DataFrame]:
    """Each key's last ``most`` events of status ``error``, newest first."""
    return lambda rows: _apply(rows.where(F.col("status") == error).select(key, "ts", "event_id"), key, LastErrors(key, most, ttl_ms), "events array<bigint>, expired boolean", late)


def active(key: str, begin: str, end: str, ttl_ms: int | None = DAY_MS, late: str = LATE) -> Callable[[DataFrame], DataFrame]:
    """Since when each key is in work: the time of its last ``begin`` if no ``end`` came after it, else -1."""

    def apply(rows: DataFrame) -> DataFrame:
        late_ms = int(pd.Timedelta(late).total_seconds() * 1000)
        wanted = rows.where(F.col("status").isin(begin, end)).select(key, "status", "ts", "event_id")
        return _apply(wanted, key, ActiveJobs(key, begin, ttl_ms, late_ms), "started_us long, expired boolean", late)

    return apply


def rate_limit(key: str, most: int, window_seconds: int, late: str = LATE) -> Callable[[DataFrame], DataFrame]:
    """Calls let through and refused, by key and batch: their sums are the totals so far."""
    return lambda rows: _apply(rows.select(key, "ts", "event_id"), key, RateLimit(key, most, window_seconds * 1000), "allowed long, refused long", late)
