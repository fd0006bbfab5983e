"""Keyed state over a stream: last status with expiry, and sums merged into a table."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymill.operators.usage import increment
from tallymill.sources import ledger

DAY_MS = 86_400_000


def _micros(ts: pd.Series) -> pd.Series:
    return ts.astype("datetime64[us]").astype("int64")


def latest_status(key: str, ttl_ms: int = DAY_MS, late: str = "1 day") -> Callable[[DataFrame], DataFrame]:
    """Each key's last status by (ts, event_id); a key that is silent for ``ttl_ms`` of event time is forgotten and reported as expired."""

    def step(name: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            status, at, _, n = state.get
            state.remove()
            yield pd.DataFrame({key: [name[0]], "status": [status], "updated_us": [at], "n_events": [n], "expired": [True]})
            return
        best = state.get if state.exists else ("", -1, -1, 0)
        for f in frames:
            last = f.assign(t=_micros(f["ts"])).sort_values(["t", "event_id"]).iloc[-1]
            n = best[3] + len(f)
            best = (last["status"], int(last["t"]), int(last["event_id"]), n) if (last["t"], last["event_id"]) > best[1:3] else (*best[:3], n)
        state.update(best)
        state.setTimeoutTimestamp(max(best[1] // 1000 + ttl_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({key: [name[0]], "status": [best[0]], "updated_us": [best[1]], "n_events": [best[3]], "expired": [False]})

    def apply(rows: DataFrame) -> DataFrame:
        kind = rows.schema[key].dataType.simpleString()
        out = f"{key} {kind}, status string, updated_us long, n_events long, expired boolean"
        held = rows.select(key, "status", "ts", "event_id").withWatermark("ts", late).groupBy(key)
        return held.applyInPandasWithState(step, out, "status string, t long, event_id long, n long", "update", "EventTimeTimeout")

    return apply


def add_to_table(path: str, keys: list[str], measures: list[str], by: str, writer: str = "live") -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: adds a batch's sums to a table of ``ledger``.

    The sums and the batch's number commit at once, so a batch that is delivered again, after whatever failure, counts once.
    """

    def write(batch: DataFrame, number: int) -> None:
        sums = batch.groupBy(*keys).agg(*(F.sum(m).cast("long").alias(m) for m in measures))
        ledger.write(batch.sparkSession, path, sums, by, lambda old, new: increment(old, new, keys, measures), writer, number)

    return write
