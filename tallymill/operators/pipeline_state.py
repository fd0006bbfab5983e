"""State of documents in the processing pipeline, from their events."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TTL_SECONDS = 86_400


def latest_status(events: DataFrame, key: str, at: str | None = None) -> DataFrame:
    """The last event of each key; with ``at``, keys silent for a day before it are gone."""
    last = events.groupBy(key).agg(F.max_by(F.struct("status", "ts", "event_id"), F.struct("ts", "event_id")).alias("e"), F.count(F.lit(1)).alias("n_events"))
    out = last.select(key, F.col("e.status").alias("status"), F.col("e.ts").alias("updated_at"), "n_events")
    return out if at is None else out.where(F.col("updated_at") > F.lit(at).cast("timestamp_ntz") - F.expr(f"INTERVAL '{TTL_SECONDS}' SECOND"))


def stage_map(events: DataFrame, key: str) -> DataFrame:
    """The first event's time of each stage of a key, and how often the stage ran."""
    return events.groupBy(key, F.col("status").alias("stage")).agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("first_event"), F.min("ts").alias("started_at"), F.max("ts").alias("last_at"), F.count(F.lit(1)).alias("runs"))


def stage_list(events: DataFrame, stages: list[str], keys: DataFrame, key: str) -> DataFrame:
    """Every stage of every key in order, with the time of its first event; null where it has not begun."""
    first = events.groupBy(key, F.col("status").alias("stage")).agg(F.min("ts").alias("started_at"))
    every = keys.select(key, F.posexplode(F.array(*map(F.lit, stages))).alias("position", "stage"))
    return every.join(first, [key, "stage"], "left")


def overlay(rows: DataFrame, live: DataFrame, key: str, default: str) -> DataFrame:
    """Stored status under the live one, under a default."""
    over = live.select(key, F.struct(F.col("status").alias("live")).alias("over"))
    joined = rows.select(key, F.struct("*").alias("row")).join(over, key, "left")
    status = F.coalesce("over.live", "row.status", F.lit(default)).alias("status")
    return joined.select(*(status if c == "status" else F.col(f"row.`{c}`").alias(c) for c in rows.columns))


def last_errors(events: DataFrame, key: str, error: str, n: int = 10) -> DataFrame:
    """The last n error events of each key, newest first."""
    w = Window.partitionBy(key).orderBy(F.desc("ts"), F.desc("event_id"))
    return events.where(F.col("status") == error).withColumn("position", F.row_number().over(w)).where(F.col("position") <= n)


def active(events: DataFrame, key: str, begin: str, end: str) -> DataFrame:
    """Keys whose last begin has no end after it, oldest first."""
    at = lambda s: F.max(F.when(F.col("status") == s, F.struct("ts", "event_id")))
    both = events.groupBy(key).agg(at(begin).alias("b"), at(end).alias("e"))
    return both.where("b is not null and (e is null or e < b)").select(key, F.col("b.ts").alias("started_at")).orderBy("started_at", key)


def stage_records(updates: DataFrame, keys: list[str]) -> DataFrame:
    """The record of each stage after its updates (keys, seq, status, ts, error_message, input_size, output_size), in the order of seq.

    in_progress sets started_at; completed and failed set completed_at and, once it has started, the seconds since then.
    Messages that are not empty and sizes that are not null stay until later ones come. A later run does not clear the
    end of the one before. Updates of equal seq are taken in the order of their time.
    """
    order = Window.partitionBy(*keys).orderBy("seq", "ts")
    begun = F.last(F.when(F.col("status") == "in_progress", F.col("ts")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = updates.withColumns({"begun": begun, "place": F.row_number().over(order)})
    ended = F.col("status").isin("completed", "failed")
    seconds = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("begun").cast("timestamp"))) / 1_000_000
    last = lambda value, when: F.max_by(value, F.when(when, F.col("place")))
    there = lambda c: F.col(c).isNotNull()
    return rows.groupBy(*keys).agg(
        last(F.col("status"), F.lit(True)).alias("status"), last(F.col("ts"), F.col("status") == "in_progress").alias("started_at"), last(F.col("ts"), ended).alias("completed_at"),
        last(seconds, ended & there("begun")).alias("duration_seconds"), last(F.col("error_message"), there("error_message") & (F.col("error_message") != "")).alias("error_message"),
        last(F.col("input_size"), there("input_size")).alias("input_size"), last(F.col("output_size"), there("output_size")).alias("output_size"),
    )


def durations(events: DataFrame, key: str) -> DataFrame:
    """Seconds from each event of a key to its next one."""
    w = Window.partitionBy(key).orderBy("ts", "event_id")
    return events.withColumn("seconds", F.timestamp_diff("SECOND", F.col("ts"), F.lead("ts").over(w)))


def sessions(events: DataFrame, key: str, gap_seconds: int) -> DataFrame:
    """Runs of a key's events with at most the gap between them."""
    w = Window.partitionBy(key).orderBy("ts", "event_id")
    new = F.coalesce((F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(w).cast("timestamp")) >= gap_seconds * 1_000_000).cast("int"), F.lit(1))
    numbered = events.withColumn("_new", new).withColumn("session", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(key, "session").agg(F.min("ts").alias("first_at"), F.max("ts").alias("last_at"), F.count(F.lit(1)).alias("n_events"))


def rate_limited(calls: DataFrame, key: str, most: int, window_seconds: int) -> DataFrame:
    """Whether each call is allowed: a counter that allows ``most``, and forgets ``window_seconds`` after the last allowed call.

    Whether a call is allowed depends on the one before it, so the calls of one key are
    folded in order of time by one task, as they stream through a sorted partition;
    only the counter is held. A key is one caller, and its calls are what it can send.
    """
    window = window_seconds * 1_000_000

    def run(batches):
        now, n, last = None, 0, 0
        for batch in batches:
            allowed = []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if k != now or t - last >= window:
                    now, n = k, 0
                allowed.append(n < most)
                if n < most:
                    n, last = n + 1, t
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(allowed, pa.bool_())], [key, "event_id", "allowed"])

    rows = calls.select(key, "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t")).repartition(key).sortWithinPartitions(key, "t", "event_id")
    kind = calls.schema[key].dataType.simpleString()
    return rows.mapInArrow(run, f"{key} {kind}, event_id long, allowed boolean")
