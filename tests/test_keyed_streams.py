"""Keyed streams over several batches: what is forgotten, what late events do, and how the state shrinks."""

import pytest
from pyspark.sql import functions as F

from tallymill.streaming import keyed

SCHEMA = "event_id long, key string, status string, s long"
HOUR = 3600
#: Hours count from here: at the epoch itself, events are late before anything has come.
START = 400 * 24 * HOUR


@pytest.fixture
def feed(spark, tmp_path):
    """Runs an operator over batches of (event_id, key, status, hour); gives its updates and the rows of state after each batch."""

    def go(operator, *batches):
        own = keyed.streaming_session(spark)
        schema = None
        for k, rows in enumerate(batches):
            df = spark.createDataFrame([(e, key, status, START + int(h * HOUR)) for e, key, status, h in rows], SCHEMA).withColumn("ts", F.timestamp_seconds("s")).coalesce(1)
            schema = df.schema
            df.write.parquet(f"{tmp_path}/in/{k:03d}")
        seen = []

        def keep(batch, number):
            seen.extend((number, r.asDict()) for r in batch.collect())

        rows = own.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(f"{tmp_path}/in/*")
        query = operator(rows).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
        return [r for _, r in sorted(seen, key=lambda x: x[0])], [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]

    return go


def last(updates, key):
    return [u for u in updates if u["key"] == key][-1]


def test_a_silent_key_is_forgotten_and_its_state_goes(feed):
    updates, rows = feed(keyed.stage_map("key"), [(1, "a", "start", 0), (2, "a", "end", 1), (3, "b", "start", 1)], [(4, "b", "end", 20)], [(5, "b", "more", 40)], [(6, "b", "more", 60)], [(7, "b", "more", 61)])
    assert last(updates, "a") == {"key": "a", "stages": {}, "expired": True}
    assert last(updates, "b") == {"key": "b", "stages": {"end": 4, "more": 7, "start": 3}, "expired": False}
    assert min(rows[-2:]) < max(rows)


def test_events_after_silence_begin_anew(feed):
    # within one batch and over two; the late event 9 is from before the last silence
    updates, _ = feed(keyed.stage_map("key"), [(1, "a", "x", 0), (2, "a", "y", 24), (3, "b", "x", 0)], [(4, "b", "y", 23.9), (5, "a", "z", 30)], [(9, "a", "x", 1), (8, "a", "y", 23.5)])
    assert last(updates, "a")["stages"] == {"y": 2, "z": 5}
    assert last(updates, "b")["stages"] == {"x": 3, "y": 4}


def test_older_events_do_not_replace_newer_ones(feed):
    updates, _ = feed(keyed.stage_map("key", None), [(5, "a", "x", 10)], [(9, "a", "x", 9), (4, "a", "x", 10), (6, "a", "y", 2)])
    assert last(updates, "a")["stages"] == {"x": 5, "y": 6}


def test_last_errors(feed):
    events = [[(10 * b + k, "a", "error" if k % 2 else "ok", b * 3 + k / 10) for k in range(10)] for b in range(4)]
    updates, _ = feed(keyed.last_errors("key", "error", 10), *events)
    assert last(updates, "a")["events"] == [39, 37, 35, 33, 31, 29, 27, 25, 23, 21]


def test_errors_are_forgotten(feed):
    updates, rows = feed(keyed.last_errors("key", "error"), [(1, "a", "error", 0)], [(2, "b", "error", 60)], [(3, "b", "error", 61)])
    assert last(updates, "a") == {"key": "a", "events": [], "expired": True} and last(updates, "b")["events"] == [3, 2]
    assert rows[-1] < sum((1, 1)) * max(rows)


def test_active_jobs(feed):
    operator = keyed.active("key", "start", "end", None, "2 hours")
    updates, rows = feed(operator, [(1, "a", "start", 0), (2, "b", "start", 0)], [(3, "a", "end", 1), (4, "a", "start", 0.5)], [(5, "b", "note", 9), (6, "c", "start", 10)], [(7, "c", "start", 11)])
    assert last(updates, "a")["expired"] and last(updates, "b")["started_us"] == START * 1_000_000 and last(updates, "c")["started_us"] == (START + 11 * HOUR) * 1_000_000


def test_rate_limit_over_batches(feed):
    at = [0, 30, 60, 89, 95, 149, 160, 400]
    calls = [(k, "a", "call", s / HOUR) for k, s in enumerate(at)]
    updates, _ = feed(keyed.rate_limit("key", 2, 60, "1 minute"), calls[:3], calls[3:4], calls[4:7], calls[7:])
    assert sum(u["allowed"] for u in updates) == 5 and sum(u["refused"] for u in updates) == 3


def test_nulls_are_left_out(feed):
    updates, _ = feed(keyed.stage_map("key"), [(1, None, "x", 0), (None, "a", "x", 0), (2, "a", None, 0), (3, "a", "y", 1)])
    assert [u["key"] for u in updates] == ["a"] and last(updates, "a")["stages"] == {"y": 3}


def test_the_callers_session_keeps_its_settings(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    own = keyed.streaming_session(spark)
    assert "RocksDB" in own.conf.get("spark.sql.streaming.stateStore.providerClass") and spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before
    assert own.conf.get("spark.sql.shuffle.partitions") == spark.conf.get("spark.sql.shuffle.partitions")
