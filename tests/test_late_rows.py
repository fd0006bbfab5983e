"""Usage kept by a stream: late rows, failures between its two tables, and repairs."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallymill.operators import usage as u
from tallymill.sources import ledger
from tallymill.streaming import late

SCHEMA = "id long, tenant_id long, role string, model_used string, input_tokens long, output_tokens long, total_tokens long, created_at string"


@pytest.fixture
def messages(spark):
    def make(rows):
        full = [(k, t, "assistant", m, n, 0, n, at) for k, t, m, n, at in rows]
        return spark.createDataFrame(full, SCHEMA).withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))

    return make


ONE = [(1, 1, "m", 10, "2024-01-01 10:00:00"), (2, 1, "m", 20, "2024-01-05 10:00:00")]
TWO = [(3, 1, "m", 1, "2024-01-01 11:00:00"), (4, 1, "m", 2, "2024-01-03 10:00:00"), (5, 2, "m", 3, "2024-01-06 00:00:00"), (6, 1, None, 3, "2024-01-02 00:00:00"), (7, 1, "m", None, None), (8, 1, "m", 4, "2024-01-03 09:59:59")]


def rows(df):
    return sorted(tuple(map(str, r)) for r in df.select(*u.KEY, *u.TOKENS).collect())


@pytest.mark.parametrize("dies", [None, "side table", "live table"])
def test_late_rows_and_repair(spark, tmp_path, messages, monkeypatch, dies):
    live, aside = f"{tmp_path}/live", f"{tmp_path}/late"
    add = late.keep(live, aside)
    add(messages(ONE), 0)
    if dies:  # the batch's first write is done, or its second one, when it dies
        inner, n = ledger.write, [0]

        def lost(*args):
            done = inner(*args)
            n[0] += 1
            if n[0] == (1 if dies == "side table" else 2):
                raise RuntimeError("lost")
            return done

        with monkeypatch.context() as m, pytest.raises(RuntimeError):
            m.setattr(ledger, "write", lost)
            add(messages(TWO), 1)
    add(messages(TWO), 1)
    add(messages(TWO), 1)
    # older than 2024-01-03 10:00 is late, that very time is not
    assert late.late_days(spark, aside) == ["2024-01-01", "2024-01-02", "2024-01-03"]
    assert sorted(r["id"] for r in ledger.read(spark, aside).collect()) == [3, 6, 8]
    every = messages(ONE + TWO)
    assert late.repair(spark, every, live, aside) == ["2024-01-01", "2024-01-02", "2024-01-03"]
    assert rows(late.usage(spark, live)) == rows(u.daily_usage(every))
    assert late.repair(spark, every, live, aside) == [] and late.late_days(spark, aside) == []


def test_first_batches_without_rows(spark, tmp_path, messages):
    live, aside = f"{tmp_path}/live", f"{tmp_path}/late"
    add = late.keep(live, aside)
    add(messages([]), 0)
    add(messages(ONE), 1)
    assert late.late_days(spark, aside) == [] and rows(late.usage(spark, live)) == rows(u.daily_usage(messages(ONE)))
    assert [r[0] for r in late.usage(spark, live).select("usage_date").orderBy("usage_date").collect()] == [dt.date(2024, 1, 1), dt.date(2024, 1, 5)]
