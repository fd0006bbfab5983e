"""Bills kept by differences against the rollup of all days, with failures between the two tables."""

import datetime as dt
import random
from decimal import Decimal

import pytest

from tallymill.operators import maintained
from tallymill.operators import usage as u
from tallymill.sources import ledger

SCHEMA = "tenant_id long, model_name string, usage_date date, total_input_tokens long, total_output_tokens long, total_tokens long, message_count long, input_token_cost decimal(12,6), output_token_cost decimal(12,6), total_cost decimal(12,6)"


def days(spark, rng, dates, n):
    rows = {}
    for _ in range(n):
        i, o = rng.choice([0, rng.randrange(1, 9999)]), rng.randrange(0, 99)
        a, b = Decimal(rng.randrange(10**7)).scaleb(-6), Decimal(rng.randrange(10**7)).scaleb(-6)
        key = (rng.randrange(3), rng.choice(["m", "n"]), rng.choice(dates))
        rows[key] = (*key, i, o, i + o, 1, a, b, a + b)
    return spark.createDataFrame(list(rows.values()), SCHEMA)


def content(df, columns):
    return sorted(tuple(map(str, r)) for r in df.select(*columns).collect())


def check(spark, root):
    want = u.monthly_billing(ledger.read(spark, f"{root}/days"))
    assert content(maintained.bills(spark, root), want.columns) == content(want, want.columns)


def test_differences_equal_a_rebuild(spark, tmp_path):
    rng, root = random.Random(8), str(tmp_path)
    dates = [dt.date(2023, 12, 20) + dt.timedelta(days=k) for k in range(50)]
    for number in range(4):
        rows = days(spark, rng, dates[10 * number :] if number < 3 else dates, 40)
        maintained.apply(spark, root, rows, number)
        maintained.apply(spark, root, rows, number)
        check(spark, root)
    maintained.apply(spark, root, rows.limit(0), 4)
    check(spark, root)


@pytest.mark.parametrize("after", [1, 2])
def test_a_batch_that_dies_between_the_tables(spark, tmp_path, monkeypatch, after):
    rng, root = random.Random(9), str(tmp_path)
    dates = [dt.date(2024, 1, 25) + dt.timedelta(days=k) for k in range(12)]
    maintained.apply(spark, root, days(spark, rng, dates, 30), 0)
    rows, inner, n = days(spark, rng, dates, 30), ledger.write, [0]

    def lost(*args):
        done = inner(*args)
        n[0] += 1
        if n[0] == after:
            raise RuntimeError("lost")
        return done

    with monkeypatch.context() as m, pytest.raises(RuntimeError):
        m.setattr(ledger, "write", lost)
        maintained.apply(spark, root, rows, 1)
    maintained.apply(spark, root, rows, 1)
    check(spark, root)
