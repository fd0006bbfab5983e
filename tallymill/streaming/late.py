"""Daily usage that is kept while messages come in, with a repair for rows that come too late.

``keep`` adds each batch to a table of ``ledger``, by day. A row is late when it is older than the newest row of
all batches before it by more than ``late``: its day counts as closed. Late rows go to a side table,
partitioned by day, and ``repair`` computes only those days again, from all messages. Both tables commit
whole and know the last batch, the side table first, so a batch that is delivered again after any failure is
split and counted as before.

Rows without a time are in no day. Rows that the rollup leaves out (roles, missing models or tokens) may be
late too: they touch a day without changing it. Without late rows a repair does nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymill.operators import usage as u
from tallymill.sources import ledger

DAY = "usage_date"


def _kept(messages: DataFrame) -> DataFrame:
    """Daily usage with the time of the newest row, which says what is late."""
    newest = messages.where("created_at IS NOT NULL").groupBy("tenant_id", F.col("model_used").alias("model_name"), F.col("created_at").cast("date").alias(DAY)).agg(F.max("created_at").alias("newest_at"))
    usage = u.daily_usage(messages)
    keys = [F.col(f"usage.{k}").eqNullSafe(F.col(f"newest.{k}")) for k in u.KEY]
    joined = newest.alias("newest").join(usage.alias("usage"), keys[0] & keys[1] & keys[2], "left")
    return joined.select(*(f"newest.{k}" for k in u.KEY), *(F.coalesce(f"usage.{t}", F.lit(0)).cast("long").alias(t) for t in u.TOKENS), "newest.newest_at")


def _added(old: DataFrame, new: DataFrame) -> DataFrame:
    rows = old.select(*new.columns).unionByName(new)
    return rows.groupBy(*u.KEY).agg(*(F.sum(t).cast("long").alias(t) for t in u.TOKENS), F.max("newest_at").alias("newest_at"))


def keep(live: str, aside: str, late: str = "2 days", writer: str = "live") -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: a batch of messages (with tenant) into the table at ``live``, its late rows into the one at ``aside``."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.withColumn(DAY, F.col("created_at").cast("date")).where(f"{DAY} IS NOT NULL")
        is_late = F.lit(False)
        if ledger.latest(spark, live):
            newest = ledger.read(spark, live).agg(F.max("newest_at")).first()[0]
            if newest is not None:
                is_late = F.col("created_at") < F.lit(newest).cast(batch.schema["created_at"].dataType) - F.expr(f"INTERVAL {late}")
        ledger.write(spark, aside, rows.where(is_late), DAY, lambda old, new: old.unionByName(new), writer, number)
        ledger.write(spark, live, _kept(rows.where(~is_late).drop(DAY)), DAY, _added, writer, number)

    return write


def late_days(spark: SparkSession, aside: str) -> list[str]:
    """The days that late rows touch, from the side table's folders alone."""
    found = ledger.latest(spark, aside)
    return sorted(found.commits) if found else []


def repair(spark: SparkSession, messages: DataFrame, live: str, aside: str) -> list[str]:
    """Computes the days of late rows again from all messages, and empties the side table of them; gives these days.

    A repair that dies is done again: days are replaced, and leave the side table last.
    """
    days = late_days(spark, aside)
    if days:
        ts = F.col("created_at")
        kind = messages.schema["created_at"].dataType
        of_days = [(ts >= F.lit(d).cast(kind)) & (ts < F.date_add(F.lit(d).cast("date"), 1).cast(kind)) for d in days]
        ledger.write(spark, live, _kept(messages.where(_any(of_days))), DAY)
        ledger.drop_partitions(spark, aside, days)
    return days


def _any(conditions: list[Column]) -> Column:
    """Conditions are as many as late days; they are halved so that the expression stays shallow."""
    if len(conditions) == 1:
        return conditions[0]
    half = len(conditions) // 2
    return _any(conditions[:half]) | _any(conditions[half:])


def usage(spark: SparkSession, live: str) -> DataFrame:
    """Daily usage as kept. Days of which nothing counts are left out."""
    return ledger.read(spark, live).where("message_count > 0").select(*u.KEY, *u.TOKENS)
