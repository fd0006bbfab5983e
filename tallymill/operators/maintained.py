"""Monthly bills that follow the daily usage by differences, without being built again.

``apply`` takes daily usage rows (as ``usage.priced`` makes them) that replace those of the same tenant, model and day. It reads
the old rows of the touched days, and adds to each touched month what the new rows bring and takes away what the old ones
had brought. Months hold sums and counts, also of the daily prices (as decimals, so that taking away is exact),
so ``bills`` equals the rollup of all days. A month whose last day's row goes has no bill.

The tables are those of ``sources.ledger``: by month first, then by day. Both know the last batch, so a batch that is
delivered again after a failure between them changes nothing twice: its days are still the old ones when the
months are not yet written, and the months are passed over when they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymill.operators import usage as u
from tallymill.sources import ledger

MONTH = ["tenant_id", "model_name", "period_start"]
_PRICE = "decimal(28,12)"
_PARTS = dict.fromkeys(u.TOKENS, "long") | dict.fromkeys(u.COSTS, "decimal(18,6)") | {"input_prices": _PRICE, "output_prices": _PRICE, "input_days": "long", "output_days": "long", "days": "long"}


def parts(usage: DataFrame, sign: int = 1) -> DataFrame:
    """What each daily row adds to its month (sign 1), or takes from it (-1)."""
    price = lambda cost, tokens: (F.col(cost).cast("double") / F.nullif(F.col(tokens), F.lit(0)) * 1_000_000).cast(_PRICE)
    made: dict[str, Column] = {c: F.col(c) for c in (*u.TOKENS, *u.COSTS)}
    for side in ("input", "output"):
        p = price(f"{side}_token_cost", f"total_{side}_tokens")
        made |= {f"{side}_prices": F.coalesce(p, F.lit(0).cast(_PRICE)), f"{side}_days": F.when(p.isNotNull(), 1).otherwise(0)}
    made["days"] = F.lit(1)
    month = F.trunc("usage_date", "month").cast("date").alias("period_start")
    return usage.select("tenant_id", "model_name", month, *((made[c] * sign).cast(kind).alias(c) for c, kind in _PARTS.items()))


def summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*MONTH).agg(*(F.sum(c).cast(kind).alias(c) for c, kind in _PARTS.items()))


def apply(spark: SparkSession, root: str, usage: DataFrame, batch: int, writer: str = "usage") -> None:
    """Daily usage into the tables at ``root``/days and ``root``/months. Each tenant, model and day comes once in ``usage``."""
    days, months = f"{root}/days", f"{root}/months"
    change = parts(usage)
    if ledger.latest(spark, days):
        old = ledger.read(spark, days).join(usage.select("usage_date").distinct(), "usage_date", "left_semi")  # pruned to the touched days
        change = change.unionByName(parts(old.join(usage.select(*u.KEY), u.KEY, "left_semi"), -1))
    ledger.write(spark, months, summed(change), "period_start", lambda old, new: summed(old.select(*new.columns).unionByName(new)).where("days > 0"), writer, batch)
    ledger.write(spark, days, usage, "usage_date", lambda old, new: u.replace(old.select(*new.columns), new, u.KEY), writer, batch)


def bills(spark: SparkSession, root: str) -> DataFrame:
    """The bills of all months, in the columns of ``usage.monthly_billing``."""
    mean = lambda side: F.round((F.col(f"{side}_prices") / F.nullif(F.col(f"{side}_days"), F.lit(0))).cast("double"), 6).alias(f"avg_{side}_price")
    rows = ledger.read(spark, f"{root}/months").where("days > 0")
    return rows.select(
        *MONTH, *u.TOKENS, *u.COSTS, mean("input"), mean("output"), F.last_day("period_start").alias("period_end"), F.year("period_start").alias("billing_year"), F.month("period_start").alias("billing_month")
    )
