"""Token usage and billing: daily, monthly and yearly rollups, statistics, and repeatable upserts."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymill.functions.money import COST, cost, unrounded_cost
from tallymill.functions.text import normalise_model_name

KEY = ["tenant_id", "model_name", "usage_date"]
TOKENS = ["total_input_tokens", "total_output_tokens", "total_tokens", "message_count"]
COSTS = ["input_token_cost", "output_token_cost", "total_cost"]


def in_days(ts: Column, first: str, last: str) -> Column:
    """From the beginning of ``first`` to just before the last microsecond of ``last``, which is left out."""
    return (ts >= F.lit(f"{first} 00:00:00").cast("timestamp_ntz")) & (ts < F.lit(f"{last} 23:59:59.999999").cast("timestamp_ntz"))


def check_range(first: dt.date, last: dt.date, most_days: int, today: dt.date | None = None) -> None:
    """Raises for reversed, overlong or (with ``today``) future ranges."""
    if first > last:
        raise ValueError("the range ends before it begins")
    if (last - first).days > most_days:
        raise ValueError(f"the range is longer than {most_days} days")
    if today is not None and last > today:
        raise ValueError("the range ends in the future")


def of_conversations(messages: DataFrame, conversations: DataFrame) -> DataFrame:
    """Messages with their conversation's tenant and user; messages without a conversation go."""
    c = conversations.select(F.col("id").alias("conversation_id"), "tenant_id", "user_id")
    return messages.join(c, "conversation_id")


def daily_usage(messages: DataFrame) -> DataFrame:
    """Tokens and messages by tenant, model and day; of assistant messages with a model and a token count.

    One job covers any number of days. A day's last microsecond belongs to no day.
    """
    ts = F.col("created_at")
    rows = messages.where("role = 'assistant' AND model_used IS NOT NULL AND total_tokens IS NOT NULL")
    rows = rows.where(ts < F.date_trunc("day", ts).cast("timestamp_ntz") + F.expr("INTERVAL '23:59:59.999999' HOUR TO SECOND"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return rows.groupBy("tenant_id", F.col("model_used").alias("model_name"), ts.cast("date").alias("usage_date")).agg(
        total("input_tokens").alias("total_input_tokens"), total("output_tokens").alias("total_output_tokens"), total("total_tokens").alias("total_tokens"), F.count("id").alias("message_count")
    )


def priced(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """Costs of usage rows by normalised model name; a name with two prices (name, input_price, output_price) fails the job once usage needs it."""
    once = lambda c: F.when(F.count(F.lit(1)) > 1, F.raise_error(F.concat(F.lit("several prices for "), "name"))).otherwise(F.max(c)).alias(c)
    p = prices.groupBy("name").agg(once("input_price"), once("output_price")).withColumnRenamed("name", "_name")
    joined = usage.join(p, normalise_model_name(F.col("model_name")) == F.col("_name"), "left")
    i, o = unrounded_cost(F.col("total_input_tokens"), F.col("input_price")), unrounded_cost(F.col("total_output_tokens"), F.col("output_price"))
    return joined.select(*usage.columns, cost(F.col("total_input_tokens"), F.col("input_price")).alias(COSTS[0]), cost(F.col("total_output_tokens"), F.col("output_price")).alias(COSTS[1]), (i + o).cast(COST).alias(COSTS[2]))


def replace(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Upsert: rows of ``new`` take the place of those with the same key. Running it again changes nothing."""
    rest = [c for c in old.columns if c not in keys]
    o, n = old.select(*keys, F.struct(*rest).alias("_o")), new.select(*keys, F.struct(*rest).alias("_n"))
    return o.join(n, keys, "full_outer").select(*keys, F.coalesce("_n", "_o").alias("_r")).select(*keys, "_r.*")


def increment(old: DataFrame, new: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    """Upsert that adds measures to those of the same key."""
    both = old.select(*keys, *measures).unionByName(new.select(*keys, *measures))
    return both.groupBy(*keys).agg(*(F.sum(m).cast(old.schema[m].dataType).alias(m) for m in measures))


def upsert_counts(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """records_created, records_updated, total_tokens, total_cost of an upsert."""
    had = old.select(*keys, F.lit(1).alias("_had"))
    joined = new.join(had, keys, "left")
    return joined.agg(
        F.count_if(F.col("_had").isNull()).alias("records_created"), F.count_if(F.col("_had").isNotNull()).alias("records_updated"),
        F.coalesce(F.sum("total_tokens"), F.lit(0)).cast("long").alias("total_tokens"), F.coalesce(F.sum("total_cost"), F.lit(0)).cast("decimal(18,6)").alias("total_cost"),
    )


def _sums(kinds: dict[str, str]) -> list[Column]:
    return [F.sum(c).cast(kind).alias(c) for c, kind in kinds.items()]


_MEASURES = dict.fromkeys(TOKENS, "long") | dict.fromkeys(COSTS, "decimal(18,6)")


def usage_summary(usage: DataFrame) -> DataFrame:
    """By model, and in a last row with a null model and is_total 1, over all."""
    return usage.rollup("model_name").agg(*_sums(_MEASURES), F.grouping("model_name").cast("int").alias("is_total"))


def monthly_billing(usage: DataFrame) -> DataFrame:
    """By tenant, model and month, with the month's bounds and the mean of daily prices of a million tokens (days without tokens have none)."""
    month = usage.withColumn("period_start", F.trunc("usage_date", "month").cast("date"))
    unit = lambda c, t: F.round(F.avg(F.col(c).cast("double") / F.nullif(F.col(t), F.lit(0)) * 1_000_000), 6)
    return (
        month.groupBy("tenant_id", "model_name", "period_start")
        .agg(*_sums(_MEASURES), unit("input_token_cost", "total_input_tokens").alias("avg_input_price"), unit("output_token_cost", "total_output_tokens").alias("avg_output_price"))
        .withColumn("period_end", F.last_day("period_start"))
        .withColumn("billing_year", F.year("period_start"))
        .withColumn("billing_month", F.month("period_start"))
    )


def monthly_summary(billing: DataFrame) -> DataFrame:
    """One row for each tenant and month, with a map from model to cost."""
    by_model = F.map_from_entries(F.array_sort(F.collect_list(F.struct("model_name", F.col("total_cost").cast("double")))))
    return billing.groupBy("tenant_id", "billing_year", "billing_month").agg(F.sum("total_tokens").cast("long").alias("total_tokens"), F.sum("total_cost").cast("decimal(18,6)").alias("total_cost"), by_model.alias("by_model"))


def yearly_summary(billing: DataFrame) -> DataFrame:
    """By month of each tenant's year, and the year (null month). Months without data are absent."""
    out = billing.groupBy("tenant_id", "billing_year", "billing_month").agg(F.sum("total_tokens").alias("t"), F.sum("total_cost").alias("c"))
    return out.rollup("tenant_id", "billing_year", "billing_month").agg(F.sum("t").cast("long").alias("total_tokens"), F.sum("c").cast("decimal(18,6)").alias("total_cost"), F.grouping_id().alias("_g")).where("_g <= 1").drop("_g")


def message_statistics(messages: DataFrame, keys: list[str], population: DataFrame) -> DataFrame:
    """Assistant messages, tokens, mean tokens a message and models used, for every key of ``population``; zeros without messages."""
    rows = messages.where("role = 'assistant'")
    stats = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_messages"), F.sum("input_tokens").alias("i"), F.sum("output_tokens").alias("o"), F.sum("total_tokens").alias("t"),
        F.array_sort(F.collect_set(F.nullif("model_used", F.lit("")))).alias("models_used"), F.countDistinct("user_id").alias("active_users"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    n = zero("total_messages")
    mean = F.coalesce(F.bround(zero("t") / F.nullif(n, F.lit(0)), 2), F.lit(0.0))
    return population.select(*keys).distinct().join(stats, keys, "left").select(
        *keys, n.alias("total_messages"), zero("i").alias("total_input_tokens"), zero("o").alias("total_output_tokens"), zero("t").alias("total_tokens"),
        mean.alias("avg_tokens"), F.array_join(F.coalesce("models_used", F.array().cast("array<string>")), ",").alias("models_used"), zero("active_users").alias("active_users"),
    )


def statistics_by_model(messages: DataFrame, conversations: DataFrame | None = None, tenant_id: int | None = None) -> DataFrame:
    """Assistant messages and tokens by model; messages without a model are a group. Only a tenant's messages need their conversations."""
    if tenant_id is not None:
        messages = of_conversations(messages, conversations.where(F.col("tenant_id") == tenant_id))
    return messages.where("role = 'assistant'").groupBy(F.col("model_used").alias("model_name")).agg(
        F.count("id").alias("message_count"), *(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(f"sum_{c}") for c in ("input_tokens", "output_tokens", "total_tokens"))
    )


def monthly_upsert(old: DataFrame, usage: DataFrame) -> DataFrame:
    """Stored bills with those of the usage's months in place of the same tenant's, model's and month's."""
    return replace(old, monthly_billing(usage).select(*old.columns), ["tenant_id", "model_name", "billing_year", "billing_month"])


def by_cost(bills: DataFrame) -> DataFrame:
    """A tenant's bills, the most expensive first."""
    return bills.orderBy("tenant_id", F.desc_nulls_first("total_cost"), "model_name")


def deleted(rows: DataFrame, condition: Column, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows without those that meet a condition, and how many went by key."""
    gone = F.coalesce(condition, F.lit(False))
    return rows.where(~gone), rows.groupBy(*keys).agg(F.count_if(gone).alias("deleted"), F.count_if(~gone).alias("kept"))


def running_tokens(messages: DataFrame) -> DataFrame:
    """Tokens used up to and with each message of a conversation."""
    w = Window.partitionBy("conversation_id").orderBy("created_at", "id").rowsBetween(Window.unboundedPreceding, 0)
    return messages.select("conversation_id", "id", *(F.sum(F.coalesce(c, F.lit(0))).over(w).alias(f"used_{c}") for c in ("input_tokens", "output_tokens", "total_tokens")))


def previous_month(day: dt.date) -> tuple[int, int]:
    return (day.year - 1, 12) if day.month == 1 else (day.year, day.month - 1)


def last_thirty_days(today: dt.date) -> tuple[dt.date, dt.date]:
    """Both ends count, so 31 dates."""
    return today - dt.timedelta(days=30), today
