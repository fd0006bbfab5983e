"""Token usage and billing queries."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallymill.functions.text import normalise_model_name
from tallymill.operators import maintained
from tallymill.operators import usage as u
from tallymill.streaming import late

from .standins import MESSAGES_SQL, PRICES_SQL, conversations, folder, prices, table
from .standins import messages as _messages


def messages(spark, sf):
    return u.of_conversations(_messages(spark, sf), conversations(spark, sf))


def _usage(spark, sf):
    return u.priced(u.daily_usage(messages(spark, sf)), prices(spark))


_NORMAL = "regexp_replace(regexp_replace(regexp_replace({c}, '-?[0-9]{{4}}-?[0-9]{{2}}-?[0-9]{{2}}', '', 'g'), '-[0-9]{{4}}$', ''), '-+$', '')"
_MONEY = "coalesce(CAST({t} AS DECIMAL(18,0)) * {p} * CAST(0.000001 AS DECIMAL(7,6)), 0)"
_I, _O = _MONEY.format(t="total_input_tokens", p="input_price"), _MONEY.format(t="total_output_tokens", p="output_price")
USAGE_SQL = f"""{MESSAGES_SQL}, {PRICES_SQL}, daily AS (SELECT tenant_id, model_used AS model_name, CAST(created_at AS DATE) AS usage_date, CAST(coalesce(sum(input_tokens), 0) AS BIGINT) AS total_input_tokens,
 CAST(coalesce(sum(output_tokens), 0) AS BIGINT) AS total_output_tokens, CAST(coalesce(sum(total_tokens), 0) AS BIGINT) AS total_tokens, count(id) AS message_count FROM msg
 WHERE role = 'assistant' AND model_used IS NOT NULL AND total_tokens IS NOT NULL AND created_at < date_trunc('day', created_at) + INTERVAL '23:59:59.999999' GROUP BY ALL),
 usage AS (SELECT daily.*, CAST({_I} AS DECIMAL(12,6)) AS input_token_cost, CAST({_O} AS DECIMAL(12,6)) AS output_token_cost, CAST({_I} + {_O} AS DECIMAL(12,6)) AS total_cost
 FROM daily LEFT JOIN price ON {_NORMAL.format(c='model_name')} = name)"""
_SUM = ", ".join(
    [f"CAST(sum({c}) AS BIGINT) AS {c}" for c in u.TOKENS] + [f"CAST(sum({c}) AS DECIMAL(18,6)) AS {c}" for c in u.COSTS]
)
BILLING_SQL = f"""{USAGE_SQL}, bill AS (SELECT tenant_id, model_name, CAST(date_trunc('month', usage_date) AS DATE) AS period_start, {_SUM},
 round(avg(CAST(input_token_cost AS DOUBLE) / nullif(total_input_tokens, 0) * 1000000), 6) AS avg_input_price,
 round(avg(CAST(output_token_cost AS DOUBLE) / nullif(total_output_tokens, 0) * 1000000), 6) AS avg_output_price,
 last_day(CAST(date_trunc('month', usage_date) AS DATE)) AS period_end, CAST(year(date_trunc('month', usage_date)) AS INT) AS billing_year, CAST(month(date_trunc('month', usage_date)) AS INT) AS billing_month
 FROM usage GROUP BY tenant_id, model_name, date_trunc('month', usage_date))"""


def daily_cost(spark, sf):
    return _usage(spark, sf)


def backfill(spark, sf):
    m = messages(spark, sf)
    return u.priced(u.daily_usage(m.where(u.in_days(F.col("created_at"), "2024-01-05", "2024-01-12"))), prices(spark))


def summary(spark, sf):
    return u.usage_summary(_usage(spark, sf).where("usage_date BETWEEN DATE'2024-01-03' AND DATE'2024-01-20'"))


def by_model(spark, sf):
    return u.statistics_by_model(_messages(spark, sf))


def by_model_of_tenant(spark, sf):
    return u.statistics_by_model(_messages(spark, sf), conversations(spark, sf), 3)


def monthly_upsert(spark, sf):
    """Bills of the first twenty days as stored, then of the whole month for even tenants."""
    usage = _usage(spark, sf)
    return u.monthly_upsert(u.monthly_billing(usage.where("usage_date <= DATE'2024-01-20'")), usage.where("tenant_id % 2 = 0")).select("tenant_id", "model_name", "billing_year", "billing_month", "total_tokens", "total_cost")


def bills_by_cost(spark, sf):
    """The three most expensive bills of each tenant, in that order."""
    w = Window.partitionBy("tenant_id").orderBy(F.desc_nulls_first("total_cost"), "model_name")
    return u.by_cost(monthly(spark, sf)).withColumn("place", F.row_number().over(w)).where("place <= 3").select("tenant_id", "place", "model_name", "total_cost")


def delete_usage(spark, sf):
    """How many daily rows of odd tenants go for the days up to the 15th, and how many stay."""
    kept, counts = u.deleted(_usage(spark, sf), (F.col("tenant_id") % 2 == 1) & (F.col("usage_date") <= F.lit("2024-01-15").cast("date")), ["tenant_id"])
    return counts.join(kept.groupBy("tenant_id").agg(F.sum("total_tokens").cast("long").alias("tokens_left")), "tenant_id", "left")


def delete_billing(spark, sf):
    kept, _ = u.deleted(monthly(spark, sf), (F.col("billing_year") == 2024) & (F.col("billing_month") == 1) & (F.col("tenant_id") < 4), ["tenant_id"])
    return kept.groupBy("tenant_id").agg(F.count(F.lit(1)).alias("n"), F.sum("total_cost").cast("decimal(18,6)").alias("total_cost"))


def running_tokens(spark, sf):
    return u.running_tokens(_messages(spark, sf))


def user_stats(spark, sf):
    m = messages(spark, sf)
    return u.message_statistics(m, ["user_id"], m)


def tenant_stats(spark, sf):
    m = messages(spark, sf)
    return u.message_statistics(m, ["tenant_id"], m)


def upsert_replace(spark, sf):
    """The first twenty days as stored, then days 15 to 25 from messages of even users only."""
    old = _usage(spark, sf).where("usage_date <= DATE'2024-01-20'")
    again = messages(spark, sf).where("user_id % 2 = 0").where(u.in_days(F.col("created_at"), "2024-01-15", "2024-01-25"))
    return u.replace(old, u.priced(u.daily_usage(again), prices(spark)), u.KEY)


def upsert_counts(spark, sf):
    old = _usage(spark, sf).where("usage_date <= DATE'2024-01-20'")
    return u.upsert_counts(old, _usage(spark, sf).where("usage_date >= DATE'2024-01-15'"), u.KEY)


def upsert_increment(spark, sf):
    daily = u.daily_usage(messages(spark, sf))
    return u.increment(daily.where("usage_date <= DATE'2024-01-20'"), daily.where("usage_date >= DATE'2024-01-15'"), u.KEY, u.TOKENS)


def monthly(spark, sf):
    return u.monthly_billing(_usage(spark, sf))


def monthly_summary(spark, sf):
    return u.monthly_summary(monthly(spark, sf)).withColumn("by_model", F.to_json("by_model"))


def yearly(spark, sf):
    return u.yearly_summary(monthly(spark, sf))


def model_names(spark, sf):
    """Every priority with a date or a build appended, as names to normalise."""
    o = table(spark, sf, "orders")
    suffix = F.get(F.array(*map(F.lit, ("-2024-07-18", "-0125", "20240229", "", "-", "-preview"))), (F.col("o_orderkey") % 6).cast("int"))
    raw = F.when(F.col("o_orderkey") % 97 == 0, "unknown").otherwise(F.concat("o_orderpriority", suffix))
    return o.select(raw.alias("model"), normalise_model_name(raw).alias("normal")).groupBy("model", "normal").agg(F.count(F.lit(1)).alias("n"))


def _stats_sql(key: str) -> str:
    return f"""WITH {MESSAGES_SQL}, s AS (SELECT {key}, count(*) AS n, sum(input_tokens) AS i, sum(output_tokens) AS o, sum(total_tokens) AS t,
 string_agg(DISTINCT model_used, ',' ORDER BY model_used) AS models, count(DISTINCT user_id) AS u FROM msg WHERE role = 'assistant' GROUP BY {key})
SELECT p.{key}, CAST(coalesce(n, 0) AS BIGINT) AS total_messages, CAST(coalesce(i, 0) AS BIGINT) AS total_input_tokens, CAST(coalesce(o, 0) AS BIGINT) AS total_output_tokens,
 CAST(coalesce(t, 0) AS BIGINT) AS total_tokens, coalesce(round_even(t / nullif(n, 0), 2), 0) AS avg_tokens, coalesce(models, '') AS models_used, CAST(coalesce(u, 0) AS BIGINT) AS active_users
FROM (SELECT DISTINCT {key} FROM msg) p LEFT JOIN s USING ({key})"""


def kept_usage(spark, sf):
    """Daily usage from a stream of messages in two deliveries, every batch delivered twice; the second one brings every tenth message
    of all days, most of them late, and a repair mends those days."""
    here = f"{folder(spark)}/usage-{uuid.uuid4().hex}"
    rows = messages(spark, sf)
    late_ones = F.col("id") % 10 == 3
    add = late.keep(f"{here}/live", f"{here}/late")

    def twice(batch, number):
        add(batch, number)
        add(batch, number)

    for part in (~late_ones, late_ones):
        rows.where(part).write.mode("append").parquet(f"{here}/in")
        stream = spark.readStream.schema(rows.schema).parquet(f"{here}/in")
        stream.writeStream.foreachBatch(twice).option("checkpointLocation", f"{here}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    late.repair(spark, spark.read.schema(rows.schema).parquet(f"{here}/in"), f"{here}/live", f"{here}/late")
    return u.priced(late.usage(spark, f"{here}/live"), prices(spark))


def _maintained(spark, sf):
    """Bills after three deliveries of daily usage: of even users only, then the right rows of the first half and of the rest of the
    month, the days between in both, each delivered twice."""
    root = f"{folder(spark)}/bills-{uuid.uuid4().hex}"
    of_even = u.priced(u.daily_usage(messages(spark, sf).where("user_id % 2 = 0")), prices(spark))
    right = _usage(spark, sf)
    for number, rows in enumerate((of_even, right.where("usage_date <= DATE'2024-01-16'"), right.where("usage_date >= DATE'2024-01-12'"))):
        for _ in range(2):
            maintained.apply(spark, root, rows, number)
    return maintained.bills(spark, root)


def maintained_yearly(spark, sf):
    return u.yearly_summary(_maintained(spark, sf))


QUERIES = {
    "billing_maintained": _maintained, "billing_maintained_yearly": maintained_yearly,
    "usage_kept_by_stream": kept_usage,
    "usage_daily_cost": daily_cost, "backfill_range": backfill, "usage_summary_rollup": summary, "usage_by_model": by_model, "usage_user_stats": user_stats, "usage_tenant_stats": tenant_stats,
    "usage_upsert_replace": upsert_replace, "usage_upsert_counts": upsert_counts, "usage_upsert_increment": upsert_increment, "billing_monthly": monthly, "billing_month_summary": monthly_summary,
    "billing_yearly": yearly, "normalize_model_name": model_names, "usage_by_model_of_tenant": by_model_of_tenant, "billing_monthly_upsert": monthly_upsert, "billing_by_cost": bills_by_cost,
    "usage_delete": delete_usage, "billing_delete": delete_billing, "running_tokens": running_tokens,
}

_BY_MODEL = "SELECT model_used AS model_name, count(id) AS message_count, CAST(sum(input_tokens) AS BIGINT) AS sum_input_tokens, CAST(sum(output_tokens) AS BIGINT) AS sum_output_tokens, CAST(sum(total_tokens) AS BIGINT) AS sum_total_tokens FROM msg WHERE role = 'assistant'"
ORACLE_SQL = {
    "usage_kept_by_stream": f"WITH {USAGE_SQL} SELECT * FROM usage",
    "usage_daily_cost": f"WITH {USAGE_SQL} SELECT * FROM usage",
    "backfill_range": "WITH " + USAGE_SQL.replace("FROM events)", "FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-12 23:59:59.999999')") + " SELECT * FROM usage",
    "usage_summary_rollup": f"WITH {USAGE_SQL} SELECT model_name, {_SUM}, CAST(grouping(model_name) AS INT) AS is_total FROM usage WHERE usage_date BETWEEN DATE '2024-01-03' AND DATE '2024-01-20' GROUP BY ROLLUP (model_name)",
    "usage_by_model": f"WITH {MESSAGES_SQL} SELECT model_used AS model_name, count(id) AS message_count, CAST(sum(input_tokens) AS BIGINT) AS sum_input_tokens, CAST(sum(output_tokens) AS BIGINT) AS sum_output_tokens, CAST(sum(total_tokens) AS BIGINT) AS sum_total_tokens FROM msg WHERE role = 'assistant' GROUP BY model_used",
    "usage_by_model_of_tenant": f"WITH {MESSAGES_SQL} {_BY_MODEL} AND tenant_id = 3 GROUP BY model_used",
    "billing_monthly_upsert": f"""WITH {USAGE_SQL}, b AS (SELECT tenant_id, model_name, usage_date, total_tokens, total_cost FROM usage WHERE tenant_id % 2 = 0 UNION ALL
 SELECT tenant_id, model_name, usage_date, total_tokens, total_cost FROM usage WHERE tenant_id % 2 = 1 AND usage_date <= DATE '2024-01-20')
SELECT tenant_id, model_name, CAST(year(usage_date) AS INT) AS billing_year, CAST(month(usage_date) AS INT) AS billing_month, CAST(sum(total_tokens) AS BIGINT) AS total_tokens, CAST(sum(total_cost) AS DECIMAL(18,6)) AS total_cost FROM b GROUP BY ALL""",
    "billing_by_cost": f"WITH {BILLING_SQL} SELECT tenant_id, CAST(row_number() OVER w AS INT) AS place, model_name, total_cost FROM bill WINDOW w AS (PARTITION BY tenant_id ORDER BY total_cost DESC NULLS FIRST, model_name) QUALIFY row_number() OVER w <= 3",
    "usage_delete": f"""WITH {USAGE_SQL}, x AS (SELECT *, tenant_id % 2 = 1 AND usage_date <= DATE '2024-01-15' AS gone FROM usage)
SELECT tenant_id, count(*) FILTER (gone) AS deleted, count(*) FILTER (NOT gone) AS kept, CAST(sum(total_tokens) FILTER (NOT gone) AS BIGINT) AS tokens_left FROM x GROUP BY 1""",
    "billing_delete": f"WITH {BILLING_SQL} SELECT tenant_id, count(*) AS n, CAST(sum(total_cost) AS DECIMAL(18,6)) AS total_cost FROM bill WHERE NOT (billing_year = 2024 AND billing_month = 1 AND tenant_id < 4) GROUP BY 1",
    "running_tokens": f"""WITH {MESSAGES_SQL} SELECT conversation_id, id, CAST(sum(coalesce(input_tokens, 0)) OVER w AS BIGINT) AS used_input_tokens, CAST(sum(coalesce(output_tokens, 0)) OVER w AS BIGINT) AS used_output_tokens,
 CAST(sum(coalesce(total_tokens, 0)) OVER w AS BIGINT) AS used_total_tokens FROM msg WINDOW w AS (PARTITION BY conversation_id ORDER BY created_at, id)""",
    "usage_user_stats": _stats_sql("user_id"),
    "usage_tenant_stats": _stats_sql("tenant_id"),
    "usage_upsert_replace": f"""WITH {USAGE_SQL}, again AS (WITH {USAGE_SQL.replace('FROM events)', "FROM events WHERE user_id % 2 = 0 AND ts >= TIMESTAMP '2024-01-15' AND ts < TIMESTAMP '2024-01-25 23:59:59.999999')")} SELECT * FROM usage)
SELECT * FROM again UNION ALL SELECT * FROM usage o WHERE usage_date <= DATE '2024-01-20' AND NOT EXISTS (FROM again a WHERE a.tenant_id = o.tenant_id AND a.model_name = o.model_name AND a.usage_date = o.usage_date)""",
    "usage_upsert_counts": f"WITH {USAGE_SQL} SELECT count(*) FILTER (usage_date > DATE '2024-01-20') AS records_created, count(*) FILTER (usage_date <= DATE '2024-01-20') AS records_updated, CAST(sum(total_tokens) AS BIGINT) AS total_tokens, CAST(sum(total_cost) AS DECIMAL(18,6)) AS total_cost FROM usage WHERE usage_date >= DATE '2024-01-15'",
    "usage_upsert_increment": f"WITH {USAGE_SQL} SELECT tenant_id, model_name, usage_date, {', '.join(f'CASE WHEN usage_date BETWEEN DATE {chr(39)}2024-01-15{chr(39)} AND DATE {chr(39)}2024-01-20{chr(39)} THEN 2 ELSE 1 END * {c} AS {c}' for c in u.TOKENS)} FROM daily",
    "billing_monthly": f"WITH {BILLING_SQL} SELECT * FROM bill",
    "billing_month_summary": f"""WITH {BILLING_SQL} SELECT tenant_id, billing_year, billing_month, CAST(sum(total_tokens) AS BIGINT) AS total_tokens, CAST(sum(total_cost) AS DECIMAL(18,6)) AS total_cost,
 '{{' || string_agg('"' || model_name || '":' || CAST(CAST(total_cost AS DOUBLE) AS VARCHAR), ',' ORDER BY model_name) || '}}' AS by_model FROM bill GROUP BY ALL""",
    "billing_yearly": f"WITH {BILLING_SQL} SELECT tenant_id, billing_year, billing_month, CAST(sum(total_tokens) AS BIGINT) AS total_tokens, CAST(sum(total_cost) AS DECIMAL(18,6)) AS total_cost FROM bill GROUP BY GROUPING SETS ((tenant_id, billing_year, billing_month), (tenant_id, billing_year))",
    "normalize_model_name": f"""WITH raw AS (SELECT CASE WHEN o_orderkey % 97 = 0 THEN 'unknown' ELSE o_orderpriority || ['-2024-07-18', '-0125', '20240229', '', '-', '-preview'][o_orderkey % 6 + 1] END AS model FROM orders)
SELECT model, CASE WHEN model IN ('', 'unknown') THEN model ELSE {_NORMAL.format(c='model')} END AS normal, count(*) AS n FROM raw GROUP BY ALL""",
}

ORACLE_SQL["billing_maintained"] = ORACLE_SQL["billing_monthly"]
ORACLE_SQL["billing_maintained_yearly"] = ORACLE_SQL["billing_yearly"]
