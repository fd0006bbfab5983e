"""Listing queries: sorting, paging, latest of a group, histories, transcripts, counts by status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymill.functions.text import snippet

#: Statuses in the order in which they sort.
STATUS_ORDER = ("pending", "processing", "completed", "failed")


def enum_order(c: Column, values: tuple[str, ...] = STATUS_ORDER) -> Column:
    return F.array_position(F.array(*map(F.lit, values)), c)


def sorted_page(rows: DataFrame, field: str, descending: bool = False, offset: int = 0, limit: int = 20) -> DataFrame:
    """One page ordered by a field, then id in the same direction; nulls are last ascending and first descending."""
    key = enum_order(F.col(field)) if field == "processing_status" else F.col(field)
    order = [key.desc_nulls_first(), F.col("id").desc()] if descending else [key.asc_nulls_last(), F.col("id").asc()]
    return rows.orderBy(*order).offset(offset).limit(limit)


def page_count(total: int, per_page: int) -> int:
    return max(1, -(-total // per_page))


def filtered(rows: DataFrame, search: str | None = None, status: str | None = None, exclude_failed: bool = False, document_type: str | None = None, ids: list[int] | None = None) -> DataFrame:
    """Optional predicates: only those given apply, and a status overrides ``exclude_failed``."""
    if search:
        rows = rows.where(F.col("name").ilike(f"%{search}%"))
    if status:
        rows = rows.where(F.col("processing_status") == status)
    elif exclude_failed:
        rows = rows.where(F.col("processing_status") != "failed")
    if document_type:
        rows = rows.where(F.col("document_type") == document_type)
    if ids:
        rows = rows.where(F.col("id").isin(ids))
    return rows


def last_messages(messages: DataFrame) -> DataFrame:
    """The latest message of each conversation; of equal times, the largest id."""
    last = F.max_by(F.struct("id", "role", "content", "created_at"), F.struct("created_at", "id"))
    return messages.groupBy("conversation_id").agg(last.alias("m")).select("conversation_id", "m.*")


def with_preview(conversations: DataFrame, messages: DataFrame, length: int = 100) -> DataFrame:
    """A page of conversations with the beginning of each one's last message."""
    mine = messages.join(conversations.select(F.col("id").alias("conversation_id")), "conversation_id", "left_semi")
    last = last_messages(mine).select("conversation_id", snippet(F.col("content"), length, "...").alias("preview"))
    return conversations.join(last, conversations["id"] == last["conversation_id"], "left").drop("conversation_id")


def with_children(parents: DataFrame, children: DataFrame, parent_key: str, order: list[str], name: str) -> DataFrame:
    """Parents with an ordered array of their children; page the parents first."""
    rest = [c for c in children.columns if c != parent_key]
    held = children.groupBy(parent_key).agg(F.array_sort(F.collect_list(F.struct(*order, *(c for c in rest if c not in order)))).alias(name))
    return parents.join(held, parents["id"] == held[parent_key], "left").drop(parent_key)


def recent(messages: DataFrame, n: int) -> DataFrame:
    """Each conversation's last n messages; 0 means all."""
    if not n:
        return messages
    w = Window.partitionBy("conversation_id").orderBy(F.desc("created_at"), F.desc("id"))
    return messages.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def transcript(messages: DataFrame, budget: int = 8000) -> DataFrame:
    """Lines ``ROLE: content`` of the newest messages that fit, oldest first, by conversation."""
    line = F.concat(F.upper("role"), F.lit(": "), F.coalesce("content", F.lit("")), F.lit("\n"))
    w = Window.partitionBy("conversation_id").orderBy(F.desc("created_at"), F.desc("id")).rowsBetween(Window.unboundedPreceding, 0)
    fit = messages.withColumn("line", line).withColumn("used", F.sum(F.length("line")).over(w)).where(F.col("used") <= budget)
    parts = F.array_sort(F.collect_list(F.struct("created_at", "id", "line")))
    return fit.groupBy("conversation_id").agg(F.count(F.lit(1)).alias("n_messages"), F.array_join(F.transform(parts, lambda p: p["line"]), "").alias("transcript"))


def status_counts(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Counts by status and their total; an unknown status counts as pending."""
    known = F.col("processing_status").isin(*STATUS_ORDER[1:])
    state = F.when(known, F.col("processing_status")).otherwise("pending")
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"), *(F.count_if(state == s).alias(s) for s in STATUS_ORDER))


def batch_progress(rows: DataFrame) -> DataFrame:
    """Counts, status, percentage and seconds left of each upload batch."""
    c = status_counts(rows, ["batch_id"])
    total, pending, busy, done, failed = (F.col(x) for x in ("total", "pending", "processing", "completed", "failed"))
    still = (pending + busy) > 0
    status = (
        F.when(total == 0, "pending").when(done == total, "completed").when(failed == total, "failed").when((done > 0) & still, "processing").when((done > 0) & ~still, "partial_success").otherwise("processing")
    )
    progress = F.coalesce(F.bround((done + failed) / F.nullif(total, F.lit(0)) * 100, 2), F.lit(0.0))
    return c.select("*", status.alias("batch_status"), progress.alias("progress"), F.when((busy > 0) & (done > 0), busy * 30).alias("seconds_left"))


def length_stats(chunks: DataFrame, keys: list[str], column: str = "text") -> DataFrame:
    """Number, least, greatest, floored mean and sum of lengths."""
    n = F.length(column)
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    rows = chunks.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_chunks"), zero(F.min(n)).alias("min_chars"), zero(F.max(n)).alias("max_chars"), zero(F.sum(n)).alias("total_chars"))
    return rows.withColumn("mean_chars", F.expr("coalesce(total_chars div nullif(n_chunks, 0), 0L)"))


def duplicate_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).count().where("count > 1").drop("count")


def rename_duplicates(rows: DataFrame, keys: list[str], name: str = "name") -> DataFrame:
    """Of equal names within the other keys, the second gets " 2", and so on, by id."""
    r = F.row_number().over(Window.partitionBy(*keys, name).orderBy("id"))
    return rows.withColumn("_r", r).withColumn(name, F.when(F.col("_r") > 1, F.concat_ws(" ", name, F.col("_r").cast("string"))).otherwise(F.col(name))).drop("_r")


def default_or_latest(configs: DataFrame, keys: list[str]) -> DataFrame:
    """The default configuration of each key, else the latest."""
    w = Window.partitionBy(*keys).orderBy(F.desc("is_default"), F.desc("created_at"), F.desc("id"))
    return configs.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def message_defaults(messages: DataFrame) -> DataFrame:
    """Assistant messages without counts or model get 0 and "unknown"."""
    mine = F.col("role") == "assistant"
    out = messages
    for c, value in (("input_tokens", 0), ("output_tokens", 0), ("total_tokens", 0), ("model_used", "unknown")):
        out = out.withColumn(c, F.when(mine, F.coalesce(F.col(c), F.lit(value))).otherwise(F.col(c)))
    return out


def bulk_delete_plan(rows: DataFrame, wanted: DataFrame, tenant_id: int) -> DataFrame:
    """What becomes of each wanted id, once each: deleted, wrong_tenant or not_found."""
    found = rows.select(F.col("id"), F.col("tenant_id").alias("_t"), F.lit(True).alias("_found"))
    out = wanted.select("id").dropDuplicates().join(found, "id", "left")
    return out.select("id", F.when(F.col("_found").isNull(), "not_found").when(F.col("_t") != tenant_id, "wrong_tenant").otherwise("deleted").alias("outcome"))
