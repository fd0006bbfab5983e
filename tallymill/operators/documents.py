"""Documents of a tenant: details, lists, failures with their errors, progress by status and stage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymill.operators.listing import filtered

#: Stages of the processing pipeline in order.
STAGES = ("downloading", "extracting", "chunking", "embedding", "storing")


def by_key(rows: DataFrame, column: str, value) -> DataFrame:
    """Point look-up; the filter reaches the scan."""
    return rows.where(F.col(column) == value)


def details(documents: DataFrame, document_id: int, tenant_id: int) -> DataFrame:
    """A tenant's document with its folder path from the source's JSON; one row with an error if it is not the tenant's."""
    found = by_key(documents, "id", document_id).where(F.col("tenant_id") == tenant_id)
    fields = [
        F.col("name"), F.col("document_type"), F.col("doc_category"), F.coalesce("summary", F.lit("")).alias("summary"), F.col("processing_status"),
        F.try_variant_get(F.try_parse_json("source_metadata"), "$.box_path", "string").alias("box_path"),
    ]
    one = documents.sparkSession.range(1).select(F.lit(document_id).cast("long").alias("document_id"))
    out = one.join(found.select(F.struct(*fields).alias("d")), F.lit(True), "left")
    return out.select("document_id", "d.*", F.when(F.col("d").isNull(), f"Document {document_id} not found.").alias("error"))


def completed(documents: DataFrame, tenant_id: int, category: str | None = None, date_range: str | None = None, doc_type: str | None = None, search: str | None = None) -> DataFrame:
    """A tenant's completed documents by optional filters."""
    rows = filtered(documents.where(F.col("tenant_id") == tenant_id), search=search, status="completed", document_type=doc_type)
    for column, value in (("doc_category", category), ("doc_date_range", date_range)):
        rows = rows.where(F.col(column) == value) if value else rows
    text = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return rows.select(F.col("id").alias("document_id"), "name", "document_type", text("doc_category"), text("doc_date_range"), "chunk_count", text("source_type"))


def failures(documents: DataFrame, errors: DataFrame) -> DataFrame:
    """Failed documents with the stage, message and retries of their latest error (document_id, ts, event_id, stage, error, retry).

    Without one: stage unknown, the document's own message, no retries.
    """
    last = errors.groupBy("document_id").agg(F.max_by(F.struct("stage", "error", "retry"), F.struct("ts", "event_id")).alias("e"))
    failed = documents.where("processing_status = 'failed'").withColumnRenamed("id", "document_id")
    return failed.join(last, "document_id", "left").select(
        "document_id", "name", F.when(F.col("e").isNull(), "unknown").otherwise(F.col("e.stage")).alias("failed_at_stage"),
        F.when(F.col("e").isNull(), F.col("error_message")).otherwise(F.col("e.error")).alias("error"), F.coalesce("e.retry", F.lit(0)).cast("int").alias("retry_count"),
    )


def breakdown(documents: DataFrame, keys: list[str]) -> DataFrame:
    """Documents by status, each in one of four buckets (unknown ones are pending), and by the stage of those in work."""
    done, failed = F.col("status") == "completed", F.col("status") == "failed"
    busy = F.col("status").isin("processing", "in_progress")
    other = ~F.coalesce(done | failed | busy, F.lit(False))
    stages = [F.count_if(busy & (F.col("stage") == s)).alias(f"stage_{s}") for s in STAGES]
    return documents.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"), F.count_if(done).alias("completed"), F.count_if(failed).alias("failed"), F.count_if(busy).alias("processing"), F.count_if(other).alias("pending"), *stages)


def with_parent(rows: DataFrame, parents: DataFrame, key: str, name: str) -> DataFrame:
    """Rows with a struct of their parent (id, ...); null without one."""
    held = parents.select(F.col("id").alias("_id"), F.struct(*(c for c in parents.columns if c != "id")).alias(name))
    return rows.join(held, rows[key] == held["_id"], "left").drop("_id")


def with_lookups(rows: DataFrame, lookups: dict[str, DataFrame]) -> DataFrame:
    """Rows with a column for each look-up table (id, value), found by the column of the same name with _id."""
    for name, values in lookups.items():
        held = values.select(F.col("id").alias("_id"), F.col("value").alias(name))
        rows = rows.join(held, rows[f"{name}_id"] == held["_id"], "left").drop("_id")
    return rows


def first_of_key(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(*keys).orderBy(order)
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Each key's row with the greatest order."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*keys, "r.*")


def page_of(rows: DataFrame, page: int, per_page: int) -> DataFrame:
    """A page by id with the number of all rows and of pages."""
    total = rows.agg(F.count(F.lit(1)).alias("total")).withColumn("pages", F.greatest(F.lit(1), F.expr(f"(total + {per_page - 1}) div {per_page}")))
    return rows.orderBy("id").offset((page - 1) * per_page).limit(per_page).join(total, F.lit(True))  # one row


def appended(rows: DataFrame, new: DataFrame) -> DataFrame:
    """Bulk insert: new rows under the old ones' columns, what they lack is null."""
    return rows.unionByName(new, allowMissingColumns=True).select(*rows.columns)


def without_config(configs: DataFrame, config_id: int) -> DataFrame:
    """Configurations less one; if that was its tenant's default, the first of the rest (default, then newest) becomes it."""
    gone = by_key(configs, "id", config_id).where("is_default").select(F.col("tenant_id").alias("_t"))
    rest = configs.where(F.col("id") != config_id).join(gone, F.col("tenant_id") == F.col("_t"), "left")
    w = Window.partitionBy("tenant_id").orderBy(F.desc("is_default"), F.desc("created_at"), F.desc("id"))
    first = F.col("_t").isNotNull() & (F.row_number().over(w) == 1)
    return rest.withColumn("is_default", F.col("is_default") | first).select(*configs.columns)


# histories kept as JSON text

_HISTORY = "array<struct<version:int,timestamp:string,config:map<string,string>>>"


def backfilled(history: Column, created_at: Column, config: Column) -> Column:
    """A history of one version from the present columns where there is none."""
    first = F.array(F.struct(F.lit(0).alias("version"), created_at.cast("string").alias("timestamp"), config.alias("config")))
    return F.coalesce(history, F.to_json(first, {"ignoreNullFields": "false"}))


def patched(history: Column, key: str, value: Column) -> Column:
    """Every version's config with ``key``: its own value, else ``value``."""
    entry = lambda h: F.struct(h["version"].alias("version"), h["timestamp"].alias("timestamp"), F.map_concat(F.map_filter(h["config"], lambda k, _: k != key), F.create_map(F.lit(key), F.coalesce(F.try_element_at(h["config"], F.lit(key)), value))).alias("config"))
    return F.to_json(F.transform(F.from_json(history, _HISTORY), entry), {"ignoreNullFields": "false"})


def last_setting(history: Column, key: str, kind: str) -> Column:
    """A setting of the array's last version, cast; null where it is missing or no ``kind``."""
    return F.try_element_at(F.try_element_at(F.from_json(history, _HISTORY), F.lit(-1))["config"], F.lit(key)).try_cast(kind)
