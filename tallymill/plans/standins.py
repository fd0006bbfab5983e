"""Tables of a question-answering service, made of the tables at hand."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="tallymill-")


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation for each user of the events, of the tenant that the user's last digit names."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), (F.col("user_id") % 10).alias("tenant_id"), "user_id").distinct()


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as messages with token counts, in their user's conversation: errors are the user's, the others the assistant's."""
    tokens = F.floor(F.col("value") * 100).cast("long")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.col("user_id").alias("conversation_id"), F.when(F.col("event_type") == "error", "user").otherwise("assistant").alias("role"),
        F.when(F.col("event_id") % 50 != 0, F.concat("event_type", F.lit("-2024-07-18"))).alias("model_used"), F.floor(tokens * 7 / 10).cast("long").alias("input_tokens"),
        (tokens - F.floor(tokens * 7 / 10).cast("long")).alias("output_tokens"), tokens.alias("total_tokens"), F.col("ts").cast("timestamp_ntz").alias("created_at"),
    )


MESSAGES_SQL = """conv AS (SELECT DISTINCT user_id AS id, user_id % 10 AS tenant_id, user_id FROM events), msg AS (SELECT m.*, c.tenant_id, c.user_id FROM (SELECT event_id AS id, user_id AS conversation_id,
 CASE WHEN event_type = 'error' THEN 'user' ELSE 'assistant' END AS role, CASE WHEN event_id % 50 <> 0 THEN event_type || '-2024-07-18' END AS model_used, CAST(floor(t * 7 / 10) AS BIGINT) AS input_tokens,
 t - CAST(floor(t * 7 / 10) AS BIGINT) AS output_tokens, t AS total_tokens, ts AS created_at
 FROM (SELECT *, CAST(floor(value * 100) AS BIGINT) AS t FROM events)) m JOIN conv c ON m.conversation_id = c.id)"""

_PRICES = [("view", "2.50", "10.00"), ("click", "0.15", "0.60"), ("purchase", "30.00", "60.00"), ("signup", "0", None)]


def prices(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame(_PRICES, "name string, i string, o string")
    return rows.select("name", F.col("i").cast("decimal(10,6)").alias("input_price"), F.col("o").cast("decimal(10,6)").alias("output_price"))


PRICES_SQL = f"""price AS (SELECT name, CAST(i AS DECIMAL(10,6)) AS input_price, CAST(o AS DECIMAL(10,6)) AS output_price
 FROM (VALUES {', '.join(f"('{n}', '{i}', {'NULL' if o is None else repr(o)})" for n, i, o in _PRICES)}) p(name, i, o))"""


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a type, a status, a size (some without), and a batch."""
    d = table(spark, sf_dir, "documents")
    kind = F.get(F.array(*map(F.lit, (".pdf", ".md", ".txt", ".docx", ".xlsx"))), (F.col("doc_id") % 5).cast("int"))
    status = F.get(F.array(*map(F.lit, ("pending", "processing", "completed", "failed"))), (F.col("doc_id") % 4).cast("int"))
    return d.select(
        F.col("doc_id").alias("id"), F.concat(F.lit("Doc "), F.left("text", F.lit(20))).alias("name"), (F.col("doc_id") % 7).alias("tenant_id"), kind.alias("document_type"),
        status.alias("processing_status"), F.when(F.col("doc_id") % 9 != 0, F.col("n_chars")).alias("file_size"), (F.col("doc_id") % 25).alias("batch_id"), "text", "lang", "source", "n_chars",
    )


DOCUMENTS_SQL = """doc AS (SELECT doc_id AS id, 'Doc ' || left(text, 20) AS name, doc_id % 7 AS tenant_id, ['.pdf', '.md', '.txt', '.docx', '.xlsx'][doc_id % 5 + 1] AS document_type,
 ['pending', 'processing', 'completed', 'failed'][doc_id % 4 + 1] AS processing_status, CASE WHEN doc_id % 9 <> 0 THEN n_chars END AS file_size, doc_id % 25 AS batch_id,
 text, lang, source, n_chars FROM documents)"""
