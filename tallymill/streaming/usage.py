"""Structured Streaming twins of the batch rollups: running daily usage, sessions, duplicates, state by key."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LATE = "2 days"


def events(spark: SparkSession, sf_dir: str, files_per_batch: int = 1) -> DataFrame:
    """The events table as a stream, with a time zone's timestamps."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{sf_dir}/event[s].parquet")
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def daily_usage(messages: DataFrame) -> DataFrame:
    """Running totals by tenant, model and day (update mode); rows later than the watermark are left to the nightly rollup."""
    rows = messages.where("role = 'assistant' AND model_used IS NOT NULL").withWatermark("created_at", LATE)
    held = rows.groupBy("tenant_id", F.col("model_used").alias("model_name"), F.window("created_at", "1 day").alias("w"))
    sums = held.agg(F.sum("total_tokens").cast("long").alias("total_tokens"), F.count(F.lit(1)).alias("message_count"))
    return sums.select("tenant_id", "model_name", F.col("w.start").cast("date").alias("usage_date"), "total_tokens", "message_count")


def sliding_counts(rows: DataFrame, size: str = "2 hours", slide: str = "1 hour") -> DataFrame:
    held = rows.withWatermark("ts", LATE).groupBy(F.window("ts", size, slide).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("value"))
    return held.select(F.col("w.start").alias("start"), "event_type", "n", "value")


def batch_counts(rows: DataFrame, key: str, done: str, failed: str) -> DataFrame:
    """Events of each key so far, and how many of them completed or failed (update mode)."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == done).alias("completed"), F.count_if(F.col("status") == failed).alias("failed"))


def sessions(rows: DataFrame, key: str, gap: str) -> DataFrame:
    """Sessions of a key, closed when the watermark passes their end (append mode)."""
    held = rows.withWatermark("ts", LATE).groupBy(key, F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n_events"))
    return held.select(key, F.col("w.start").alias("first_at"), F.col("w.end").alias("end_at"), "n_events")


def distinct_events(rows: DataFrame, key: str = "event_id") -> DataFrame:
    """Each event once, however often it is delivered within the watermark."""
    return rows.withWatermark("ts", LATE).dropDuplicatesWithinWatermark([key])


def run(stream: DataFrame, folder: str, mode: str = "update") -> DataFrame:
    """Runs a stream over all that is available now; every batch's rows go to a table with the batch's number, written whole or not at all."""
    spark = stream.sparkSession
    out, name = f"{folder}/stream-{uuid.uuid4().hex}", uuid.uuid4().hex

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{out}/batch={number:06d}/rows")

    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint-{name}").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema.add("batch", "long")).parquet(f"{out}/*/rows")


def latest(updates: DataFrame, keys: list[str]) -> DataFrame:
    """The last update of each key."""
    w = Window.partitionBy(*keys).orderBy(F.desc("batch"))
    return updates.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "batch")
