"""Tables: files and databases in, partitions out."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymill.functions.text import s3_key
from tallymill.operators.usage import replace

from . import ledger
from .uploads import opened


def read(spark: SparkSession, path: str, kind: str = "parquet", schema: str | None = None) -> DataFrame:
    reader = spark.read.format(kind)
    return (reader.schema(schema) if schema else reader).load(path)


def read_database(spark: SparkSession, url: str, table: str, column: str, bounds: tuple[int, int], partitions: int = 16, **options: str) -> DataFrame:
    """A database table read in ranges of a numeric column, one connection for each partition."""
    settings = {"url": url, "dbtable": table, "partitionColumn": column, "lowerBound": str(bounds[0]), "upperBound": str(bounds[1]), "numPartitions": str(partitions), "pushDownPredicate": "true"}
    return spark.read.format("jdbc").options(**settings, **options).load()


def read_objects(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Objects of a store as rows: path, key, modified, length, content."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return rows.select("path", s3_key(F.regexp_replace("path", "^s3a:", "s3:")).alias("key"), F.col("modificationTime").alias("modified"), "length", "content")


def _each_object(objects: DataFrame, act: Callable, *columns: str) -> DataFrame:
    """path, done and error of an action on each object, in tasks. An action that is done again leaves the same."""

    def run(batches):
        for batch in batches:
            rows = []
            for path, *rest in zip(*(batch.column(k).to_pylist() for k in range(batch.num_columns)), strict=True):
                try:
                    rows.append((path, bool(act(*opened(path), *rest)), None))
                except Exception as e:  # noqa: BLE001  whatever a store raises
                    rows.append((path, False, f"{type(e).__name__}: {e}"[:200]))
            cols = list(zip(*rows, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.bool_()), pa.array(cols[2], pa.string())], ["path", "done", "error"])

    return objects.where("path IS NOT NULL").select("path", *columns).mapInArrow(run, "path string, done boolean, error string")


def put_objects(objects: DataFrame) -> DataFrame:
    """Writes objects (path, content) in place of any at their paths; path, done and error of each. A null content is an empty object."""

    def put(system, at, content):
        system.create_dir(at.rpartition("/")[0], recursive=True)
        with system.open_output_stream(at) as f:
            f.write(content or b"")
        return True

    return _each_object(objects, put, "content")


def delete_objects(objects: DataFrame) -> DataFrame:
    """Deletes objects (path); done is false for those that were not there."""

    def delete(system, at):
        there = system.get_file_info(at).is_file
        if there:
            system.delete_file(at)
        return there

    return _each_object(objects, delete)


def write_partitions(df: DataFrame, path: str, by: Sequence[str], sort: Sequence[str] = ()) -> None:
    """Replaces the partitions that ``df`` has rows of and leaves the others. A large partition is written by several tasks.

    A reader may see some partitions before others; ``ledger.write`` commits all at once.
    """
    out = df.hint("rebalance", *by)
    if sort:
        out = out.sortWithinPartitions(*by, *sort)
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def upsert_partitions(spark: SparkSession, path: str, new: DataFrame, keys: Sequence[str], by: str) -> None:
    """Upsert into a table of ``ledger``: only partitions with new rows are read and written again, and all of it commits at once."""
    ledger.write(spark, path, new, by, lambda old, rows: replace(old, rows, list(keys)))


def delete_documents(stores: dict[str, DataFrame], targets: DataFrame, key: str = "document_id") -> dict[str, DataFrame]:
    """Every store (objects, chunks, summaries, rows) without the targets."""
    gone = targets.select(key).distinct()
    return {name: store.join(gone, key, "left_anti") for name, store in stores.items()}
