"""Shared scratch space: every intermediate table is a Parquet table there.

The folder is the session's ``spark.checkpoint.dir``. Only a session whose tasks
run in the driver's own machine (``local[...]``, as in unit tests) may leave it
unset: a temporary folder takes its place there.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="tallymill-")
        spark.conf.set("spark.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def fresh(spark: SparkSession, tag: str) -> str:
    return f"{folder(spark)}/{tag}-{uuid.uuid4().hex}"


#: While a table is written, batches are small and so are its row groups: columns of texts and packed sets are wide.
_SMALL = {"spark.sql.execution.arrow.maxBytesPerBatch": "8m", "spark.sql.parquet.columnarReaderBatchSize": "512"}
_ROW_GROUP = 16 << 20


def written(df: DataFrame, tag: str, compression: str = "zstd") -> DataFrame:
    """``df`` as a table in the shared folder: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = fresh(spark, tag)
    before = {k: spark.conf.get(k) for k in _SMALL}
    try:
        for k, v in _SMALL.items():
            spark.conf.set(k, v)
        df.write.option("compression", compression).option("parquet.block.size", _ROW_GROUP).parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path)
