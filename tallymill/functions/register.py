"""Functions that SQL text can call, and the schema of the library's views."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallymill.functions import text
from tallymill.operators.chunking import STRATEGIES
from tallymill.sources.pages import markdown


@F.pandas_udf(T.ArrayType(T.StringType()))
def chunk_text(value: pd.Series, strategy: pd.Series, size: pd.Series, overlap: pd.Series) -> pd.Series:
    """Chunks of each text, as ``chunk_texts`` makes them."""
    cut = lambda t, s, n, o: list(STRATEGIES.get(s, STRATEGIES["fixed"])(t, n, o)) if t and t.strip() else []
    return pd.Series([cut(*row) for row in zip(value, strategy, size, overlap, strict=True)])


def register(spark: SparkSession) -> None:
    """Arrow functions: ``to_ascii(name)``, ``html_to_markdown(html)``, and ``chunk_text(text, strategy, size, overlap)``, an array."""
    spark.udf.register("to_ascii", text.to_ascii)
    spark.udf.register("html_to_markdown", markdown)

    spark.udf.register("chunk_text", chunk_text)


def views(spark: SparkSession, sf_dir: str, names: list[str]) -> None:
    for name in names:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)
