"""Substring search over short texts (names) by an index of their three-letter runs.

``build`` stores three tables: postings (gram, id) in the order of both, so that files and row groups of other
grams are skipped and a gram of many rows is spread over tasks; grams with their numbers of rows; and the
rows themselves, partitioned by block, the hash of their id. A search looks up how many rows hold each gram of
its pattern, intersects the postings of the rarest ``GRAMS`` of them, reads the blocks of what is left,
and verifies with ``ilike``: the result is that of a scan. A pattern without three letters in a row is a scan.

The pattern is that of the listing's search: ``%`` and ``_`` in it are wildcards, a backslash takes the next
character as it is. Letters are compared in lower case. Rows with a null text or id match nothing and
are not stored. Rows of one id are all kept. Ties do not matter; an empty table finds nothing.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallymill.sources.tables import write_partitions

#: Postings of so many grams are intersected; ``ilike`` does the rest.
GRAMS = 4
#: Rows of a block, and the most blocks.
BLOCK_ROWS = 5_000
MOST_BLOCKS = 4096
BLOCK = "id_block"
#: Postings of a page, the least that is read or skipped.
PAGE_ROWS = 1000


class Index(NamedTuple):
    path: str
    text: str
    schema: T.StructType
    blocks: int


def grams(text: Column) -> Column:
    """The distinct runs of three letters of a text in lower case."""
    low = F.lower(text)
    cut = F.transform(F.sequence(F.lit(1), F.length(low) - 2), lambda k: F.substring(low, k, F.lit(3)))
    return F.when(F.length(low) >= 3, F.array_distinct(cut)).otherwise(F.array().cast("array<string>"))


def literals(search: str) -> list[str]:
    """The parts of a search that stand for themselves."""
    parts, now, k = [], "", 0
    while k < len(search):
        c = search[k]
        if c == "\\" and k + 1 < len(search):
            now += search[k + 1]
            k += 1
        elif c in "%_":
            parts.append(now)
            now = ""
        else:
            now += c
        k += 1
    return [p for p in (*parts, now) if p]


def _block(blocks: int) -> Column:
    return F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")


def build(rows: DataFrame, path: str, text: str = "name") -> Index:
    """The index of rows (id, ``text`` and any others) at ``path``."""
    held = rows.where(F.col(text).isNotNull() & F.col("id").isNotNull())
    blocks = min(MOST_BLOCKS, 1 + held.count() // BLOCK_ROWS)
    write_partitions(held.withColumn(BLOCK, _block(blocks)), f"{path}/rows", [BLOCK], ["id"])
    postings = held.select("id", F.explode(grams(F.col(text))).alias("gram")).distinct()
    postings.repartitionByRange("gram", "id").sortWithinPartitions("gram", "id").write.option("parquet.page.row.count.limit", PAGE_ROWS).parquet(f"{path}/postings")
    counts = rows.sparkSession.read.parquet(f"{path}/postings").groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    counts.repartitionByRange("gram").sortWithinPartitions("gram").write.parquet(f"{path}/grams")
    return Index(path, text, rows.schema, blocks)


def stored(spark: SparkSession, index: Index) -> DataFrame:
    return spark.read.schema(T.StructType([*index.schema.fields, T.StructField(BLOCK, T.IntegerType())])).parquet(f"{index.path}/rows")


def rarest(spark: SparkSession, index: Index, search: str) -> list[str] | None:
    """The rarest grams of a search, none if there is a gram that no row has, null if the search has no grams."""
    wanted = sorted({p[k : k + 3] for p in (spark.range(1).select(F.lower(F.lit(x))).first()[0] for x in literals(search)) for k in range(len(p) - 2)})
    if not wanted:
        return None
    found = spark.read.parquet(f"{index.path}/grams").where(F.col("gram").isin(wanted)).collect()  # a row for each gram of the pattern at most
    if len(found) < len(wanted):
        return []
    return [r["gram"] for r in sorted(found, key=lambda r: (r["n"], r["gram"]))][:GRAMS]


def candidates(spark: SparkSession, index: Index, search: str) -> DataFrame | None:
    """The stored rows that hold the rarest grams, from the blocks that have any; null if the search has no grams."""
    few = rarest(spark, index, search)
    if few is None:
        return None
    kind = index.schema["id"].dataType
    if not few:
        return spark.createDataFrame([], index.schema)
    postings = spark.read.parquet(f"{index.path}/postings").where(F.col("gram").isin(few))
    ids = postings.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(few)).select(F.col("id").cast(kind))
    blocks = [r[0] for r in ids.select(_block(index.blocks)).distinct().collect()]  # MOST_BLOCKS at most
    return stored(spark, index).where(F.col(BLOCK).isin(blocks)).join(ids, "id", "left_semi").select(*index.schema.names)


def search(spark: SparkSession, index: Index, pattern: str) -> DataFrame:
    """The rows whose text holds the pattern, as ``ilike('%pattern%')`` finds them."""
    found = candidates(spark, index, pattern)
    rows = stored(spark, index).select(*index.schema.names) if found is None else found
    return rows.where(F.col(index.text).ilike(f"%{pattern}%"))
