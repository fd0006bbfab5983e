"""A training corpus from raw documents, in stages of one operator each.

Every stage works on all rows that its predecessor kept; each result is a Parquet
table in the shared folder, which the next stage reads.

Null or empty texts and null ids pass the filtering stages as their operators say:
the classifier scores empty texts and keeps null ids, the other three leave both.
The mix takes tokens, so it leaves rows without any out. Repeated rows are decided
alike, and very long texts are taken whole. An empty table stays empty in every
stage; all stages but the last hand on all columns, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallymill.llm import decontamination, jaccard_join, line_dedup, mixing, quality
from tallymill.llm.queries import table
from tallymill.llm.scratch import written


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"), table(spark, sf_dir, "pages"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that are near duplicates of earlier ones."""
    return line_dedup.dedup_lines(docs)


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose five-word shingles are similar by 0.8 or more."""
    return jaccard_join.keep_one(docs, width=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents into which no benchmark item leaks."""
    return decontamination.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, with the tokens to take from each."""
    return mixing.mix_sources(docs)


STAGES = [
    ("quality classifier", keep_good),
    ("line dedup", dedup_lines),
    ("n-gram Jaccard join", keep_one),
    ("benchmark decontamination", decontaminate),
    ("mixing sources to target weights", mix),
]
#: The classifier's fit is not SQL; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of the whole ``documents`` table."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        docs = written(stage(spark, docs, sf_dir), f"stage-{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
