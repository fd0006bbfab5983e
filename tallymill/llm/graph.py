"""Connected components of an edge table: contraction within tasks, then alternating large and small stars."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import written

#: Edges that a task contracts at once.
CHUNK = 1_000_000


def contracted(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from every node of (a, b) to the least node of its component among these edges."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    label = np.arange(len(ids))
    while (label[a] != label[b]).any():
        one, two = label[a], label[b]
        np.minimum.at(label, np.maximum(one, two), np.minimum(one, two))
        while (label[label] != label).any():
            label = label[label]
    moved = np.flatnonzero(label != np.arange(len(ids)))
    return ids[moved], ids[label[moved]]


def _contract(edges: DataFrame) -> DataFrame:
    def run(batches):
        held: list[pa.RecordBatch] = []
        size = 0

        def out():
            a, b = (np.concatenate([x.column(c).to_numpy() for x in held]) for c in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array(x) for x in contracted(a, b)], ["a", "b"])

        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= CHUNK:
                yield out()
                held, size = [], 0
        if size:
            yield out()

    return edges.mapInArrow(run, "a long, b long")


def _settled(edges: DataFrame) -> bool:
    """Whether every node has one edge upwards, to a node that has none."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("b", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR up = 1 AND down = 1").isEmpty()


def components(edges: DataFrame, tag: str = "components") -> DataFrame:
    """(id, component) of every node of edges (a, b); component is the smallest id. Rows with nulls are left out.

    Each round replaces edges by edges to smaller neighbours until all are stars.
    Minima are aggregates and joins, so a node of any degree is spread over tasks;
    within a task, chunks of edges are contracted before they are sent.
    """
    now = written(_contract(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b")).distinct(), tag)
    while not _settled(now):
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        pairs = small.select("a", F.col("m").alias("b")).union(small.select(F.col("b").alias("a"), F.col("m").alias("b")))
        now = written(_contract(pairs.where("a <> b")).distinct(), tag)
    roots = now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).union(roots)
