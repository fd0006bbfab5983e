"""Approximate vector search by an inverted file: points in lists by their nearest centroid, of which a search reads a few.

``fit`` finds the centroids from a bounded sample of ``SAMPLE`` points, those with the smallest hash of their id,
so the same at every run, and measures on the sample how many lists a search must read for its recall: a few where
vectors are clustered, most of them where they are not. ``build`` assigns every point and stores the collection partitioned by list. A
search reads the lists of the centroids nearest to its query, partition pruning leaves the others unread,
and what it reads is ranked exactly. With as many probes as lists the result is that of the exact search.

Scores are cosines. Points without a vector are left out, as are those whose vectors have another length than
the centroids. A zero vector has score 0 and goes to the first list. Ids are numbers. Of equal scores the
smaller id comes first. An empty collection has one list and finds nothing.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallymill.sources.tables import write_partitions

from . import vectors as vc

#: Points that centroids are fitted on, and the most lists: both bounds hold whatever the collection's size.
SAMPLE = 20_000
MOST_LISTS = 2048
ROUNDS = 12
#: Share of the nearest that a search finds, as measured on the sample when the index is built.
RECALL = 0.95
LIST = "vector_list"
_ROWS = 1024


class Index(NamedTuple):
    """Where the points are, the centroids (unit vectors, a row for each list), and how many lists a search reads."""

    path: str
    centroids: np.ndarray
    probes: int


def unit(matrix: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, norm, out=np.zeros_like(matrix), where=norm > 0)


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Unit vectors of a column of lists that all have ``dims`` numbers."""
    return unit(column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(column), dims))


def usable(points: DataFrame, dims: int) -> DataFrame:
    """Points whose vectors have ``dims`` numbers and no nulls among them."""
    return points.where((F.size("embedding") == dims) & ~F.exists("embedding", lambda x: x.isNull()))


def nearest(matrix: np.ndarray, centroids: np.ndarray, n: int = 1) -> np.ndarray:
    """Of each row, the lists of the n nearest centroids, the nearest first."""
    return np.argsort(-(matrix @ centroids.T), axis=1, kind="stable")[:, :n]


def k_means(x: np.ndarray, lists: int, rounds: int = ROUNDS, seed: int = 7) -> np.ndarray:
    """Unit centroids of unit vectors; one that loses all its points takes the point that is worst off."""
    rng = np.random.default_rng(seed)
    distinct = np.unique(x, axis=0)
    centroids = distinct[rng.permutation(len(distinct))[:lists]]
    for _ in range(rounds):
        best, near = np.empty(len(x), np.int64), np.empty(len(x))
        for at in range(0, len(x), _ROWS):
            score = x[at : at + _ROWS] @ centroids.T
            best[at : at + _ROWS], near[at : at + _ROWS] = score.argmax(1), score.max(1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, best, x)
        empty = np.flatnonzero(np.bincount(best, minlength=len(centroids)) == 0)
        sums[empty] = x[np.argsort(near, kind="stable")[: len(empty)]]
        new = unit(sums)
        if np.allclose(new, centroids):
            break
        centroids = new
    return centroids


def probes_needed(x: np.ndarray, centroids: np.ndarray, recall: float, k: int = 10, queries: int = 256) -> int:
    """The fewest lists in which that share of the k nearest of some vectors of ``x`` are found.

    A larger collection has nearer neighbours, which fewer lists hold, so a sample asks for too many rather than too few.
    """
    asked = np.arange(0, len(x), max(1, len(x) // queries))
    near = x[asked] @ x.T
    near[np.arange(len(asked)), asked] = -np.inf
    best = np.argpartition(-near, min(k, len(x) - 1), axis=1)[:, :k]
    order = nearest(x[asked], centroids, len(centroids))
    place = np.empty_like(order)
    place[np.arange(len(asked))[:, None], order] = np.arange(len(centroids))
    found = np.bincount(place[np.arange(len(asked))[:, None], nearest(x, centroids)[:, 0][best]].ravel(), minlength=len(centroids))
    return int(np.searchsorted(np.cumsum(found), recall * found.sum()) + 1)


def fit(points: DataFrame, lists: int | None = None, sample: int = SAMPLE, recall: float = RECALL) -> tuple[np.ndarray, int]:
    """Centroids for (id, embedding), by default as many as the square root of the number of points, ``MOST_LISTS`` at most; and
    how many of them a search must probe for a recall."""
    held = points.where("embedding IS NOT NULL AND size(embedding) > 0")
    n = held.count()
    if not n:
        return np.zeros((1, 1)), 1
    rows = held.select("id", "embedding").orderBy(F.xxhash64("id"), "id").limit(sample).toArrow().column("embedding").combine_chunks()
    sizes = np.diff(rows.offsets.to_numpy())
    dims = int(np.bincount(sizes).argmax())  # a vector of another length is an error in the data
    kept = rows.filter(pa.array(sizes == dims))
    x = kept.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dims)
    x = unit(x[~np.isnan(x).any(1)])
    if not len(x):
        return np.zeros((1, dims)), 1
    centroids = k_means(x, min(MOST_LISTS, lists or max(1, round(math.sqrt(n)))))
    return centroids, probes_needed(x, centroids, recall)


def with_list(schema: T.StructType) -> T.StructType:
    return schema if LIST in schema.names else T.StructType([*schema.fields, T.StructField(LIST, T.IntegerType())])


def assigned(points: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Points with their list."""
    dims = centroids.shape[1]
    rows = usable(points, dims)
    at = rows.columns.index("embedding")
    shared = points.sparkSession.sparkContext.broadcast(centroids)  # MOST_LISTS rows at most

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, _ROWS):
                part = batch.slice(k, _ROWS)
                lists = nearest(_matrix(part.column(at), dims), shared.value)[:, 0]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(lists.astype(np.int32))], [*part.schema.names, LIST])

    return rows.mapInArrow(run, with_list(rows.schema))


def build(points: DataFrame, path: str, lists: int | None = None, sample: int = SAMPLE, recall: float = RECALL) -> Index:
    """The index of points (id, embedding and any payload), stored at ``path`` partitioned by list, which rebalancing splits among tasks."""
    centroids, probes = fit(points, lists, sample, recall)
    write_partitions(assigned(points, centroids), path, [LIST])
    return Index(path, centroids, probes)


def points_of(spark: SparkSession, index: Index, schema: T.StructType, lists: Sequence[int] | None = None) -> DataFrame:
    """The stored points (schema: that of the points), of some lists or of all."""
    rows = spark.read.schema(with_list(schema)).parquet(index.path)
    return rows if lists is None else rows.where(F.col(LIST).isin([int(x) for x in lists]))


def search(spark: SparkSession, index: Index, points_schema, query: Sequence[float], k: int = 5, probes: int | None = None, **filters) -> DataFrame:
    """The k best points of the probed lists, with score and distance; ``filters`` are those of ``vectors.payload_filter``.

    When a filter leaves fewer than k points in them, twice as many lists are read, until there are k or all lists are read.
    """
    probes = probes or index.probes
    order = nearest(unit(np.array([query], np.float64)), index.centroids, len(index.centroids))[0]
    while True:
        rows = points_of(spark, index, points_schema, order[:probes])
        found = vc.top_k(vc.payload_filter(rows, **filters) if filters else rows, query, k)
        if probes >= len(order) or found.count() >= k:
            return found
        probes *= 2


def search_each(spark: SparkSession, index: Index, points_schema, queries: DataFrame, k: int, probes: int | None = None, group: str | None = None) -> DataFrame:
    """query_id[, group], rank, id and score of the k best points (of each group) for every query (id, embedding); a query is no hit of its own.

    Queries go to the lists that they probe; queries and points of a list meet in blocks, of whose scores only the k best of a
    query and group leave the task.
    """
    dims, name, probes = index.centroids.shape[1], group or "group", probes or index.probes
    shared = spark.sparkContext.broadcast(index.centroids)

    def probe(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                part = batch.slice(at, _ROWS)
                lists = nearest(_matrix(part.column(1), dims), shared.value, probes)
                row = np.repeat(np.arange(part.num_rows), lists.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(lists.ravel().astype(np.int32)), *(c.take(pa.array(row)) for c in part.columns)], [LIST, "id", "embedding"])

    asked = usable(queries.select(F.col("id").cast("long").alias("id"), "embedding"), dims)
    asked = asked.mapInArrow(probe, asked.select(F.lit(0).alias(LIST), "id", "embedding").schema)
    left = vc.blocks_by(asked.repartition(LIST), LIST, dims)
    right = vc.blocks_by(points_of(spark, index, points_schema), LIST, dims, group)
    out = vc.meet(left, right, LIST, dims, k, name)
    return out if group else out.drop(name)


def recall(found: DataFrame, exact: DataFrame, keys: Sequence[str] = ("query_id",)) -> DataFrame:
    """For each query, how many exact hits there are (n_exact) and how many of them, or points with equal scores, were found (n_found).

    ``found`` and ``exact`` have the keys, id and score.
    """
    last = exact.groupBy(*keys).agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("n_exact"))
    good = found.join(last, list(keys)).where("score >= least").groupBy(*keys).agg(F.count(F.lit(1)).alias("hits"))
    return last.join(good, list(keys), "left").select(*keys, "n_exact", F.least(F.coalesce("hits", F.lit(0)), F.col("n_exact")).alias("n_found"))
