"""A vector collection as a table: filtered exact top-k, upserts, deletes, payload patches, statistics.

Collections are tables with ``tenant_id``, ``document_id``, ``chunk_index``, ``text``, ``embedding`` and payload
columns; partition them by ``tenant_id`` and every query here reads one partition.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymill.functions import vectors as v


def payload_filter(points: DataFrame, tenant_id: int, document_ids: Sequence | None = None, document_types: Sequence[str] | str | None = None, kind: str | None = None) -> DataFrame:
    """Points of a tenant; empty or missing lists do not filter."""
    out = points.where(F.col("tenant_id") == tenant_id)
    if document_ids:
        out = out.where(F.col("document_id").isin(list(document_ids)))
    if document_types:
        out = out.where(F.col("document_type").isin([document_types] if isinstance(document_types, str) else list(document_types)))
    if kind:
        out = out.where(F.col("type") == kind)
    return out


def top_k(points: DataFrame, query: Sequence[float], k: int = 5, metric: str = "cosine") -> DataFrame:
    """The k best points with score and distance; of equal scores, the smaller id. The sort keeps k rows a task."""
    s = F.round(v.score_of(F.col("embedding"), query, metric), 6)
    return points.withColumn("score", s).withColumn("distance", F.round(v.distance(F.col("score")), 6)).orderBy(F.desc("score"), "id").limit(k)


def ranked(hits: DataFrame) -> DataFrame:
    """Hits with their rank; for the k rows of a search."""
    return hits.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")).cast("long"))


_BLOCK_ROWS = 2048
_SCORES = 1 << 18


def _blocks(points: DataFrame, group: str | None, dims: int) -> DataFrame:
    """Vectors of ``dims`` numbers of ``points`` (id, embedding[, group]) packed in rows of at most ``_BLOCK_ROWS``."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, _BLOCK_ROWS):
                part = batch.slice(at, _BLOCK_ROWS)
                matrix = part.column(1).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(part.num_rows, dims)
                norm = np.linalg.norm(matrix, axis=1, keepdims=True)
                packed = np.divide(matrix, norm, out=np.zeros_like(matrix), where=norm > 0).tobytes()
                groups = part.column(2).cast(pa.int64()).to_pylist() if group else [0] * part.num_rows
                yield pa.RecordBatch.from_arrays([pa.array([part.column(0).to_pylist()], pa.list_(pa.int64())), pa.array([groups], pa.list_(pa.int64())), pa.array([packed], pa.binary())], ["ids", "groups", "matrix"])

    rows = points.where((F.size("embedding") == dims) & ~F.exists("embedding", lambda x: x.isNull()))
    return rows.select(F.col("id").cast("long"), "embedding", *([group] if group else [])).mapInArrow(run, "ids array<long>, groups array<long>, matrix binary")


def best_of_block(qi: np.ndarray, q: np.ndarray, pi: np.ndarray, groups: np.ndarray, p: np.ndarray, k: int, group: str, itself: bool = False) -> Iterator[pa.RecordBatch]:
    """query_id, group, id and score of the k best points p of each group for every query q; not of the query ``itself`` unless told. At most ``_SCORES`` scores are held at once."""
    owns = [(int(value), own[np.argsort(pi[own], kind="stable")]) for value in np.unique(groups) for own in [np.flatnonzero(groups == value)]]
    step = max(1, _SCORES // max(1, len(pi)))
    for at in range(0, len(qi), step):
        ids = qi[at : at + step]
        score = np.round(q[at : at + step] @ p.T, 6)
        if not itself:
            score[ids[:, None] == pi] = -np.inf
        rows = []
        for value, own in owns:
            best = np.argsort(-score[:, own], axis=1, kind="stable")[:, :k]
            rows += [(int(ids[r]), value, int(pi[own[c]]), float(score[r, own[c]])) for r in range(len(ids)) for c in best[r] if np.isfinite(score[r, own[c]])]
        cols = list(zip(*rows, strict=True)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.float64())], ["query_id", group, "id", "score"])


def best_of_pairs(batches: Iterable[pa.RecordBatch], dims: int, k: int, group: str, itself: bool = False) -> Iterator[pa.RecordBatch]:
    """``best_of_block`` for each pair of blocks (qi, q, pi, groups, p); the matrices are read where they lie."""
    for batch in batches:
        for qi, q, pi, g, p in zip(*(batch.column(c) for c in range(5)), strict=True):
            yield from best_of_block(np.array(qi.as_py()), np.frombuffer(q.as_buffer()).reshape(len(qi), dims), np.array(pi.as_py()), np.array(g.as_py()), np.frombuffer(p.as_buffer()).reshape(len(pi), dims), k, group, itself)


def top_k_each(points: DataFrame, queries: DataFrame, k: int, group: str) -> DataFrame:
    """query_id, group, rank, id and cosine score of the k best points of each group for every query (id, embedding); a query is no hit of its own.

    Queries and points travel in blocks. Each block of points is in one of as many shares as there are shuffle
    partitions, and each block of queries goes to all shares; each pair is one matrix product, of which only the k best of
    each query and group leave the task. Vectors of another length than the first query's are left out, as are those with nulls.
    """
    dims = dimensions(queries)
    shares = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        return best_of_pairs(batches, dims, k, group)

    every = F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share")
    q = _blocks(queries, None, dims).select(F.col("ids").alias("qi"), F.col("matrix").alias("q"), every)
    p = _blocks(points, group, dims).select(F.col("ids").alias("pi"), "groups", F.col("matrix").alias("p"), F.pmod(F.xxhash64("ids"), F.lit(shares)).cast("int").alias("share"))
    found = p.join(q, "share").select("qi", "q", "pi", "groups", "p").mapInArrow(run, f"query_id long, {group} long, id long, score double")
    w = Window.partitionBy("query_id", group).orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def blocks_by(rows: DataFrame, key: str, dims: int, group: str | None = None) -> DataFrame:
    """Unit vectors of rows (key, id, embedding[, group]) in blocks of one key: key, ids, groups and the matrix."""

    def run(batches):
        one = lambda column: pa.ListArray.from_arrays(pa.array([0, len(column)], pa.int32()), column)
        for batch in batches:
            keys = batch.column(0).to_numpy()
            cuts = np.flatnonzero(np.diff(keys, prepend=keys[:1] - 1)) if len(keys) else []
            for first, last in zip(cuts, [*cuts[1:], len(keys)], strict=True):
                for k in range(first, last, _BLOCK_ROWS):
                    part = batch.slice(k, min(_BLOCK_ROWS, last - k))
                    matrix = part.column(2).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(part.num_rows, dims)
                    norm = np.linalg.norm(matrix, axis=1, keepdims=True)
                    packed = np.divide(matrix, norm, out=np.zeros_like(matrix), where=norm > 0).tobytes()
                    groups = part.column(3) if group else pa.array(np.zeros(part.num_rows, np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array([int(keys[k])], pa.int64()), one(part.column(1)), one(groups), pa.array([packed], pa.binary())], [key, "ids", "groups", "matrix"])

    kept = rows.where((F.size("embedding") == dims) & ~F.exists("embedding", lambda x: x.isNull()) & F.col(key).isNotNull() & F.col("id").isNotNull())
    cols = kept.select(F.col(key).cast("long").alias(key), F.col("id").cast("long").alias("id"), "embedding", *([F.col(group).cast("long")] if group else []))
    return cols.sortWithinPartitions(key).mapInArrow(run, f"{key} long, ids array<long>, groups array<long>, matrix binary")


def meet(left: DataFrame, right: DataFrame, key: str, dims: int, k: int, group: str = "group", itself: bool = False) -> DataFrame:
    """query_id, group, id, score and rank of the k best points (blocks ``right``) of each query (blocks ``left``) of the same key."""

    def run(batches):
        return best_of_pairs(batches, dims, k, group, itself)

    q = left.select(key, F.col("ids").alias("qi"), F.col("matrix").alias("q"))
    p = right.select(key, F.col("ids").alias("pi"), "groups", F.col("matrix").alias("p"))
    found = q.join(p, key).select("qi", "q", "pi", "groups", "p").mapInArrow(run, f"query_id long, {group} long, id long, score double")
    w = Window.partitionBy("query_id", group).orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def dimensions(queries: DataFrame) -> int:
    """The length of the first vector, 0 without any; vectors of another length are left out of a search."""
    first = queries.where("embedding IS NOT NULL").select(F.size("embedding")).first()
    return first[0] if first else 0


def top_k_own(points: DataFrame, queries: DataFrame, k: int, own: str = "tenant_id") -> DataFrame:
    """query_id, rank, id and cosine score of the k best points for every query (id, embedding) among the points of its own tenant.

    Blocks of a tenant's queries meet blocks of its points; the blocks of a large tenant are dealt out by adaptive execution.
    """
    dims = dimensions(queries)
    asked = blocks_by(queries.repartition(own), own, dims)
    return meet(asked, blocks_by(points, own, dims), own, dims, k, itself=True).drop("group")


def over_fetch(k: int) -> int:
    return max(3 * k, 5)


def point_id(document: str = "document_id", index: str = "chunk_index"):
    """The same chunk has the same id, so writing again replaces it."""
    return F.sha2(F.concat_ws("_chunk_", F.col(document).cast("string"), F.col(index).cast("string")), 256)


def upsert(points: DataFrame, new: DataFrame) -> DataFrame:
    """New points in place of those with the same id, in the same columns."""
    return points.join(new.select("id"), "id", "left_anti").unionByName(new.select(*points.columns))


def replace_document(points: DataFrame, new: DataFrame) -> DataFrame:
    """All points of the new points' documents go, so processing a document again leaves nothing old."""
    return points.join(new.select("tenant_id", "document_id").distinct(), ["tenant_id", "document_id"], "left_anti").unionByName(new.select(*points.columns))


def delete(points: DataFrame, targets: DataFrame) -> DataFrame:
    """Without the points of (tenant_id, document_id) targets."""
    return points.join(targets.select("tenant_id", "document_id").distinct(), ["tenant_id", "document_id"], "left_anti")


def scroll(points: DataFrame, tenant_id: int, document_id) -> DataFrame:
    return points.where((F.col("tenant_id") == tenant_id) & (F.col("document_id") == document_id)).orderBy("chunk_index")


def patch(points: DataFrame, changes: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Payload columns take the changes' values where those are not null, by tenant and document. Other columns may have any names."""
    keys = ["tenant_id", "document_id"]
    p = points.select(*keys, F.struct("*").alias("point"))
    joined = p.join(changes.select(*keys, F.struct(*columns).alias("change")), keys, "left")
    return joined.select(*(F.coalesce(f"change.`{c}`", f"point.`{c}`").alias(c) if c in columns else F.col(f"point.`{c}`").alias(c) for c in points.columns))


def statistics(points: DataFrame, keys: Sequence[str] = ("tenant_id",)) -> DataFrame:
    """Points and distinct documents, exact."""
    return points.groupBy(*keys).agg(F.count(F.lit(1)).alias("total_points"), F.countDistinct("document_id").alias("unique_documents"))


def hits_with_ids(hits: DataFrame, documents: DataFrame) -> DataFrame:
    """Hits with the database id of their document; null if there is none."""
    ids = documents.select(F.col("doc_id").alias("document_id"), F.col("id").alias("document_db_id"))
    return hits.join(ids, "document_id", "left")


def search(points: DataFrame, documents: DataFrame, query: Sequence[float], tenant_id: int, wanted: Sequence[int] | None = None, k: int = 5, strict: bool = True) -> DataFrame:
    """Top-k within documents given by database id. Ids that resolve to nothing find nothing; with
    ``strict=False`` they do not filter, so the whole tenant is searched."""
    pool = payload_filter(points, tenant_id)
    if wanted:
        uuids = documents.where(F.col("id").isin(list(wanted))).select(F.col("doc_id").alias("document_id"))
        if strict or not uuids.isEmpty():
            pool = pool.join(uuids, "document_id", "left_semi")
    return top_k(pool, query, k)


def payload(*columns: str) -> Column:
    """Payload as JSON; columns that are null are left out."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "true"})


def chunk_points(chunks: DataFrame) -> DataFrame:
    """Points of chunks (tenant_id, document_id, chunk_index, text, embedding and more): ids that the chunk fixes, and a payload."""
    rest = [c for c in chunks.columns if c != "embedding"]
    return chunks.select(point_id().alias("id"), *chunks.columns, payload(*rest).alias("payload"))


def image_points(images: DataFrame) -> DataFrame:
    """Points of images (tenant_id, document_id, page_number, combined_text, caption, embedding): type image, numbered within
    their document, with the text as caption where there is none."""
    w = Window.partitionBy("tenant_id", "document_id").orderBy("page_number", "combined_text")
    rows = images.withColumn("image_index", F.row_number().over(w) - 1).withColumn("type", F.lit("image")).withColumn("caption", F.coalesce("caption", "combined_text"))
    rest = [c for c in rows.columns if c != "embedding"]
    return rows.select(F.sha2(F.concat_ws("_image_", F.col("document_id").cast("string"), F.col("image_index").cast("string")), 256).alias("id"), *rows.columns, payload(*rest).alias("payload"))


def summary_points(summaries: DataFrame) -> DataFrame:
    """One point for each document (tenant_id, document_id, summary_text, summary, doc_category, doc_date_range, embedding)."""
    rest = [c for c in summaries.columns if c != "embedding"]
    return summaries.select(F.sha2(F.concat(F.col("document_id").cast("string"), F.lit("_summary")), 256).alias("id"), *summaries.columns, payload(*rest).alias("payload"))


def drop_tenant(points: DataFrame, tenant_id: int) -> DataFrame:
    return points.where(F.col("tenant_id") != tenant_id)


def relevant_documents(summaries: DataFrame, query: Sequence[float], tenant_id: int, k: int = 5) -> DataFrame:
    """The documents whose summaries are nearest, with their category, dates and summary; scores to four places."""
    hits = ranked(top_k(payload_filter(summaries, tenant_id), query, k))
    text = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return hits.select("rank", "document_id", *map(text, ("document_name", "doc_category", "doc_date_range", "summary")), F.bround("score", 4).alias("score"))
