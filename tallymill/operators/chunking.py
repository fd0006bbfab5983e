"""Chunking of texts: fixed size, sentences, paragraphs, and groups of table rows.

A chunk begins where the one before it ended, so a text is walked from its start;
the walks are small functions over one text, applied in Arrow batches and exploded.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallymill.functions.arrow import parts

SIZE, OVERLAP = 1000, 200
ROWS_PER_CHUNK = 25


def _windows(n: int, spaces: list[int], size: int, overlap: int) -> Iterator[slice]:
    """Windows over n characters: each ends at the last space in its second half, or else is full, and the next one reaches back by the overlap."""
    start = 0
    while start < n:
        stop = start + size
        if stop < n:
            last = bisect_left(spaces, stop) - 1
            if last >= 0 and spaces[last] > start + size // 2:
                stop = spaces[last]
        yield slice(start, stop)
        back = stop - overlap
        start = back if back > start else stop


def fixed(text: str, size: int = SIZE, overlap: int = OVERLAP) -> Iterator[str]:
    """Pieces of about ``size`` characters that end between words. The last one may hold overlap alone."""
    spaces = [m.start() for m in re.finditer(" ", text)]
    return filter(None, (text[w].strip() for w in _windows(len(text), spaces, size, overlap)))


def _packed(parts: Iterator[str], size: int, joiner: str, carry: Callable[[list[str]], list[str]]) -> Iterator[str]:
    """Parts joined up to ``size`` characters (joiners do not count); ``carry`` gives what the next chunk repeats."""
    held: list[str] = []
    for part in parts:
        if held and sum(map(len, held)) + len(part) > size:
            yield joiner.join(held)
            held = carry(held)
        held.append(part)
    if held:
        yield joiner.join(held)


def sentences(text: str, size: int = SIZE, overlap: int = OVERLAP) -> Iterator[str]:
    def tail(held: list[str]) -> list[str]:
        room, first = overlap, len(held)
        while first and len(held[first - 1]) <= room:
            first -= 1
            room -= len(held[first])
        return held[first:]

    return _packed(iter(re.split(r"(?<=[.!?])\s+", text)), size, " ", tail)


def paragraphs(text: str, size: int = SIZE, overlap: int = OVERLAP) -> Iterator[str]:
    """Paragraphs longer than a chunk are cut by size on their own."""

    def last(held: list[str]) -> list[str]:
        return held[-1:] if len(held[-1]) <= overlap else []

    run: list[str] = []
    for part in filter(None, map(str.strip, re.split(r"\n\s*\n", text))):
        if len(part) > size:
            yield from _packed(iter(run), size, "\n\n", last)
            run = []
            yield from fixed(part, size, overlap)
        else:
            run.append(part)
    yield from _packed(iter(run), size, "\n\n", last)


STRATEGIES = {"fixed": fixed, "sentence": sentences, "paragraph": paragraphs}


def chunk_batches(batches: Iterable[pa.RecordBatch], cut: Callable[[str], Iterator[str]]) -> Iterator[pa.RecordBatch]:
    """Batches with the chunks of the last column's texts in its place. Only a part of a batch's texts, by bytes, are Python objects at once."""
    for batch in batches:
        for rows in parts(batch.column(batch.num_columns - 1)):
            part = batch.slice(rows.start, rows.stop - rows.start)
            chunks = [list(cut(t)) if t and t.strip() else [] for t in part.column(part.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(chunks, pa.list_(pa.string()))], [*batch.schema.names[:-1], "chunks"])


def chunk_texts(docs: DataFrame, strategy: str = "fixed", size: int = SIZE, overlap: int = OVERLAP, text: str = "text") -> DataFrame:
    """One row for each chunk, with chunk_index and chunk in place of the text. Blank texts have none; an unknown strategy is ``fixed``."""
    cut = STRATEGIES.get(strategy, fixed)
    others = [c for c in docs.columns if c != text]
    schema = T.StructType([*(docs.schema[c] for c in others), T.StructField("chunks", T.ArrayType(T.StringType()))])

    def run(batches):
        return chunk_batches(batches, lambda t: cut(t, size, overlap))

    return docs.select(*others, text).mapInArrow(run, schema).select(*others, F.posexplode("chunks").alias("chunk_index", "chunk"))


def row_groups(rows: DataFrame, keys: list[str], per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """Markdown chunks of table rows (keys, sheet, header, row_idx, cells): the header on each, row ranges in the heading of long sheets."""
    cell = lambda c: F.regexp_replace(F.replace(F.coalesce(c, F.lit("")), F.lit("|"), F.lit("\\|")), r"[\r\n]+", " ")
    line = lambda a: F.concat(F.lit("| "), F.array_join(F.transform(a, cell), " | "), F.lit(" |"))
    width = F.size("header")
    padded = F.slice(F.concat("cells", F.array_repeat(F.lit(""), width)), F.lit(1), width)
    numbered = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys, "sheet").orderBy("row_idx"))).withColumn("_line", line(padded))
    numbered = numbered.withColumn("_all", F.count(F.lit(1)).over(Window.partitionBy(*keys, "sheet"))).withColumn("_g", F.floor((F.col("_n") - 1) / per_chunk))
    held = numbered.groupBy(*keys, "sheet", "_g").agg(F.first("header").alias("header"), F.first("_all").alias("n"), F.min("_n").alias("row_start"), F.max("_n").alias("row_end"), F.array_sort(F.collect_list(F.struct("_n", "_line"))).alias("lines"))
    heading = F.concat(F.lit("## Sheet: "), "sheet", F.when(F.col("n") > per_chunk, F.format_string(" (rows %d–%d)", "row_start", "row_end")).otherwise(""))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |"))
    body = F.concat_ws("\n", line(F.col("header")), rule, F.array_join(F.transform("lines", lambda x: x["_line"]), "\n"))
    return held.select(*keys, "sheet", F.col("_g").cast("int").alias("chunk_index"), "row_start", "row_end", F.concat(heading, F.lit("\n\n"), body).alias("chunk"))


def chunk_payload(base: Column, document: Column, chunk: Column) -> Column:
    """Metadata maps merged, the chunk's values before the document's before the base ones; keys that begin with _ are dropped."""

    def over(low: Column, high: Column) -> Column:
        return F.map_concat(F.map_filter(low, lambda k, _: ~F.map_contains_key(high, k)), high)

    return F.map_filter(over(over(base, document), chunk), lambda k, _: ~F.startswith(k, F.lit("_")))
