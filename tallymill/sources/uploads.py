"""Uploaded files as a data source: ``spark.read.format("uploads")`` and ``spark.readStream.format("uploads")``.

A row is a file: path, kind (its extension in lower case), length, modified, text, rows and error. Text and Markdown files
have their stripped text, DOCX files their paragraphs and cells, workbooks their rows (``workbook_rows`` makes them
those of ``files.read_xlsx``). A file that is damaged, or of a kind without a reader here, has an error and no text.

The driver lists files and deals them out by size: partitions of about ``partition_bytes``, larger files alone. Options: ``path`` (a
folder, searched with its subfolders), ``kinds`` (extensions, comma-separated; others are not listed), ``partition_bytes``.
Folders are reached through Arrow's file systems: local and mounted paths, hdfs, s3 and gs.

As a stream, each batch holds the files whose time of modification is after those of the batch before. Files count once they
are ``settle_ms`` old, so that files of one moment come together; they must be complete by then and not change later.
Hidden files (with a dot or an underscore first) are passed over. An empty or missing folder has no rows.
"""

from __future__ import annotations

import time
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

FORMAT = "uploads"
SCHEMA = "path string, kind string, length long, modified timestamp, text string, rows array<struct<sheet: string, sheet_no: int, row_idx: bigint, cells: array<string>>>, error string"
_TYPES = pa.schema([
    ("path", pa.string()), ("kind", pa.string()), ("length", pa.int64()), ("modified", pa.timestamp("us", "UTC")), ("text", pa.string()),
    ("rows", pa.list_(pa.struct([("sheet", pa.string()), ("sheet_no", pa.int32()), ("row_idx", pa.int64()), ("cells", pa.list_(pa.string()))]))), ("error", pa.string()),
])


class Files(InputPartition):
    """Files (path, length, modified in microseconds) that one task reads."""

    def __init__(self, files: list[tuple[str, int, int]]):
        super().__init__(files)


def extension_of(path: str) -> str:
    name = path.rsplit("/", 1)[-1]
    return f".{name.rsplit('.', 1)[1].lower()}" if "." in name else ""


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if path.startswith("file:") and not path.startswith("file://"):
        path = f"file://{path[5:]}"
    return fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))


def listed(folder: str, kinds: set[str] | None = None) -> list[tuple[str, int, int]]:
    system, at = opened(folder)
    found = system.get_file_info(fs.FileSelector(at, recursive=True, allow_not_found=True))
    hidden = lambda p: any(part[:1] in "._" for part in p[len(at) :].strip("/").split("/"))
    rows = [(f.path, f.size, (f.mtime_ns or 0) // 1000) for f in found if f.type == fs.FileType.File and not hidden(f.path)]
    return sorted(r for r in rows if kinds is None or extension_of(r[0]) in kinds)


def dealt(files: list[tuple[str, int, int]], most: int) -> list[Files]:
    """Consecutive files in groups of about ``most`` bytes."""
    out: list[list] = []
    size = most + 1
    for f in files:
        if size + f[1] > most:
            out.append([])
            size = 0
        out[-1].append(f)
        size += f[1]
    return [Files(x) for x in out]


def parsed(path: str, data: bytes) -> dict:
    """text, rows and error of a file's content."""
    from tallymill.sources import files

    kind = extension_of(path)
    try:
        if kind in files.TEXT:
            return {"text": data.decode("utf-8", "replace").strip(), "rows": None, "error": None}
        if kind == ".docx":
            paragraphs, cells, _ = files.docx_parts(data)
            return {"text": "\n\n".join([*paragraphs, *cells]), "rows": None, "error": None}
        if kind == ".xlsx":
            order: dict[str, int] = {}
            rows = [{"sheet": s, "sheet_no": order.setdefault(s, len(order)), "row_idx": k, "cells": c} for s, k, c in files.xlsx_rows(data)]
            return {"text": None, "rows": rows, "error": None}
        raise ValueError(f"no reader for {kind}")
    except Exception as e:  # noqa: BLE001  whatever a damaged file raises
        return {"text": None, "rows": None, "error": f"{type(e).__name__}: {e}"[:200]}


class _Reading:
    """What both readers share: options, and how a partition is read."""

    def __init__(self, options: dict):
        self.folder = options["path"]
        self.kinds = {k.strip().lower() for k in options["kinds"].split(",")} if options.get("kinds") else None
        self.most = int(options.get("partition_bytes", 64 << 20))
        self.settle = int(options.get("settle_ms", 2000)) * 1000

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        system, _ = opened(self.folder)
        for path, length, modified in partition.value:
            with system.open_input_stream(path) as f:
                row = parsed(path, f.read())
            yield pa.RecordBatch.from_pylist([{"path": path, "kind": extension_of(path), "length": length, "modified": modified, **row}], _TYPES)


class UploadsReader(_Reading, DataSourceReader):
    def partitions(self) -> list[Files]:
        return dealt(listed(self.folder, self.kinds), self.most) or [Files([])]


class UploadsStreamReader(_Reading, DataSourceStreamReader):
    """Offsets are times of modification in microseconds."""

    def initialOffset(self) -> dict:
        return {"modified": -1}

    def latestOffset(self) -> dict:
        settled = int(time.time() * 1e6) - self.settle
        return {"modified": max((m for _, _, m in listed(self.folder, self.kinds) if m <= settled), default=-1)}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        new = [f for f in listed(self.folder, self.kinds) if start["modified"] < f[2] <= end["modified"]]
        return dealt(new, self.most) or [Files([])]

    def commit(self, end: dict) -> None:
        pass


class Uploads(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> UploadsReader:
        return UploadsReader(self.options)

    def streamReader(self, schema) -> UploadsStreamReader:
        return UploadsStreamReader(self.options)


def register(spark: SparkSession) -> None:
    """Makes the format known to a session; its workers must find this library."""
    spark.dataSource.register(Uploads)


def workbook_rows(uploads: DataFrame) -> DataFrame:
    """path, sheet, sheet_no, row_idx, cells and error of workbooks, as ``files.read_xlsx`` gives them."""
    books = uploads.where("kind = '.xlsx'")
    return books.select("path", F.explode_outer("rows").alias("r"), "error").select("path", "r.sheet", "r.sheet_no", "r.row_idx", "r.cells", "error")
