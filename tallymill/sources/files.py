"""Readers of uploaded files: plain text and Markdown by Spark; DOCX and XLSX as table functions over binary files."""

from __future__ import annotations

import io
import re
import zipfile
from collections import deque
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallymill.functions.text import extension, strip, words

# Extensions that may be uploaded, and the largest size.
ALLOWED = (".pdf", ".md", ".txt", ".text", ".docx", ".doc", ".xlsx", ".xls")
MAX_BYTES = 50 * 1024 * 1024
TEXT = (".md", ".markdown", ".txt", ".text")
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def upload_problem(path: Column, size: Column) -> Column:
    """Why a file is refused; null if it is not."""
    return F.when(~extension(path).isin(*ALLOWED), F.concat(F.lit("unsupported type "), extension(path))).when(size > MAX_BYTES, F.lit("too large"))


def split_uploads(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files (path, length) to process, and refused ones with the reason."""
    judged = files.withColumn("problem", upload_problem(F.col("path"), F.col("length")))
    return judged.where("problem is null").drop("problem"), judged.where("problem is not null")


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """path and whole stripped text of text and Markdown files."""
    rows = spark.read.format("text").option("wholetext", True).load(path).select(F.col("_metadata.file_path").alias("path"), "value")
    return rows.where(extension(F.col("path")).isin(*TEXT)).select("path", strip(F.col("value")).alias("text"))


def text_metadata(docs: DataFrame, text: str = "text") -> DataFrame:
    """line_count, word_count and character_count of each text."""
    c = F.coalesce(F.col(text), F.lit(""))
    lines = F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit(""))) + 1
    return docs.withColumns({"line_count": lines.cast("long"), "word_count": F.size(words(c)).cast("long"), "character_count": F.length(c).cast("long")})


def docx_parts(data: bytes) -> tuple[list[str], list[str], int]:
    """Paragraphs of the body, table cells row by row (both not blank), and the number of tables."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")

    def text(node) -> str:
        return "".join(t.text or "" for t in node.iter(f"{_W}t"))

    paragraphs = [text(p) for p in body.findall(f"{_W}p")]
    tables = body.findall(f"{_W}tbl")
    cells = ["\n".join(text(p) for p in c.findall(f"{_W}p")).strip() for t in tables for r in t.findall(f"{_W}tr") for c in r.findall(f"{_W}tc")]
    return [p for p in paragraphs if p.strip()], [c for c in cells if c], len(tables)


def read_docx(files: DataFrame) -> DataFrame:
    """path, text and counts of DOCX files (path, content); a damaged file has its error and zeros."""

    def run(batches):
        for batch in batches:
            rows = []
            for data in batch.column(1).to_pylist():
                try:
                    p, c, n = docx_parts(data)
                    text = "\n\n".join([*p, *c])
                    rows.append((text, len(p), n, len(text.split()), len(text), None))
                except Exception as e:  # noqa: BLE001  whatever a damaged archive raises
                    rows.append((None, 0, 0, 0, 0, f"{type(e).__name__}: {e}"[:200]))
            cols = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, k) for x, k in zip(cols, kinds, strict=True))], ["path", "text", "paragraph_count", "table_count", "word_count", "character_count", "error"])

    return files.select("path", "content").mapInArrow(run, "path string, text string, paragraph_count long, table_count long, word_count long, character_count long, error string")


def xlsx_rows(data: bytes) -> list[tuple[str, int, list[str]]]:
    """(sheet, row, cells) of a workbook, in the workbook's order of sheets."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{_S}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall(f"{_S}si")]
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        out = []
        for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_S}sheet"):
            target = targets[sheet.get(f"{_R}id")].lstrip("/")
            tree = ElementTree.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}"))
            for k, row in enumerate(tree.iter(f"{_S}row")):
                cells: list[str] = []
                for c in row.findall(f"{_S}c"):
                    letters = re.match("[A-Z]*", c.get("r", ""))[0]
                    column = 0
                    for ch in letters:
                        column = column * 26 + ord(ch) - 64
                    cells += [""] * ((column or len(cells) + 1) - 1 - len(cells))
                    v, kind = c.find(f"{_S}v"), c.get("t")
                    if kind == "inlineStr":
                        cells.append("".join(t.text or "" for t in c.iter(f"{_S}t")))
                    else:
                        value = v.text or "" if v is not None else ""
                        cells.append(shared[int(value)] if kind == "s" and value else value)
                out.append((sheet.get("name"), int(row.get("r", k + 1)), cells))
        return out


def read_xlsx(files: DataFrame) -> DataFrame:
    """path, sheet with its number, row_idx and cells of every row of XLSX files; a damaged file has one row with its error."""
    schema = "path string, sheet string, sheet_no int, row_idx long, cells array<string>, error string"

    def run(batches):
        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    found, order = xlsx_rows(data), {}
                    rows = [(path, s, order.setdefault(s, len(order)), k, c, None) for s, k, c in found]
                except Exception as e:  # noqa: BLE001  whatever a damaged archive raises
                    rows = [(path, None, None, None, None, f"{type(e).__name__}: {e}"[:200])]
                cols = list(zip(*rows, strict=True)) or [[]] * 6
                kinds = [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.list_(pa.string()), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(cols, kinds, strict=True)], [c.split(" ")[0] for c in schema.split(", ")])

    return files.select("path", "content").mapInArrow(run, schema)


def _cell(c: Column) -> Column:
    return F.replace(F.replace(strip(F.coalesce(c, F.lit(""))), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))


def workbook_text(rows: DataFrame) -> DataFrame:
    """path and the whole workbook as Markdown: a section for each sheet, with the rows above its header as text and the table below."""
    line = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    rows = rows.where("error is null").withColumn("cells", F.transform("cells", _cell)).withColumn("_full", F.size(F.filter("cells", lambda c: c != "")))
    sheet = Window.partitionBy("path", "sheet")
    top = F.coalesce(F.min(F.when(F.col("_full") >= 2, F.col("row_idx"))).over(sheet), F.min("row_idx").over(sheet))
    rows = rows.withColumn("_top", top).withColumn("_width", F.max(F.when(F.col("row_idx") == F.col("_top"), F.size("cells"))).over(sheet))
    title = F.array_join(F.filter("cells", lambda c: c != ""), " ")
    padded = F.slice(F.concat("cells", F.array_repeat(F.lit(""), F.col("_width"))), F.lit(1), F.col("_width"))
    head = F.concat(line(F.col("cells")), F.lit("\n"), line(F.array_repeat(F.lit("---"), F.col("_width"))))
    text = F.when(F.col("row_idx") < F.col("_top"), title).when(F.col("row_idx") == F.col("_top"), head).when(F.size(F.filter(padded, lambda c: c != "")) > 0, line(padded))
    lines = F.array_sort(F.collect_list(F.struct("row_idx", (F.col("row_idx") < F.col("_top")).alias("above"), text.alias("line"))))
    kept = F.filter(lines, lambda x: x["line"].isNotNull() & (x["line"] != ""))
    joined = lambda above: F.array_join(F.transform(F.filter(kept, lambda x: x["above"] == above), lambda x: x["line"]), "\n")
    each = rows.groupBy("path", "sheet", "sheet_no").agg(joined(True).alias("titles"), joined(False).alias("table"))
    section = F.concat(F.lit("## Sheet: "), "sheet", F.lit("\n\n"), F.when(F.col("titles") != "", F.concat("titles", F.lit("\n\n"))).otherwise(""), "table")
    held = F.array_sort(F.collect_list(F.struct("sheet_no", section.alias("section"))))
    return each.groupBy("path").agg(F.array_join(F.transform(held, lambda x: x["section"]), "\n\n---\n\n").alias("text"))


def sheet_tables(rows: DataFrame) -> DataFrame:
    """Data rows with their sheet's header: the first row with two cells that are not empty, else the first row. Blank rows go."""
    full = F.size(F.filter("cells", lambda c: F.trim(c) != ""))
    rows = rows.where("error is null").withColumn("_full", full)
    top = rows.groupBy("path", "sheet").agg(F.coalesce(F.min(F.when(F.col("_full") >= 2, F.col("row_idx"))), F.min("row_idx")).alias("_top"))
    joined = rows.join(top, ["path", "sheet"])
    header = joined.where("row_idx = _top").select("path", "sheet", F.col("cells").alias("header"))
    return joined.where("row_idx > _top and _full > 0").join(header, ["path", "sheet"]).select("path", "sheet", "header", "row_idx", "cells")


def sheet_metadata(rows: DataFrame) -> DataFrame:
    """sheet_count, sheets and total_row_count of each workbook."""
    each = rows.where("error is null").groupBy("path", "sheet").agg(F.max("row_idx").alias("n"))
    return each.groupBy("path").agg(F.count(F.lit(1)).alias("sheet_count"), F.array_sort(F.collect_list(F.struct("sheet", F.col("n").alias("row_count")))).alias("sheets"), F.sum("n").alias("total_row_count"))


def pdf_pages(files: DataFrame) -> DataFrame:
    """path, page_number and text of PDF files, if a PDF library is installed; else one row each with an error."""

    def run(batches):
        try:
            import pypdf
        except ImportError:
            pypdf = None
        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    if pypdf is None:
                        raise RuntimeError("no PDF library is installed")
                    rows = [(path, k + 1, (p.extract_text() or "").strip(), None) for k, p in enumerate(pypdf.PdfReader(io.BytesIO(data)).pages)]
                except Exception as e:  # noqa: BLE001
                    rows = [(path, None, None, f"{type(e).__name__}: {e}"[:200])]
                cols = list(zip(*rows, strict=True)) or [[]] * 4
                kinds = [pa.string(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(cols, kinds, strict=True)], ["path", "page_number", "text", "error"])

    return files.select("path", "content").mapInArrow(run, "path string, page_number long, text string, error string")


def pdf_text(pages: DataFrame) -> DataFrame:
    """path and whole text of PDF files from their pages, the first error where there is one."""
    held = F.array_sort(F.collect_list(F.when(F.col("text") != "", F.struct("page_number", "text"))))
    return pages.groupBy("path").agg(F.array_join(F.transform(held, lambda p: p["text"]), "\n\n").alias("text"), F.count("page_number").alias("page_count"), F.max("error").alias("error"))


def read_any(files: DataFrame) -> DataFrame:
    """path, text and error of files (path, content), each by its extension's reader; other types have a row with an error."""
    kind = files.withColumn("_kind", extension(F.col("path")))
    of = lambda *kinds: kind.where(F.col("_kind").isin(*kinds)).drop("_kind")
    texts = of(*TEXT).select("path", strip(F.decode("content", "UTF-8")).alias("text"), F.lit(None).cast("string").alias("error"))
    rows = read_xlsx(of(".xlsx"))
    sheets = workbook_text(rows).withColumn("error", F.lit(None).cast("string")).unionByName(rows.where("error is not null").select("path", F.lit(None).cast("string").alias("text"), "error"))
    other = kind.where(~F.col("_kind").isin(*TEXT, ".docx", ".xlsx", ".pdf")).select("path", F.lit(None).cast("string").alias("text"), F.concat(F.lit("no reader for "), F.col("_kind")).alias("error"))
    return texts.unionByName(read_docx(of(".docx")).select("path", "text", "error")).unionByName(sheets).unionByName(pdf_text(pdf_pages(of(".pdf"))).select("path", "text", "error")).unionByName(other)


def keep_pictures(images: DataFrame, least: int = 100, ratio: float = 3.0) -> DataFrame:
    """Images of at least 100 by 100 that are not as narrow as logos."""
    w, h = F.col("width"), F.col("height")
    return images.where((w >= least) & (h >= least) & (F.greatest(w / F.nullif(h, F.lit(0)), h / F.nullif(w, F.lit(0))) <= ratio))


def estimated_text(images: DataFrame, pages: DataFrame, n: int = 500) -> DataFrame:
    """text_before and text_after of images (image_id, doc, page) on pages (doc, page, text) without positions.

    The images of a page are taken to be spread evenly over its words; a tenth of ``n`` words on either side of an
    image's place are left out as its own, and as many before and after those are given.
    """
    page = Window.partitionBy("doc", "page")
    k, total = F.row_number().over(page.orderBy("image_id")), F.count(F.lit(1)).over(page)
    rows = images.withColumn("_share", F.when(total > 1, k / (total + 1)).otherwise(0.5)).join(pages.select("doc", "page", words(F.col("text")).alias("_words")), ["doc", "page"], "left")
    near = n // 10
    at = F.floor(F.size("_words") * F.col("_share"))
    first, last = F.greatest(F.lit(0), at - near), F.least(F.size("_words").cast("long"), at + near)
    before = F.slice("_words", (F.greatest(F.lit(0), first - near) + 1).cast("int"), F.least(first, F.lit(near)).cast("int"))
    after = F.slice("_words", (last + 1).cast("int"), F.lit(near))
    text = lambda a: F.coalesce(F.array_join(a, " "), F.lit(""))
    return rows.withColumn("text_before", F.right(text(before), F.lit(n))).withColumn("text_after", F.left(text(after), F.lit(n))).drop("_share", "_words")


def surrounding_text(images: DataFrame, spans: DataFrame, n: int = 500) -> DataFrame:
    """Images (doc, page, y and any others) with text_before and text_after: the last and first ``n`` characters of the page's
    spans (doc, page, y, seq, text) above and below, in the order of y and seq. A span at an image's height is above it.

    Images and spans of a page come in one order, and one pass keeps no more than ``n`` characters before, and those since
    the first image that waits for its own. Spans without text or height are left out; images without a height, or on a
    page without spans, have empty texts. Repeated images each get their row.
    """
    place = lambda doc, page, y, kind, seq: [doc.cast("string").alias("doc"), page.cast("long").alias("page"), y.cast("double").alias("y"), F.lit(kind).alias("kind"), seq.cast("long").alias("seq")]
    kind = f"struct<{','.join(f'`{f.name}`:{f.dataType.simpleString()}' for f in images.schema.fields)}>"
    text = strip(F.col("text"))
    above = spans.where(F.col("y").isNotNull() & (text != "")).select(*place(F.col("doc"), F.col("page"), F.col("y"), 0, F.col("seq")), text.alias("text"), F.lit(None).cast(kind).alias("image"))
    marks = images.select(*place(F.col("doc"), F.col("page"), F.col("y"), 1, F.lit(0)), F.lit(None).cast("string").alias("text"), F.struct("*").alias("image"))
    rows = above.unionByName(marks).repartition("doc", "page").sortWithinPartitions("doc", "page", F.col("y").asc_nulls_first(), "kind", "seq")

    def run(batches):
        done: list[tuple[pa.Array, str, str]] = []
        waiting: deque[tuple[pa.Array, str, int]] = deque()
        page, tail, since, length = None, "", "", 0  # since: the page's text from where the first waiting image is

        def finish():
            nonlocal since
            image, before, start = waiting.popleft()
            done.append((image, before.strip(), since[: n + 1].strip()[:n].strip()))
            if waiting:
                since = since[waiting[0][2] - start :]

        def out():
            arrays = [pa.concat_arrays([x[0] for x in done]), *(pa.array([x[k] for x in done], pa.string()) for k in (1, 2))]
            done.clear()
            return pa.RecordBatch.from_arrays(arrays, ["image", "text_before", "text_after"])

        for batch in batches:
            docs, numbers, heights, kinds, texts = (batch.column(k).to_pylist() for k in (0, 1, 2, 3, 5))
            for k, here in enumerate(zip(docs, numbers, strict=True)):
                if here != page:
                    while waiting:
                        finish()
                    page, tail, since, length = here, "", "", 0
                if kinds[k]:
                    image = batch.column(6).slice(k, 1)
                    if heights[k] is None:
                        done.append((image, "", ""))
                    else:
                        if not waiting:
                            since = ""
                        waiting.append((image, tail, length))
                else:
                    added = f" {texts[k]}" if length else texts[k]
                    length += len(added)
                    tail = (tail + added)[-n:]
                    if waiting:
                        since += added
                        while waiting and length - waiting[0][2] > n:
                            finish()
                if len(done) >= 1024:
                    yield out()
        while waiting:
            finish()
        if done:
            yield out()

    found = rows.select("doc", "page", "y", "kind", "seq", "text", "image").mapInArrow(run, f"image {kind}, text_before string, text_after string")
    return found.select(*(F.col(f"image.`{c}`").alias(c) for c in images.columns), "text_before", "text_after")


def docx_bytes(paragraphs: list[str]) -> bytes:
    """A DOCX file of plain paragraphs."""
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = "".join(f'<w:p><w:r><w:t xml:space="preserve">{escape(p)}</w:t></w:r></w:p>' for p in paragraphs)
    return _archive({"word/document.xml": f"<w:document {w}><w:body>{body}</w:body></w:document>"})


def xlsx_bytes(sheets: dict[str, list[list[str]]]) -> bytes:
    """A workbook of text cells, a list of rows for each sheet."""
    s = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    parts = {
        "xl/workbook.xml": f"<workbook {s}><sheets>{''.join(f'<sheet name={quoteattr(n)} r:id="r{k}"/>' for k, n in enumerate(sheets))}</sheets></workbook>",
        "xl/_rels/workbook.xml.rels": f"<Relationships>{''.join(f'<Relationship Id="r{k}" Target="worksheets/sheet{k}.xml"/>' for k in range(len(sheets)))}</Relationships>",
    }
    for k, rows in enumerate(sheets.values()):
        cells = "".join(f'<row r="{n}">{"".join(f"<c t=\"inlineStr\"><is><t>{escape(c)}</t></is></c>" for c in row)}</row>' for n, row in enumerate(rows, 1))
        parts[f"xl/worksheets/sheet{k}.xml"] = f"<worksheet {s}><sheetData>{cells}</sheetData></worksheet>"
    return _archive(parts)


def _archive(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()
