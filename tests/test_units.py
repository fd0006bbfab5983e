"""Hand cases: quirks and edges of single operators."""

import datetime as dt
import io
import random
import tracemalloc
import zipfile
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from tallymill.functions import text as tx
from tallymill.functions.money import cost
from tallymill.operators import chain, chunking, documents, listing, ranking, report, usage, vectors
from tallymill.operators import config_history as ch
from tallymill.operators import pipeline_state as ps
from tallymill.sources import files, pages


def column(spark, values, f, kind="string"):
    rows = [(k, v) for k, v in enumerate(values)]
    return [r[0] for r in spark.createDataFrame(rows, f"k int, v {kind}").orderBy("k").select(f(F.col("v")).alias("x")).collect()]


def test_model_names(spark):
    names = ["gpt-4o-mini-2024-07-18", "gpt-4-turbo-2024-04-09", "gpt-3.5-turbo-0125", "unknown", "", None, "x20240101-"]
    assert column(spark, names, tx.normalise_model_name) == ["gpt-4o-mini", "gpt-4-turbo", "gpt-3.5-turbo", "unknown", "", None, "x"]


def test_cost(spark):
    rows = spark.createDataFrame([(1234567, Decimal("0.150000")), (10, None), (None, Decimal("1")), (3, Decimal("0.5"))], "t long, p decimal(10,6)")
    assert [r[0] for r in rows.select(cost(F.col("t"), F.col("p"))).collect()] == [Decimal("0.185185"), Decimal("0.000000"), Decimal("0.000000"), Decimal("0.000002")]


def test_day_bounds(spark):
    at = ["2024-01-01 23:59:59.999998", "2024-01-01 23:59:59.999999", "2024-01-01 00:00:00"]
    m = spark.createDataFrame([(k, 1, "assistant", "m", 1, 1, 2, t) for k, t in enumerate(at)], "id long, tenant_id long, role string, model_used string, input_tokens long, output_tokens long, total_tokens long, created_at string")
    m = m.withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))
    assert [r["message_count"] for r in usage.daily_usage(m).collect()] == [2]
    assert m.where(usage.in_days(F.col("created_at"), "2024-01-01", "2024-01-01")).count() == 2
    with pytest.raises(ValueError):
        usage.check_range(dt.date(2024, 1, 2), dt.date(2024, 1, 1), 365)
    assert usage.previous_month(dt.date(2024, 1, 31)) == (2023, 12)


def test_replace_is_repeatable(spark):
    old = spark.createDataFrame([(1, "a", 5), (2, "a", 6)], "k long, m string, n long")
    new = spark.createDataFrame([(2, "a", 7), (3, "a", 8)], "k long, m string, n long")
    once = usage.replace(old, new, ["k", "m"])
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, usage.replace(once, new, ["k", "m"]).collect())) == [(1, "a", 5), (2, "a", 7), (3, "a", 8)]


def test_zero_statistics(spark):
    m = spark.createDataFrame([(1, 1, 1, "user", None, None, None, None)], "id long, user_id long, tenant_id long, role string, model_used string, input_tokens long, output_tokens long, total_tokens long")
    assert usage.message_statistics(m, ["user_id"], m).first().asDict() == {"user_id": 1, "total_messages": 0, "total_input_tokens": 0, "total_output_tokens": 0, "total_tokens": 0, "avg_tokens": 0.0, "models_used": "", "active_users": 0}


def test_fixed_chunks():
    cut = lambda t, size=1000, overlap=200: list(chunking.fixed(t, size, overlap))
    assert cut("") == [] and cut("  \n ") == [] and cut("abc") == ["abc"]
    assert [len(c) for c in cut("x" * 1000)] == [1000, 200]  # a tail of overlap alone
    assert cut("ab cd ef", 3, 5) == ["ab", "cd", "ef"]  # more overlap than size
    assert cut("aaaa bbbb cccc", 8, 2)[0] == "aaaa bbb"  # a space in the first half does not count
    text = " ".join(f"wörd🙂{k}" for k in range(500))
    assert all(len(c) <= 100 for c in cut(text, 100, 20)) and text.startswith(cut(text, 100, 20)[0])


def test_sentences_and_paragraphs():
    assert list(chunking.sentences("Aa. Bb! Cc? Dd.", 6, 3)) == ["Aa. Bb!", "Bb! Cc?", "Cc? Dd."]
    assert list(chunking.paragraphs("aa\n\nbb\n \ncc", 4, 2)) == ["aa\n\nbb", "bb\n\ncc"]
    assert list(chunking.paragraphs("aa\n\n" + "y" * 9 + "\n\nbb", 5, 0)) == ["aa", "yyyyy", "yyyy", "bb"]


def test_chunk_rows_keep_columns(spark):
    docs = spark.createDataFrame([(1, "a b c", "z"), (2, None, "y"), (3, "  ", "x")], "doc_id long, text string, chunk_note string")
    assert [tuple(r) for r in chunking.chunk_texts(docs, "nonsense").collect()] == [(1, "z", 0, "a b c")]


def test_sorting_with_nulls(spark):
    rows = spark.createDataFrame([(1, None, "failed"), (2, 5, "pending"), (3, 9, "completed")], "id long, size long, processing_status string")
    ids = lambda df: [r["id"] for r in df.collect()]
    assert ids(listing.sorted_page(rows, "size")) == [2, 3, 1] and ids(listing.sorted_page(rows, "size", True)) == [1, 3, 2]
    assert ids(listing.sorted_page(rows, "processing_status")) == [2, 3, 1]
    assert listing.page_count(0, 20) == 1 and listing.page_count(41, 20) == 3


@pytest.mark.parametrize(("states", "expected"), [(["completed"], "completed"), (["failed"], "failed"), (["completed", "pending"], "processing"), (["completed", "failed"], "partial_success"), (["pending"], "processing"), (["odd", "failed"], "processing")])
def test_batch_status(spark, states, expected):
    rows = spark.createDataFrame([(1, s) for s in states], "batch_id long, processing_status string")
    assert listing.batch_progress(rows).first()["batch_status"] == expected


def test_top_k_ties_and_zero(spark):
    p = spark.createDataFrame([(3, 1, "a", [1.0, 0.0]), (1, 1, "b", [2.0, 0.0]), (2, 1, "c", [0.0, 0.0])], "id long, tenant_id long, document_id string, embedding array<float>")
    assert [(r["id"], r["score"]) for r in vectors.top_k(p, [1.0, 0.0], 3).collect()] == [(1, 1.0), (3, 1.0), (2, 0.0)]
    docs = spark.createDataFrame([(7, "a")], "id long, doc_id string")
    assert vectors.search(p, docs, [1.0, 0.0], 1, wanted=[99]).count() == 0
    assert vectors.search(p, docs, [1.0, 0.0], 1, wanted=[99], strict=False).count() == 3
    assert vectors.payload_filter(p, 1, document_ids=[]).count() == 3


def test_faq(spark):
    schema = "id long, text string, score double, rank long, document_id string, document_name string, page_number int, chunk_index int"
    hits = spark.createDataFrame([(1, "1. How do I pay?\nBy card.", 0.1, 1, "a", "A", 1, 0), (2, "how do I really pay", 0.9, 2, "b", "B", 2, 1), (3, "nothing", 1.0, 3, "c", "C", 3, 2)], schema)
    docs = spark.createDataFrame([(20, "b")], "id long, doc_id string")
    ask = lambda q, k=50: [(r["matched"], r["answer"], r["document_db_id"], r["combined_score"] and round(r["combined_score"], 2)) for r in ranking.faq_match(hits, docs, F.lit(q), k).collect()]
    assert ask("How do I pay?") == [(True, "how do I really pay", 20, 2.4)] and ask("How do I pay?", 1) == [(True, "1. How do I pay?\nBy card.", None, 2.1)]
    assert ask("How do I pay by card") == ask("zzz") == ask("?") == [(False, None, None, None)]


def test_page_head():
    assert pages.head_of("<title> A &amp; B </title><meta content='d &lt;' name=description><meta name='description' content='later'><h1>H</h1>") == ("A & B", "d <", "")
    assert pages.head_of("<meta content='O' property='og:title'><h1>H</h1><meta property='article:author' content='W'>") == ("O", "", "W")
    assert pages.head_of("<title> </title><h1>H</h1>")[0] == "Untitled" and pages.head_of("<h1>H <b>x</b></h1>")[0] == "H x" and pages.head_of("")[0] == "Untitled"


def test_page_head_references_cut_off():
    cut = "<title>A &amp; B&amp;&amp</title><meta name=author content='W &lt'><meta name=description content='x &unknown; &#39;y&#39; &#39'><p>&amp</p>"
    assert pages.head_of(cut) == ("A & B&&amp", "x &unknown; 'y' &#39", "W &lt")
    assert pages.parts_of(cut) == (*pages.head_of(cut), pages.to_markdown(cut)) and pages.to_markdown(cut) == "A & B&&\n\n&"  # a body is read as browsers do


def test_page_document(spark):
    rows = spark.createDataFrame([(1, "http://x/", "<head><title>T</title></head><p>Body</p>"), (2, "http://y/", None)], "page_id long, url string, html string")
    got = {r["page_id"]: r["document"] for r in pages.page_document(rows).collect()}
    assert got[1] == "1. title:\n\nT\n\n2. Source URL:\n\nhttp://x/\n\n3. Description:\n\n\n\n4. content:\n\nBody"
    assert got[2] == "1. title:\n\nUntitled\n\n2. Source URL:\n\nhttp://y/\n\n3. Description:\n\n\n\n4. content:"
    assert {r["document"] for r in pages.page_document(rows, with_metadata=False).collect()} == {"Body", ""}


def test_report_rules(spark):
    text = "## Left out\nMAIN FINDINGS:\n•one\n# passed over\n* **two** <b>\n\n- three **3**\n1. four\n2) five\n10. six\nok"
    lines = report.report_lines(spark.createDataFrame([(1, text)], "id long, text string"), "id")
    html = report.report_html(lines, "id").first()["html"]
    assert html == "<h2>MAIN FINDINGS</h2>\n<ul>\n<li>one</li>\n<li>two** &lt;b&gt;</li>\n</ul>\n<ul>\n<li>three <strong>3</strong></li>\n</ul>\n<p>1. four</p>\n<p>2) five</p>\n<p>10. six</p>\n<p>ok</p>"


def test_prices_are_unique(spark):
    used = spark.createDataFrame([(1, "m", "2024-01-01", 10, 10, 20, 1)], "tenant_id long, model_name string, usage_date string, total_input_tokens long, total_output_tokens long, total_tokens long, message_count long")
    prices = spark.createDataFrame([("m", 1.0, 1.0), ("m", 2.0, 2.0)], "name string, input_price double, output_price double").selectExpr("name", "CAST(input_price AS DECIMAL(10,6)) input_price", "CAST(output_price AS DECIMAL(10,6)) output_price")
    with pytest.raises(Exception, match="several prices for m"):
        usage.priced(used, prices).collect()
    assert usage.priced(used, prices.limit(0)).count() == 1


def test_titles_and_snippets(spark):
    assert column(spark, ["  one two  ", "a b c d e f g h", "x" * 60, None], tx.conversation_title) == ["one two", "a b c d e f g...", "x" * 50 + "...", None]
    assert column(spark, ["hello there", "history", "hi, what is the total of all invoices", "Bye!!"], tx.is_casual) == [True, True, False, True]


def test_filenames(spark):
    names = ["Report™", "User's Question about Café", "???", "a — b…", None]
    assert column(spark, names, tx.safe_filename) == ["ReportTM", "User-s-Question-about-Cafe", "conversation-report", "a-b...", None]


def test_s3_keys(spark):
    urls = ["s3://b/k/x.pdf", "s3://b", "https://b.s3.eu.amazonaws.com/k.pdf?sig=1", "https://s3.eu.amazonaws.com/b/k.pdf", "b/k", " ", None, "https://h/b/p?q"]
    assert column(spark, urls, lambda c: tx.s3_key(c, "b")) == ["k/x.pdf", None, "k.pdf", "k.pdf", "k", None, None, "p"]


def test_history_pick(spark):
    rows = spark.createDataFrame([(1, [(0, "t", {"a": "1"})])], "id long, config_version_history array<struct<version:int,timestamp:string,config:map<string,string>>>")
    for value in ("2", "3"):
        rows = ch.append_version(rows, spark.createDataFrame([(1, {"b": value}, "u")], "id long, changes map<string,string>, timestamp string"))
    h = F.col("config_version_history")
    r = rows.select(ch.pick(h, F.lit(9))["version"], ch.pick(h, F.lit(9), "latest")["version"], ch.pick(h, F.lit(0))["config"]).first()
    assert tuple(r) == (0, 2, {"a": "1", "b": "3"})
    assert column(spark, [{"t": "0"}, {}], lambda c: ch.setting(c, "t", "7", zero_is_missing=True), "map<string,string>") == ["7", "7"]


def test_rate_limit_keeps_shut_until_silence(spark):
    calls = spark.createDataFrame([(k, "a", s) for k, s in enumerate([0, 30, 60, 89, 95, 149, 160, 400])], "event_id long, key string, s long").withColumn("ts", F.timestamp_seconds("s"))
    assert [r["allowed"] for r in ps.rate_limited(calls, "key", 2, 60).orderBy("event_id").collect()] == [True, True, False, False, True, True, False, True]


def test_markdown():
    html = "<html><head><title>T</title></head><body><nav>no</nav><h1>A &amp; B</h1><p>x <b>y</b> <a href='u'>z</a></p><ul><li>1</li><li>2</li></ul><script>no()</script></body></html>"
    assert pages.to_markdown(html) == "# A & B\n\nx **y** [z](u)\n\n* 1\n* 2"
    assert pages.to_markdown("") == "" and pages.to_markdown("<p>open <b>tag") == "open **tag"


def _zip(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in parts.items():
            z.writestr(name, data)
    return bytearray(out.getvalue())


def test_office_files(spark):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    docx = _zip({"word/document.xml": f"<w:document {w}><w:body><w:p><w:r><w:t>Hi</w:t></w:r></w:p><w:p/><w:tbl><w:tr><w:tc><w:p><w:r><w:t>c1</w:t></w:r></w:p></w:tc><w:tc><w:p/></w:tc></w:tr></w:tbl></w:body></w:document>"})
    rows = spark.createDataFrame([("a.docx", docx), ("b.docx", bytearray(b"no"))], "path string, content binary")
    got = {r["path"]: r for r in files.read_docx(rows).collect()}
    assert got["a.docx"]["text"] == "Hi\n\nc1" and got["a.docx"]["table_count"] == 1 and got["b.docx"]["error"].startswith("BadZipFile")
    s = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    sheet = "".join(f'<row r="{k}"><c r="A{k}" t="inlineStr"><is><t>{a}</t></is></c>' + (f'<c r="C{k}"><v>{b}</v></c>' if b else "") + "</row>" for k, (a, b) in enumerate([("Title", ""), ("name", "n"), ("x|y", "1"), ("z", "2")], 1))
    xlsx = _zip({
        "xl/workbook.xml": f'<workbook {s} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="S" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>', "xl/worksheets/sheet1.xml": f"<worksheet {s}><sheetData>{sheet}</sheetData></worksheet>",
    })
    cells = files.read_xlsx(spark.createDataFrame([("w.xlsx", xlsx)], "path string, content binary"))
    table = files.sheet_tables(cells)
    assert [r["cells"] for r in table.orderBy("row_idx").collect()] == [["x|y", "", "1"], ["z", "", "2"]]
    assert "| x\\|y |  | 1 |" in chunking.row_groups(table, ["path"]).first()["chunk"]
    assert files.sheet_metadata(cells).first()["sheet_count"] == 1


def test_pictures_and_context(spark):
    i = spark.createDataFrame([(1, "d", 1, 50.0, 200, 100), (2, "d", 1, 10.0, 900, 100)], "image_id long, doc string, page int, y double, width int, height int")
    assert [r["image_id"] for r in files.keep_pictures(i).collect()] == [1]
    spans = spark.createDataFrame([("d", 1, 10.0, 1, "above"), ("d", 1, 90.0, 2, "below")], "doc string, page int, y double, seq int, text string")
    r = files.surrounding_text(i.where("image_id = 1"), spans).first()
    assert (r["text_before"], r["text_after"]) == ("above", "below")


def test_text_around_pictures_against_the_whole_page(spark):
    rng = random.Random(4)
    spans = [(f"d{rng.randrange(3)}", rng.randrange(4), float(rng.randrange(40)), k, rng.choice(["", " ", "a", "some words", "x" * 30, "long " * 30, None])) for k in range(900)] + [("d0", 0, None, 900, "nowhere")]
    images = [(k, f"d{rng.randrange(4)}", rng.randrange(4), float(rng.randrange(-1, 41)) if k % 9 else None, f"note {k}") for k in range(200)] + [(7, "d0", 0, 3.0, "note 7")] * 2
    df = spark.createDataFrame(images, "image_id long, doc string, page int, y double, text string").repartition(3)
    around = files.surrounding_text(df, spark.createDataFrame(spans, "doc string, page int, y double, seq int, text string").repartition(5), 50)
    assert around.columns == [*df.columns, "text_before", "text_after"]
    want = []
    for i, d, p, y, note in images:
        page = sorted((sy, q, t.strip()) for sd, sp, sy, q, t in spans if (sd, sp) == (d, p) and sy is not None and t and t.strip())
        before, after = " ".join(t for sy, _, t in page if y is not None and sy <= y), " ".join(t for sy, _, t in page if y is not None and sy > y)
        want.append((i, d, p, y, note, before[-50:].strip(), after[:50].strip()))
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, around.collect()), key=key) == sorted(want, key=key)
    assert files.surrounding_text(df, spark.createDataFrame([], "doc string, page int, y double, seq int, text string")).where("text_before <> '' OR text_after <> ''").count() == 0


def test_partition_write(spark, tmp_path):
    from tallymill.sources import tables

    path = f"{tmp_path}/usage"
    rows = lambda x: spark.createDataFrame(x, "tenant_id long, n long, day string")
    tables.write_partitions(rows([(1, 1, "a"), (2, 2, "a"), (1, 3, "b")]), path, ["day"], ["n"])
    tables.write_partitions(rows([(9, 9, "b")]), path, ["day"])
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [(1, 1, "a"), (2, 2, "a"), (9, 9, "b")]
    assert tables.read_objects(spark, path, "*.parquet").count() > 0


def test_status_stream_over_batches(spark, tmp_path):
    from tallymill.streaming import state
    from tallymill.streaming import usage as stream

    events = spark.createDataFrame([(k, k % 3, "error" if k % 2 else "ok", 1_700_000_000 + k * 10) for k in range(60)], "event_id long, key long, status string, s long").withColumn("ts", F.timestamp_seconds("s"))
    for k in range(3):
        events.where(F.floor(F.col("event_id") / 20) == k).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    rows = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    out = stream.latest(stream.run(state.latest_status("key")(rows), str(tmp_path)), ["key"])
    expected = ps.latest_status(events.withColumn("ts", F.col("ts").cast("timestamp_ntz")), "key")
    assert sorted((r["key"], r["status"], r["n_events"]) for r in out.collect()) == sorted((r["key"], r["status"], r["n_events"]) for r in expected.collect())


def test_request_without_answers(spark):
    points = spark.createDataFrame([(1, 1, "a", "A", [1.0, 0.0])], "id long, tenant_id long, document_id string, document_name string, embedding array<double>")
    texts = spark.createDataFrame([(1, "the text")], "id long, text string")
    docs = spark.createDataFrame([(7, "a", 1, "failed")], "id long, doc_id string, tenant_id long, processing_status string")
    turns = spark.createDataFrame([(1, k, k, "user" if k % 2 else "assistant", f"m{k}") for k in range(9)] + [(1, 9, 9, "user", "what?")], "conversation_id long, id long, created_at long, role string, content string")
    ask = lambda d, q: chain.request(points, texts, d, turns, q, [1.0, 0.0], 1).first()
    row = ask(docs, "why?")
    assert row["query_type"] == "no_documents" and row["answer"] == chain.NO_DOCUMENTS and row["user_content"] is None and len(row["history"]) == 6
    row = ask(docs.withColumn("processing_status", F.lit("completed")), "why?")
    assert row["query_type"] == "retrieval" and "[Source 1] A: the text" in row["user_content"] and row["citations"][0]["document_url"] == "/documents/7"
    assert ask(docs.withColumn("processing_status", F.lit("completed")), "what?")["user_content"] is None  # asked already


def test_default_moves_on_delete(spark):
    rows = [(1, 1, True, 5), (2, 1, False, 6), (3, 1, False, 7), (4, 2, True, 1)]
    c = spark.createDataFrame(rows, "id long, tenant_id long, is_default boolean, created_at long")
    left = lambda k: sorted((r["id"], r["is_default"]) for r in documents.without_config(c, k).collect())
    assert left(1) == [(2, False), (3, True), (4, True)] and left(2) == [(1, True), (3, False), (4, True)] and left(4) == [(1, True), (2, False), (3, False)]


def test_readers_by_type(spark):
    f = spark.createDataFrame([("a.md", b" hello\n"), ("b.exe", b"x"), ("c.docx", b"broken"), ("d.pdf", b"no"), ("e", b"")], "path string, content binary")
    got = {r["path"]: (r["text"], r["error"]) for r in files.read_any(f).collect()}
    assert got["a.md"] == ("hello", None) and got["b.exe"] == (None, "no reader for .exe") and got["e"][1] == "no reader for "
    assert got["c.docx"][1] and got["d.pdf"][1]


def test_workbook_text(spark):
    cells = [("w", "S", 0, 1, ["Title", ""], None), ("w", "S", 0, 2, ["a", " b|c "], None), ("w", "S", 0, 3, ["", ""], None), ("w", "S", 0, 4, ["1", "2", "3"], None), ("w", "T", 1, 1, ["only"], None)]
    rows = spark.createDataFrame(cells, "path string, sheet string, sheet_no int, row_idx long, cells array<string>, error string")
    assert files.workbook_text(rows).first()["text"] == "## Sheet: S\n\nTitle\n\n| a | b\\|c |\n| --- | --- |\n| 1 | 2 |\n\n---\n\n## Sheet: T\n\n| only |\n| --- |"


def test_estimated_text(spark):
    pages = spark.createDataFrame([(1, 1, " ".join(f"w{k}" for k in range(400))), (1, 2, "few words")], "doc long, page long, text string")
    images = spark.createDataFrame([(1, 1, 1), (2, 1, 1), (3, 1, 2), (4, 9, 9)], "image_id long, doc long, page long")
    got = {r["image_id"]: (r["text_before"], r["text_after"]) for r in files.estimated_text(images, pages).collect()}
    # two images: at a third and two thirds of 400 words; 50 words around each are its own
    assert got[1] == (" ".join(f"w{k}" for k in range(33, 83)), " ".join(f"w{k}" for k in range(183, 233)))
    assert got[2][0].split()[-1] == "w215" and got[2][1].split()[0] == "w316" and got[3] == ("", "") and got[4] == ("", "")


def test_requests_of_many_tenants(spark):
    points = spark.createDataFrame([(k, k % 2, f"d{k // 2}", f"D{k // 2}", [1.0, float(k)]) for k in range(8)] + [(8, 0, "d9", "other length", [1.0]), (9, 0, "d0", "no vector", None)], "id long, tenant_id long, document_id string, document_name string, embedding array<double>")
    texts = spark.createDataFrame([(k, f"text {k} {{query}} {{context}}") for k in range(8)], "id long, text string")
    docs = spark.createDataFrame([(10 + d, f"d{d}", t, "completed" if d < 3 else "failed") for d in range(4) for t in (0, 1)], "id long, doc_id string, tenant_id long, processing_status string").where("id < 13 OR tenant_id = 0").where("NOT (id = 12 AND tenant_id = 1)")
    turns = spark.createDataFrame([(1, k, k, "user" if k % 2 else "assistant", f"m{k}") for k in range(9)] + [(1, 9, 9, "user", "what {context}?")], "conversation_id long, id long, created_at long, role string, content string")
    asked = [(1, 0, 1, "what {context}?", [1.0, 0.0], None), (2, 0, 2, "what {context}?", [1.0, 0.0], ["d1", "d1", "d3"]), (3, 1, None, "who?", [1.0, 9.0], []), (4, 7, 1, "who?", [1.0, 0.0], None), (5, 0, 1, "hello", [1.0, 0.0], None), (6, 0, 2, "who?", None, None), (7, 0, 2, "who?", [1.0, 0.0], ["nowhere"]), (8, 0, 2, None, [0.0, 0.0], None)]
    questions = spark.createDataFrame(asked, "request_id long, tenant_id long, conversation_id long, query string, embedding array<double>, document_ids array<string>").withColumn("images", F.lit("a clashing name"))
    images = points.where("id < 8").select("id", "tenant_id", "document_id", "embedding", F.lit("u").alias("image_url"), F.concat(F.lit("who "), F.col("id").cast("string")).alias("caption"), F.lit("").alias("text"), F.lit(None).cast("string").alias("text_before"), F.lit(None).cast("string").alias("text_after"))
    got = {r["request_id"]: r for r in chain.requests(points, texts, docs, turns, questions.drop("images"), images, k=2).collect()}
    assert {k: (r["query_type"], r["chunks_retrieved"]) for k, r in got.items()} == {1: ("retrieval", 2), 2: ("retrieval", 1), 3: ("retrieval", 2), 4: ("no_documents", 0), 5: ("casual", 0), 6: ("no_results", 0), 7: ("no_results", 0), 8: ("retrieval", 2)}
    assert got[1]["user_content"] is None and len(got[1]["history"]) == 6  # asked already
    assert "[Source 1] D1: text 2 {query} {context}" in got[2]["user_content"] and "Current Question: what {context}?\n" in got[2]["user_content"]
    assert [c["document_url"] for c in got[2]["citations"]] == ["/documents/11"]
    assert [i["id"] for i in got[3]["images"]] == [3] and got[4]["images"] == got[5]["images"] == [] and got[3]["history"] == []
    assert {r["request_id"] for r in chain.requests(points, texts, docs, turns, questions.drop("images"), k=2).where("size(images) = 0").collect()} == set(range(1, 9))


def test_braces_in_a_question(spark):
    row = spark.range(1).select(chain.user_turn(F.lit("a {query} b"), F.lit("c {context} d")).alias("x")).first()["x"]
    assert row.startswith("Retrieved Documents:\na {query} b\n\nCurrent Question: c {context} d\n\nIMPORTANT")


def test_citation_positions_as_written(spark):
    scores = [("a", 0.5), ("b", 0.4), ("a", 0.5), ("c", None), ("b", 0.9), ("a", 0.6), ("d", 0.1), ("c", 0.0), ("b", 0.95), (None, 1.0)]
    hits = spark.createDataFrame([(1, k, n, k, "", "t", 1, s) for k, (n, s) in enumerate(scores, 1)], "q int, seq int, document_name string, document_db_id int, document_id string, text string, page_number int, score double")
    hits = hits.withColumn("document_db_id", F.when(F.col("document_name").isNotNull(), F.col("document_db_id")))
    seen, best = {}, {}  # the list as it is written
    for k, (name, score) in enumerate(scores, 1):
        if name is None or name in seen and (score or 0.0) <= best[name]:
            continue
        best[name] = score or 0.0
        seen[name] = (f"/documents/{k}", len(seen) + 1)
    got = {r["document_title"]: (r["document_url"], r["position"]) for r in ranking.best_citations(hits, ["q"], as_written=True).collect()}
    assert got == seen
    assert sorted((r["position"], r["document_title"]) for r in ranking.best_citations(hits, ["q"]).collect()) == [(1, "a"), (2, "b"), (3, "c"), (4, "d")]


def test_stage_records(spark):
    u = [(1, 1, "pending", 0, None, None, None), (1, 2, "in_progress", 10, "", 5, None), (1, 3, "failed", 12, "bad", None, None), (1, 4, "in_progress", 20, None, None, 7), (2, 1, "completed", 9, None, None, None), (3, 1, "in_progress", 1, None, None, None), (3, 2, "completed", 4, "note", 1, 2)]
    rows = spark.createDataFrame(u, "id int, seq int, status string, s long, error_message string, input_size int, output_size int").withColumn("ts", F.timestamp_seconds("s")).withColumn("place", F.lit("x")).drop("place")
    got = {r["id"]: (r["status"], r["started_at"] and int(r["started_at"].timestamp()), r["completed_at"] and int(r["completed_at"].timestamp()), r["duration_seconds"], r["error_message"], r["input_size"], r["output_size"]) for r in ps.stage_records(rows, ["id"]).collect()}
    assert got == {1: ("in_progress", 20, 12, 2.0, "bad", 5, 7), 2: ("completed", None, 9, None, None, None, None), 3: ("completed", 1, 4, 3.0, "note", 1, 2)}


def test_one_pass_over_a_page():
    import duckdb

    html = [r[0] for r in duckdb.sql("SELECT html FROM read_parquet('/root/testdata/sf0.001/pages.parquet')").fetchall()]
    odd = ["<title>a<b>c</title><h1/>x<h1>y</h1>", "<script><title>no</title></script><h1>h<script>1</script></h1>", "<meta name=author content=w/><title></title>", "<p>open <title>never closed", ""]
    assert all(pages.parts_of(h) == (*pages.head_of(h), pages.to_markdown(h)) for h in html + odd)


def test_lexical_boost(spark):
    def boost(query, text):
        q, t = (" ".join((x or "").lower().split()) for x in (query, text))
        ratio = len(set(q.split()) & set(t.split())) / max(len(set(q.split())), 1)
        return (0.7 * (q in t) + (0.4 if ratio >= 0.5 else 0.2 if ratio >= 0.3 else 0.0)) if q and t else 0.0

    queries = ["of  the THAT", "the", " a\u00a0b\u2003c d ", "", "  ", None]
    texts = ["of\u3000the\x1c\x85 that", "bother of\tthem", "The", " the", "a c", "ab cd", "", " \u2028", None, "é the É"]
    rows = spark.createDataFrame([(q, t) for q in queries for t in texts], "q string, t string")
    got = rows.select("q", "t", F.round(tx.lexical_boost(F.col("q"), F.col("t")), 4).alias("b"))
    assert [r["b"] for r in got.collect()] == [round(boost(r["q"], r["t"]), 4) for r in rows.collect()]
    assert str(got._jdf.queryExecution().optimizedPlan()).count("coalesce(t#") == 1  # a text is normalised once, not for each use


def peak_mb(work):
    tracemalloc.start()
    try:
        return work(), tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_chunks_in_parts():
    texts = [None, "", "x" * 3_000_000, *(f"Word {k}. Two!\n\n" * 2_000 for k in range(600))]
    batch = pa.RecordBatch.from_pydict({"id": list(range(len(texts))), "text": texts})
    for cut in (chunking.fixed, chunking.sentences, chunking.paragraphs):
        count = lambda: [(i, n) for b in chunking.chunk_batches([batch], cut) for i, n in zip(b["id"].to_pylist(), pc.list_value_length(b["chunks"]).to_pylist(), strict=True)]  # noqa: B023, E731
        got, peak = peak_mb(count)
        assert got == [(i, len(list(cut(t))) if t else 0) for i, t in enumerate(texts)]
        assert peak < 25  # 21 MB of text, of which 1 MB and the long text are worked on at once


def test_names_in_parts():
    names = pa.array([None, "", "é", *(f"Naïve {k} " * 2_000 for k in range(1_000))])
    got, peak = peak_mb(lambda: tx.to_ascii.func(names))
    assert got.to_pylist()[:4] == [None, "", "e", "Naive 0 " * 2_000] and len(got) == 1_003 and peak < 12


def test_scores_in_parts():
    rng = np.random.default_rng(1)
    q, p, groups = rng.normal(size=(2048, 8)), rng.normal(size=(2048, 8)), np.arange(2048) % 2
    ids = np.arange(2048)
    got, peak = peak_mb(lambda: [r for b in vectors.best_of_block(ids, q, ids[::-1], groups, p, 2, "g") for r in zip(*(c.to_pylist() for c in b.columns), strict=True)])
    assert peak < 25  # the scores of all pairs alone take 34 MB
    score = np.round(q @ p.T, 6)
    assert len(got) == 2048 * 4
    for query, group in ((0, 0), (1023, 1), (2047, 1)):
        best = sorted((-score[query, c], 2047 - c) for c in range(2048) if c % 2 == group and 2047 - c != query)[:2]
        assert [(i, s) for a, g, i, s in got if (a, g) == (query, group)] == [(i, -s) for s, i in best]
