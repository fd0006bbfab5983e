"""Document ingestion, pipeline state and streaming queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tallymill.functions import text as tx
from tallymill.operators import chunking
from tallymill.operators import pipeline_state as ps
from tallymill.sources import files, pages, uploads
from tallymill.streaming import keyed, state
from tallymill.streaming import usage as stream

from .standins import MESSAGES_SQL, documents, folder, table


def chunk_fixed(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return chunking.chunk_texts(docs, "fixed", 1000, 200).select("doc_id", "chunk_index", F.md5("chunk").alias("md5"), F.length("chunk").alias("n_chars"))


def _chunks(strategy):
    def query(spark, sf):
        docs = table(spark, sf, "documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))
        return chunking.chunk_texts(docs, strategy, 600, 120).select("doc_id", "chunk_index", F.md5("chunk").alias("md5"), F.length("chunk").alias("n_chars"))

    return query


def chunk_rows(spark, sf):
    """Line items of an order as rows of its sheet."""
    o = table(spark, sf, "lineitem")
    cells = F.array(F.col("l_partkey").cast("string"), F.concat("l_returnflag", F.lit("|x")), F.col("l_linenumber").cast("string"))
    rows = o.select(F.floor(F.col("l_orderkey") / 50).cast("string").alias("path"), F.lit("Items").alias("sheet"), F.array(*map(F.lit, ("part", "flag", "line"))).alias("header"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_idx"), cells.alias("cells"))
    rows = rows.groupBy("path", "sheet", "header", "row_idx").agg(F.min("cells").alias("cells"))
    return chunking.row_groups(rows, ["path"]).select("path", "chunk_index", "row_start", "row_end", F.length("chunk").alias("n_chars"), F.left("chunk", F.lit(40)).alias("head"))


def _write_files(rows, path):
    """Files of documents (bundle, number, text), twenty to a file: Markdown, DOCX and XLSX by turns. Writing a file again leaves the same file."""

    def run(batches):
        system, at = uploads.opened(path)
        system.create_dir(at, recursive=True)
        bundle, held = None, []

        def out():
            lines = [line for text in held for line in text.split("\n")]
            kind = ("md", "docx", "xlsx")[bundle % 3]
            data = "\n".join(lines).encode() if kind == "md" else files.docx_bytes(lines) if kind == "docx" else files.xlsx_bytes({"Lines": [["number", "line"], *([str(k), x] for k, x in enumerate(lines))]})
            with system.open_output_stream(f"{at}/{bundle:09d}.{kind}") as f:
                f.write(data)

        for batch in batches:
            for number, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if number != bundle and held:
                    out()
                    held = []
                bundle = number
                held.append(text or "")
        if held:
            out()
        yield from ()

    done = rows.repartition("bundle").sortWithinPartitions("bundle", "number").select("bundle", "number", "text").mapInArrow(run, "bundle long")
    done.write.format("noop").mode("overwrite").save()


def uploads_read(spark, sf):
    """Documents written as files, read back through the data source."""
    path = f"{folder(spark)}/uploads-{uuid.uuid4().hex}"
    _write_files(table(spark, sf, "documents").select(F.floor(F.col("doc_id") / 20).alias("bundle"), F.col("doc_id").alias("number"), "text"), path)
    uploads.register(spark)
    found = spark.read.format(uploads.FORMAT).load(path)
    bundle = F.regexp_extract("path", "([0-9]+)[.][a-z]+$", 1).cast("long").alias("bundle")
    texts = found.where("kind <> '.xlsx'").select(bundle, "kind", F.md5("text").alias("md5"), F.length("text").cast("long").alias("size"), "error")
    cells = uploads.workbook_rows(found).where("row_idx > 1")
    held = F.array_sort(F.collect_list(F.struct("row_idx", F.get("cells", F.lit(1)).alias("line"))))
    sheets = cells.groupBy("path").agg(F.array_join(F.transform(held, lambda r: r["line"]), "\n").alias("text"), F.count(F.lit(1)).alias("size"), F.max("error").alias("error"))
    return texts.unionByName(sheets.select(bundle, F.lit(".xlsx").alias("kind"), F.md5("text").alias("md5"), "size", "error"))


def text_metadata(spark, sf):
    return files.text_metadata(table(spark, sf, "documents").select("doc_id", "text")).drop("text")


def html_metadata(spark, sf):
    p = table(spark, sf, "pages")
    return p.select("page_id", pages.page_metadata("html").alias("m")).select("page_id", "m.*")


def page_documents(spark, sf):
    return pages.page_document(table(spark, sf, "pages"))


def scrape_names(spark, sf):
    p = table(spark, sf, "pages")
    label = F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("Label "), F.col("page_id")))
    title = F.when(F.col("page_id") % 3 == 0, "Untitled").when(F.col("page_id") % 3 == 1, F.concat(F.lit("Title "), F.col("page_id"), F.lit(".md")))
    return p.select("page_id", tx.scraped_name(label, title, F.col("url")).alias("name"), pages.normalise_url(F.regexp_replace("url", "^https?://", "")).alias("url"))


def s3_keys(spark, sf):
    p = table(spark, sf, "pages").select("page_id", F.regexp_extract("url", "^[a-z]+://[^/]+/(.*)$", 1).alias("k"))
    forms = [F.concat(F.lit("s3://bucket/"), "k"), F.concat(F.lit("https://bucket.s3.eu.amazonaws.com/"), "k"), F.concat(F.lit("https://s3.eu.amazonaws.com/bucket/"), "k"), F.concat(F.lit("bucket/"), "k"), F.concat(F.lit("https://cdn.example.com/bucket/"), "k"), F.lit("s3://bucket")]
    u = F.get(F.array(*forms), (F.col("page_id") % 6).cast("int"))
    return p.select("page_id", tx.s3_key(u, "bucket").alias("key"))


def upload_check(spark, sf):
    d = documents(spark, sf).select("id", F.concat("id", F.get(F.array(*map(F.lit, (".PDF", ".md", ".exe", "", ".xlsx"))), (F.col("id") % 5).cast("int"))).alias("path"), (F.col("n_chars") * 20_000).alias("length"))
    return d.select("id", files.upload_problem(F.col("path"), F.col("length")).alias("problem"), tx.mime_type(tx.extension(F.col("path"))).alias("mime"))


def safe_names(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.safe_filename(F.col("text")).alias("name"))


def price_match(spark, sf):
    """The first listed price whose name holds the model's or is held by it."""
    names = ["gpt-4o", "gpt-4o-mini", "gpt-4", "gpt-4-turbo", "gpt-3.5-turbo"]
    models = table(spark, sf, "events").select(F.get(F.array(*map(F.lit, ("gpt-4o-mini-2024", "GPT-4-turbo", "gpt-3.5-turbo-0125", "gpt", "claude"))), (F.col("user_id") % 5).cast("int")).alias("model")).groupBy("model").agg(F.count(F.lit(1)).alias("n"))
    return models.select("model", "n", tx.listed_name(F.col("model"), names).alias("price_name"))


def stage_records(spark, sf):
    """Events as updates of a stage: views begin it, purchases complete it, errors fail it, others leave it pending or carry sizes."""
    e = _events(spark, sf)
    kind = F.col("status")
    status = F.when(kind == "view", "in_progress").when(kind == "purchase", "completed").when(kind == "error", "failed").otherwise("pending")
    rows = e.select("document_id", F.floor(F.col("event_id") % 3).alias("stage"), F.col("event_id").alias("seq"), status.alias("status"), "ts", F.when(kind == "error", F.concat(F.lit("error "), "event_id")).when(kind == "view", "").alias("error_message"), F.when(F.col("event_id") % 4 == 0, F.col("event_id")).alias("input_size"), F.when(kind == "purchase", F.col("event_id") * 2).alias("output_size"))
    return ps.stage_records(rows, ["document_id", "stage"])


def _events(spark, sf):
    return table(spark, sf, "events").select("event_id", F.col("user_id").alias("document_id"), F.col("event_type").alias("status"), F.col("ts").cast("timestamp_ntz").alias("ts"), "value")


def latest_status(spark, sf):
    return ps.latest_status(_events(spark, sf), "document_id", "2024-01-30 23:00:00")


def stage_map(spark, sf):
    return ps.stage_map(_events(spark, sf), "document_id")


def last_errors(spark, sf):
    return ps.last_errors(_events(spark, sf), "document_id", "error", 10).select("document_id", "position", "event_id", "ts")


def active_jobs(spark, sf):
    return ps.active(_events(spark, sf), "document_id", "signup", "purchase")


def overlay(spark, sf):
    stored = documents(spark, sf).select(F.col("id").alias("document_id"), F.nullif("processing_status", F.lit("pending")).alias("status"))
    return ps.overlay(stored, ps.latest_status(_events(spark, sf), "document_id"), "document_id", "unknown")


def rate_limit(spark, sf):
    calls = _events(spark, sf).withColumn("key", F.col("document_id") % 30)
    return ps.rate_limited(calls, "key", 3, 7200).groupBy("key").agg(F.count_if("allowed").alias("allowed"), F.count_if(~F.col("allowed")).alias("refused"))


def session_batches(spark, sf):
    return ps.sessions(_events(spark, sf), "document_id", 6 * 3600).select("document_id", "first_at", "last_at", "n_events")


def stream_daily(spark, sf):
    e = stream.events(spark, sf)
    tokens = F.floor(F.col("value") * 100).cast("long")
    rows = e.select((F.col("user_id") % 10).alias("tenant_id"), F.when(F.col("event_type") == "error", "user").otherwise("assistant").alias("role"), F.when(F.col("event_id") % 50 != 0, F.concat("event_type", F.lit("-2024-07-18"))).alias("model_used"), tokens.alias("total_tokens"), F.col("ts").alias("created_at"))
    return stream.latest(stream.run(stream.daily_usage(rows), folder(spark)), ["tenant_id", "model_name", "usage_date"])


def stream_sessions(spark, sf):
    """Sessions of all events: those that the stream has closed when it ends."""
    out = stream.run(stream.sessions(stream.events(spark, sf), "user_id", "6 hours"), folder(spark), "append")
    return out.select("user_id", F.col("first_at").cast("timestamp_ntz").alias("first_at"), "n_events")


def stream_sliding(spark, sf):
    out = stream.latest(stream.run(stream.sliding_counts(stream.events(spark, sf)), folder(spark)), ["start", "event_type"])
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))


def stream_distinct(spark, sf):
    e = stream.events(spark, sf)
    twice = e.unionByName(stream.events(spark, sf))
    return stream.run(stream.distinct_events(twice), folder(spark), "append").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


def stream_rate_limit(spark, sf):
    rows = stream.events(keyed.streaming_session(spark), sf).select((F.col("user_id") % 30).alias("key"), "ts", "event_id")
    calls = stream.run(keyed.rate_limit("key", 3, 7200)(rows), folder(spark))
    return calls.groupBy("key").agg(F.sum("allowed").alias("allowed"), F.sum("refused").alias("refused"))


def _status_stream(spark, sf):
    return stream.events(spark, sf).select("event_id", F.col("user_id").alias("document_id"), F.col("event_type").alias("status"), "ts")


def stream_status(spark, sf):
    out = stream.latest(stream.run(state.latest_status("document_id")(_status_stream(spark, sf)), folder(spark)), ["document_id"])
    return out.select("document_id", "status", F.timestamp_micros("updated_us").cast("timestamp_ntz").alias("updated_at"), "n_events")


def stream_batches(spark, sf):
    rows = _status_stream(spark, sf).withColumn("batch_id", F.col("document_id") % 7)
    return stream.latest(stream.run(stream.batch_counts(rows, "batch_id", "purchase", "error"), folder(spark)), ["batch_id"])


def _keyed(spark, sf, operator):
    """The last update of each document by a keyed operator."""
    return stream.latest(stream.run(operator(_status_stream(keyed.streaming_session(spark), sf)), folder(spark)), ["document_id"])


def _stages(ttl_ms):
    def query(spark, sf):
        out = _keyed(spark, sf, keyed.stage_map("document_id", ttl_ms))
        return out.where("NOT expired").select("document_id", F.to_json("stages").alias("stages"))

    return query


def _active(ttl_ms):
    """Documents in work when the stream ends, with the time since when."""

    def query(spark, sf):
        out = _keyed(spark, sf, keyed.active("document_id", "signup", "purchase", ttl_ms))
        return out.where("started_us >= 0").select("document_id", F.timestamp_micros("started_us").cast("timestamp_ntz").alias("started_at"))

    return query


def _errors(ttl_ms):
    def query(spark, sf):
        out = _keyed(spark, sf, keyed.last_errors("document_id", "error", 10, ttl_ms))
        return out.where("NOT expired").select("document_id", F.array_join(F.transform("events", lambda e: e.cast("string")), ",").alias("events"))

    return query


def _meta(kind, name):
    """The content of the first meta element with the attribute, null without one; attributes come in any order."""
    tag = rf"""regexp_extract(html, '(?is)<meta\s[^>]*{kind}\s*=\s*["'']{name}["''][^>]*>')"""
    return rf"""CASE WHEN {tag} <> '' THEN {_plain(rf"regexp_extract({tag}, '(?is)content\s*=\s*[\x22\x27](.*?)[\x22\x27]', 1)")} END"""


def _element(tag):
    return rf"""CASE WHEN regexp_matches(html, '(?i)<{tag}[\s>]') THEN {_plain(rf"regexp_replace(regexp_extract(html, '(?is)<{tag}[^>]*>(.*?)</{tag}>', 1), '<[^>]*>', '', 'g')")} END"""


def _plain(x):
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
        x = f"replace({x}, '{entity}', '{char}')"
    return f"trim({x}, ' ' || chr(9) || chr(10) || chr(13))"


_EV = "ev AS (SELECT event_id, user_id AS document_id, event_type AS status, ts, value FROM events)"


def _fixed_walk(source, key, size, overlap):
    """Windows of about ``size`` characters of each text in ``source`` (key, text): piece (key, e, c) with the end and the text of each."""
    back = f"strpos(reverse(substr(text, s + 1, {size})), ' ')"
    return f"""walk AS (SELECT {key}, text, CAST(0 AS BIGINT) AS s, CAST(NULL AS BIGINT) AS e FROM {source} UNION ALL
 SELECT {key}, text, CASE WHEN nxt - {overlap} > cur THEN nxt - {overlap} ELSE nxt END, nxt FROM (SELECT {key}, text, s AS cur,
  CASE WHEN s + {size} < length(text) AND {size} - {back} > {size // 2} AND {back} > 0 THEN s + {size} - {back} ELSE s + {size} END AS nxt FROM walk WHERE s < length(text))),
 step AS (SELECT {key}, text, coalesce(lag(s) OVER w, 0) AS a, e FROM walk WINDOW w AS (PARTITION BY {key} ORDER BY e NULLS FIRST)),
 piece AS (SELECT {key}, e, trim(substr(text, a + 1, e - a), ' ' || chr(10) || chr(9) || chr(13)) AS c FROM step WHERE e IS NOT NULL)"""


_CHUNK = "RECURSIVE " + _fixed_walk("documents", "doc_id", 1000, 200)
_PARTED = "text AS (SELECT doc_id, replace(text, chr(10), chr(10) || chr(10)) AS t FROM documents WHERE trim(text, ' ' || chr(10) || chr(9) || chr(13)) <> '')"
#: Sums of the lengths of the first k parts, from k = 0.
_SUMS = "list_prepend(0, list_transform(range(1, len(parts) + 1), lambda k: list_sum(list_transform(parts[:k], lambda x: length(x)))))"
#: Chunk by chunk: parts f to e are held, j is the first that the chunk before did not have; parts are added while the sum fits.
_LAST = "greatest({j}, len(list_filter(sums, lambda x: x <= {size} + sums[{f}])) - 1)"


def _packed_walk(source, key, size, again):
    """Chunks (key, f, e) of the parts in ``source`` (key, parts, sums); ``again`` is the first part of w.f to w.e that the next chunk repeats."""
    return f"""pack AS (SELECT {key}, CAST(1 AS BIGINT) AS f, CAST({_LAST.format(j=1, f=1, size=size)} AS BIGINT) AS e FROM {source} UNION ALL
 SELECT {key}, f, CAST({_LAST.format(j='j', f='f', size=size)} AS BIGINT) FROM (SELECT {', '.join(f'w.{k.strip()}' for k in key.split(','))}, parts, sums, w.e + 1 AS j, CAST({again} AS BIGINT) AS f FROM pack w JOIN {source} b USING ({key}) WHERE w.e < len(parts)))"""


_SENTENCES = f"""RECURSIVE {_PARTED}, sentence AS (SELECT doc_id, string_split(regexp_replace(t, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS parts FROM text),
 summed AS (SELECT doc_id, parts, {_SUMS} AS sums FROM sentence), {_packed_walk('summed', 'doc_id', 600, 'greatest(w.f, 1 + len(list_filter(sums, lambda x: x < sums[w.e + 1] - 120)))')}
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY e) - 1 AS INT) AS chunk_index, md5(c) AS md5, CAST(length(c) AS INT) AS n_chars FROM (SELECT doc_id, e, array_to_string(parts[f:e], ' ') AS c FROM pack JOIN summed USING (doc_id))"""
_PARAGRAPHS = f"""RECURSIVE {_PARTED}, para AS (SELECT doc_id, x[k] AS text, k FROM (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(t, '\\n\\s*\\n'), lambda y: trim(y, ' ' || chr(10) || chr(9) || chr(13))), lambda y: y <> '') AS x FROM text), unnest(range(1, len(x) + 1)) AS u(k)),
 cut AS (SELECT *, sum(CASE WHEN length(text) > 600 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY k) AS run FROM para),
 long AS (SELECT doc_id, k, text FROM cut WHERE length(text) > 600), short AS (SELECT doc_id, run, min(k) AS k, list(text ORDER BY k) AS parts FROM cut WHERE length(text) <= 600 GROUP BY doc_id, run),
 summed AS (SELECT doc_id, k, parts, {_SUMS} AS sums FROM short), {_packed_walk('summed', 'doc_id, k', 600, 'CASE WHEN length(parts[w.e]) <= 120 THEN w.e ELSE w.e + 1 END')},
 {_fixed_walk('long', 'doc_id, k', 600, 120)},
 every AS (SELECT doc_id, k, e, array_to_string(parts[f:e], chr(10) || chr(10)) AS c FROM pack JOIN summed USING (doc_id, k) UNION ALL SELECT doc_id, k, e, c FROM piece WHERE c <> '')
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k, e) - 1 AS INT) AS chunk_index, md5(c) AS md5, CAST(length(c) AS INT) AS n_chars FROM every"""
_PYMETA = r"regexp_extract_all(text, '[^\s]+')"


def _kept(condition):
    """Events of each document after its last day of silence, of documents that were not silent for a day when the stream's watermark ended."""
    return f"""{_EV}, part AS (SELECT * FROM ev WHERE {condition}),
 gap AS (SELECT *, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 1 DAY THEN 1 ELSE 0 END AS new FROM part WINDOW w AS (PARTITION BY document_id ORDER BY ts, event_id)),
 run AS (SELECT *, sum(new) OVER (PARTITION BY document_id ORDER BY ts, event_id) AS r FROM gap),
 kept AS (SELECT * FROM run QUALIFY r = max(r) OVER (PARTITION BY document_id) AND max(ts) OVER (PARTITION BY document_id) + INTERVAL 1 DAY > (SELECT max(ts) - INTERVAL 1 DAY FROM part))"""


_RATE = """k AS (SELECT user_id % 30 AS key, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id % 30 ORDER BY ts, event_id) AS r FROM events),
 f AS (SELECT key, r, t, 1 AS n, t AS last, true AS ok FROM k WHERE r = 1 UNION ALL
  SELECT k.key, k.r, k.t, CASE WHEN k.t - f.last >= 7200000000 THEN 1 WHEN f.n < 3 THEN f.n + 1 ELSE f.n END, CASE WHEN k.t - f.last >= 7200000000 OR f.n < 3 THEN k.t ELSE f.last END, k.t - f.last >= 7200000000 OR f.n < 3
  FROM f JOIN k ON k.key = f.key AND k.r = f.r + 1)"""

QUERIES = {
    "chunk_fixed": chunk_fixed, "chunk_sentence": _chunks("sentence"), "chunk_paragraph": _chunks("paragraph"), "chunk_table_rows": chunk_rows, "text_metadata": text_metadata, "uploads_read": uploads_read, "html_metadata": html_metadata,
    "page_documents": page_documents, "scrape_name": scrape_names, "s3_key": s3_keys, "upload_check": upload_check, "safe_filename": safe_names, "price_match": price_match, "stage_records": stage_records,
    "pipeline_latest_status": latest_status, "pipeline_stage_map": stage_map, "pipeline_last_errors": last_errors, "pipeline_active_jobs": active_jobs, "pipeline_status_overlay": overlay,
    "rate_limit": rate_limit, "session_activity": session_batches, "stream_daily_usage": stream_daily, "stream_session_activity": stream_sessions, "stream_sliding_counts": stream_sliding,
    "stream_distinct_events": stream_distinct, "stream_rate_limit": stream_rate_limit, "stream_latest_status": stream_status, "stream_batch_counts": stream_batches,
    "stream_last_errors": _errors(None), "stream_stage_map": _stages(None), "stream_active_jobs": _active(None), "stream_last_errors_expiring": _errors(keyed.DAY_MS), "stream_stage_map_expiring": _stages(keyed.DAY_MS), "stream_active_jobs_expiring": _active(keyed.DAY_MS),
}

ORACLE_SQL = {
    "chunk_fixed": f"WITH {_CHUNK} SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY e) - 1 AS INT) AS chunk_index, md5(c) AS md5, CAST(length(c) AS INT) AS n_chars FROM piece WHERE c <> ''",
    "chunk_sentence": f"WITH {_SENTENCES}",
    "chunk_paragraph": f"WITH {_PARAGRAPHS}",
    "uploads_read": """WITH b AS (SELECT doc_id // 20 AS bundle, string_agg(coalesce(text, ''), chr(10) ORDER BY doc_id) AS t FROM documents GROUP BY 1),
 x AS (SELECT bundle, ['.md', '.docx', '.xlsx'][bundle % 3 + 1] AS kind, t, string_split(t, chr(10)) AS lines FROM b),
 r AS (SELECT bundle, kind, CASE kind WHEN '.md' THEN trim(t, ' ' || chr(9) || chr(10) || chr(13)) WHEN '.docx' THEN array_to_string(list_filter(lines, lambda y: trim(y, ' ' || chr(9) || chr(13)) <> ''), chr(10) || chr(10)) ELSE t END AS text, lines FROM x)
SELECT bundle, kind, md5(text) AS md5, CAST(CASE kind WHEN '.xlsx' THEN len(lines) ELSE length(text) END AS BIGINT) AS size, CAST(NULL AS VARCHAR) AS error FROM r""",
    "text_metadata": f"SELECT doc_id, length(text) - length(replace(text, chr(10), '')) + 1 AS line_count, len({_PYMETA}) AS word_count, length(text) AS character_count FROM documents",
    "scrape_name": r"""WITH p AS (SELECT page_id, url, CASE WHEN page_id % 5 = 0 THEN 'Label ' || page_id WHEN page_id % 3 = 1 THEN 'Title ' || page_id || '.md' ELSE left(replace(regexp_extract(url, '://([^/?#]*)', 1), 'www.', '') ||
 CASE WHEN regexp_extract(url, '://[^/?#]*/*([^?#]*?)/*(?:[?#]|$)', 1) <> '' THEN '_' || replace(regexp_extract(url, '://[^/?#]*/*([^?#]*?)/*(?:[?#]|$)', 1), '/', '_') ELSE '' END, 100) END AS name FROM pages)
SELECT page_id, CASE WHEN ends_with(name, '.md') THEN name ELSE name || '.md' END AS name, regexp_replace(url, '^https?://', 'https://') AS url FROM p""",
    "s3_key": r"WITH p AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/]+/(.*)$', 1) AS k FROM pages) SELECT page_id, nullif(CASE page_id % 6 WHEN 0 THEN k WHEN 5 THEN NULL WHEN 3 THEN k WHEN 4 THEN regexp_extract(k, '^[^?#]*') ELSE split_part(k, '?', 1) END, '') AS key FROM p",
    "upload_check": "SELECT doc_id AS id, CASE WHEN doc_id % 5 IN (2, 3) THEN 'unsupported type ' || CASE WHEN doc_id % 5 = 2 THEN '.exe' ELSE '' END WHEN n_chars * 20000 > 52428800 THEN 'too large' END AS problem, ['application/pdf', 'text/markdown; charset=utf-8', 'application/octet-stream', 'application/octet-stream', 'application/vnd.openxmlformats-officedocument.spreadsheetml.sheet'][doc_id % 5 + 1] AS mime FROM documents",
    "stage_records": """WITH u AS (SELECT user_id AS document_id, event_id % 3 AS stage, event_id AS seq, CASE event_type WHEN 'view' THEN 'in_progress' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'pending' END AS status, ts,
  CASE event_type WHEN 'error' THEN 'error ' || event_id WHEN 'view' THEN '' END AS m, CASE WHEN event_id % 4 = 0 THEN event_id END AS i, CASE WHEN event_type = 'purchase' THEN event_id * 2 END AS o FROM events),
 b AS (SELECT *, max(CASE WHEN status = 'in_progress' THEN seq END) OVER (PARTITION BY document_id, stage ORDER BY seq) AS s FROM u), t AS (SELECT b.*, u.ts AS begun FROM b LEFT JOIN u ON u.seq = b.s)
SELECT document_id, stage, arg_max(status, seq) AS status, arg_max(ts, seq) FILTER (status = 'in_progress') AS started_at, arg_max(ts, seq) FILTER (status IN ('completed', 'failed')) AS completed_at,
 arg_max((epoch_us(ts) - epoch_us(begun)) / 1000000, seq) FILTER (status IN ('completed', 'failed') AND begun IS NOT NULL) AS duration_seconds, arg_max(m, seq) FILTER (m <> '') AS error_message,
 arg_max(i, seq) FILTER (i IS NOT NULL) AS input_size, arg_max(o, seq) FILTER (o IS NOT NULL) AS output_size FROM t GROUP BY 1, 2""",
    "price_match": "WITH m AS (SELECT ['gpt-4o-mini-2024', 'GPT-4-turbo', 'gpt-3.5-turbo-0125', 'gpt', 'claude'][user_id % 5 + 1] AS model, count(*) AS n FROM events GROUP BY 1) SELECT model, n, list_filter(['gpt-4o', 'gpt-4o-mini', 'gpt-4', 'gpt-4-turbo', 'gpt-3.5-turbo'], lambda p: contains(lower(model), p) OR contains(p, lower(model)))[1] AS price_name FROM m",
    "pipeline_latest_status": f"WITH {_EV} SELECT document_id, arg_max(status, (ts, event_id)) AS status, max(ts) AS updated_at, count(*) AS n_events FROM ev GROUP BY 1 HAVING max(ts) > TIMESTAMP '2024-01-30 23:00:00' - INTERVAL 86400 SECOND",
    "pipeline_stage_map": f"WITH {_EV} SELECT document_id, status AS stage, arg_min(event_id, (ts, event_id)) AS first_event, min(ts) AS started_at, max(ts) AS last_at, count(*) AS runs FROM ev GROUP BY 1, 2",
    "pipeline_last_errors": f"WITH {_EV} SELECT document_id, CAST(row_number() OVER w AS INT) AS position, event_id, ts FROM ev WHERE status = 'error' WINDOW w AS (PARTITION BY document_id ORDER BY ts DESC, event_id DESC) QUALIFY row_number() OVER w <= 10",
    "pipeline_active_jobs": f"WITH {_EV}, b AS (SELECT document_id, max((ts, event_id)) FILTER (status = 'signup') AS b, max((ts, event_id)) FILTER (status = 'purchase') AS e, max(ts) FILTER (status = 'signup') AS started_at FROM ev GROUP BY 1) SELECT document_id, started_at FROM b WHERE b IS NOT NULL AND (e IS NULL OR e < b)",
    "pipeline_status_overlay": f"WITH {_EV}, l AS (SELECT document_id, arg_max(status, (ts, event_id)) AS s FROM ev GROUP BY 1) SELECT doc_id AS document_id, coalesce(s, [NULL, 'processing', 'completed', 'failed'][doc_id % 4 + 1], 'unknown') AS status FROM documents LEFT JOIN l ON doc_id = document_id",
    "rate_limit": f"WITH RECURSIVE {_RATE} SELECT key, count(*) FILTER (ok) AS allowed, count(*) FILTER (NOT ok) AS refused FROM f GROUP BY 1",
    "stream_rate_limit": f"WITH RECURSIVE {_RATE} SELECT key, count(*) FILTER (ok) AS allowed, count(*) FILTER (NOT ok) AS refused FROM f GROUP BY 1",
    "session_activity": f"WITH {_EV}, g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM ev WINDOW w AS (PARTITION BY document_id ORDER BY ts, event_id)), s AS (SELECT *, sum(new) OVER (PARTITION BY document_id ORDER BY ts, event_id) AS session FROM g) SELECT document_id, min(ts) AS first_at, max(ts) AS last_at, count(*) AS n_events FROM s GROUP BY document_id, session",
    "stream_daily_usage": f"WITH {MESSAGES_SQL} SELECT tenant_id, model_used AS model_name, CAST(created_at AS DATE) AS usage_date, CAST(sum(total_tokens) AS BIGINT) AS total_tokens, count(*) AS message_count FROM msg WHERE role = 'assistant' AND model_used IS NOT NULL GROUP BY ALL",
    "stream_session_activity": f"WITH {_EV}, g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM ev WINDOW w AS (PARTITION BY document_id ORDER BY ts, event_id)), s AS (SELECT *, sum(new) OVER (PARTITION BY document_id ORDER BY ts, event_id) AS session FROM g) SELECT document_id AS user_id, min(ts) AS first_at, count(*) AS n_events FROM s GROUP BY document_id, session HAVING max(ts) + INTERVAL 6 HOUR <= (SELECT max(ts) - INTERVAL 2 DAY FROM events)",
    "stream_sliding_counts": "SELECT time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL (h) HOUR AS start, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events, (VALUES (0), (1)) v(h) GROUP BY 1, 2",
    "html_metadata": f"""SELECT page_id, coalesce(nullif(coalesce({_element('title')}, {_meta('property', 'og:title')}, {_element('h1')}), ''), 'Untitled') AS title,
 coalesce({_meta('name', 'description')}, {_meta('property', 'og:description')}, '') AS description, coalesce({_meta('name', 'author')}, {_meta('property', 'article:author')}, '') AS author FROM pages""",
    "safe_filename": "WITH n AS (SELECT doc_id, trim(regexp_replace(regexp_replace(strip_accents(replace(text, 'ß', '')), '[^A-Za-z0-9_.-]', '-', 'g'), '-+', '-', 'g'), '-') AS n FROM documents) SELECT doc_id, CASE WHEN n = '' THEN 'conversation-report' ELSE n END AS name FROM n",
    "chunk_table_rows": """WITH r AS (SELECT CAST(l_orderkey // 50 AS VARCHAR) AS path, l_orderkey * 10 + l_linenumber AS row_idx, min([CAST(l_partkey AS VARCHAR), l_returnflag || '|x', CAST(l_linenumber AS VARCHAR)]) AS c FROM lineitem GROUP BY ALL),
 n AS (SELECT path, row_number() OVER (PARTITION BY path ORDER BY row_idx) AS n, count(*) OVER (PARTITION BY path) AS total, '| ' || c[1] || ' | ' || replace(c[2], '|', '\\|') || ' | ' || c[3] || ' |' AS line FROM r),
 g AS (SELECT path, CAST((n - 1) // 25 AS INT) AS chunk_index, CAST(min(n) AS INT) AS row_start, CAST(max(n) AS INT) AS row_end, '## Sheet: Items' || CASE WHEN any_value(total) > 25 THEN ' (rows ' || min(n) || '–' || max(n) || ')' ELSE '' END || chr(10) || chr(10) || '| part | flag | line |' || chr(10) || '| --- | --- | --- |' || chr(10) || string_agg(line, chr(10) ORDER BY n) AS chunk FROM n GROUP BY path, (n - 1) // 25)
SELECT path, chunk_index, row_start, row_end, CAST(length(chunk) AS INT) AS n_chars, left(chunk, 40) AS head FROM g""",
    "stream_latest_status": f"WITH {_EV} SELECT document_id, arg_max(status, (ts, event_id)) AS status, max(ts) AS updated_at, count(*) AS n_events FROM ev GROUP BY 1",
    "stream_last_errors": f"WITH {_EV}, r AS (SELECT * FROM ev WHERE status = 'error' QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY ts DESC, event_id DESC) <= 10) SELECT document_id, string_agg(event_id, ',' ORDER BY ts DESC, event_id DESC) AS events FROM r GROUP BY 1",
    "stream_batch_counts": "SELECT user_id % 7 AS batch_id, count(*) AS total, count(*) FILTER (event_type = 'purchase') AS completed, count(*) FILTER (event_type = 'error') AS failed FROM events GROUP BY 1",
    "stream_stage_map": f"""WITH {_EV}, l AS (SELECT document_id, status, arg_max(event_id, (ts, event_id)) AS e FROM ev GROUP BY 1, 2)
SELECT document_id, '{{' || string_agg('"' || status || '":' || e, ',' ORDER BY status) || '}}' AS stages FROM l GROUP BY 1""",
    "stream_active_jobs": f"WITH {_EV}, b AS (SELECT document_id, max((ts, event_id)) FILTER (status = 'signup') AS b, max((ts, event_id)) FILTER (status = 'purchase') AS e, max(ts) FILTER (status = 'signup') AS started_at FROM ev GROUP BY 1) SELECT document_id, started_at FROM b WHERE b IS NOT NULL AND (e IS NULL OR e < b)",
    "stream_last_errors_expiring": f"WITH {_kept("status = 'error'")} SELECT document_id, string_agg(event_id, ',' ORDER BY ts DESC, event_id DESC) AS events FROM (SELECT * FROM kept QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY ts DESC, event_id DESC) <= 10) GROUP BY 1",
    "stream_stage_map_expiring": f"""WITH {_kept('true')}, l AS (SELECT document_id, status, arg_max(event_id, (ts, event_id)) AS e FROM kept GROUP BY 1, 2)
SELECT document_id, '{{' || string_agg('"' || status || '":' || e, ',' ORDER BY status) || '}}' AS stages FROM l GROUP BY 1""",
    "stream_active_jobs_expiring": f"WITH {_kept("status IN ('signup', 'purchase')")}, b AS (SELECT document_id, max((ts, event_id)) FILTER (status = 'signup') AS b, max((ts, event_id)) FILTER (status = 'purchase') AS e, max(ts) FILTER (status = 'signup') AS started_at FROM kept GROUP BY 1) SELECT document_id, started_at FROM b WHERE b IS NOT NULL AND (e IS NULL OR e < b)",
    "stream_distinct_events": "SELECT event_type, count(*) AS n FROM events GROUP BY 1",
}
