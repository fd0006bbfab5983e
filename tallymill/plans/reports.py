"""Report, prompt and access queries, and one query in SQL text."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallymill.functions.register import register, views
from tallymill.functions.text import page_link
from tallymill.operators import ranking as rk
from tallymill.operators import report as rp
from tallymill.sources import files

from .standins import table


def _reports(spark, sf):
    """Turns of a conversation as lines of a report: headings, bullets, numbers, blanks and paragraphs by turn."""
    t = F.regexp_replace(F.replace("text", F.lit("ß"), F.lit("ss")), r"\s+", " ")
    forms = [F.concat(F.upper(t), F.lit(":")), F.concat(F.lit("•"), t), F.concat(F.lit("- "), t, F.lit(" **b** & <c>")), F.concat(F.lit("1. "), t), F.lit(""), F.concat(F.lit("* "), t), F.concat(F.lit("2) "), t), t]
    c = table(spark, sf, "conversations").select("conv_id", "turn", F.get(F.array(*forms), (F.col("turn") % 8).cast("int")).alias("line"))
    parts = F.array_sort(F.collect_list(F.struct("turn", "line")))
    return c.groupBy("conv_id").agg(F.array_join(F.transform(parts, lambda p: p["line"]), "\n").alias("text"))


def report_kinds(spark, sf):
    return rp.report_lines(_reports(spark, sf), "conv_id").groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_if("opens").alias("opened"), F.count_if("closes").alias("closed"))


def report_html(spark, sf):
    return rp.report_html(rp.report_lines(_reports(spark, sf), "conv_id"), "conv_id")


def status_lines(spark, sf):
    tools = F.array(*map(F.lit, ("search_knowledge_base", "find_relevant_documents", "list_documents", "search_tables", "get_document_details", "answer_faq_exact_match")))
    tool = F.get(tools, (F.col("conv_id") % 6).cast("int"))
    category = F.when(F.col("turn") % 2 == 0, "budget").otherwise("")
    return table(spark, sf, "conversations").select("conv_id", "turn", rp.status_line(tool, F.col("text"), category, F.col("conv_id")).alias("status"))


def summaries(spark, sf):
    none = F.array().cast("array<string>")
    d = table(spark, sf, "documents").select("doc_id", "lang", F.when(F.col("doc_id") % 5 > 0, F.col("text")).otherwise("").alias("s"), F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("a"), F.col("source"))).otherwise(none).alias("t"))
    return d.select("doc_id", rp.stored_summary(F.col("s"), F.col("t"), F.array("lang", F.lit("x"))).alias("stored"), rp.embedded_summary(F.nullif("lang", F.lit("en")), F.lit("2024"), F.col("s"), F.col("t"), none).alias("embedded"))


def families(spark, sf):
    names = F.get(F.array(*map(F.lit, ("gpt-4-turbo-preview", "gpt-4", "gpt-4o-2024", "o1-mini", "unknown"))), (F.col("user_id") % 5).cast("int"))
    return table(spark, sf, "events").groupBy(names.alias("model")).agg(F.count(F.lit(1)).alias("n")).withColumn("family", rp.first_prefix(F.col("model"), ["gpt-4-turbo", "gpt-4o", "gpt-4", "o1"], "gpt-4o-mini"))


def access(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", (F.col("o_custkey") % 10).alias("tenant_id"), F.col("o_custkey").alias("user_id"))
    mine = rp.accessible(rows, 3, "user", 13).withColumn("role", F.lit("user"))
    return mine.unionByName(rp.accessible(rows, 3, "admin").withColumn("role", F.lit("admin"))).unionByName(rp.accessible(rows, 3, "super_admin").withColumn("role", F.lit("super_admin"))).groupBy("role").agg(F.count(F.lit(1)).alias("n"))


def page_links(spark, sf):
    ext = F.when(F.col("page_id") % 2 == 0, ".pdf").otherwise(".md")
    return table(spark, sf, "pages").select("page_id", page_link(F.col("url"), ext, F.nullif(F.col("page_id") % 4, F.lit(2))).alias("link"))


def image_context(spark, sf):
    """Lines of documents as spans, five to a page and not in the order of their heights, with an image in the middle of each page."""
    lines = table(spark, sf, "documents").select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "\n")).alias("k", "text"))
    spans = lines.select("doc", F.floor(F.col("k") / 5).alias("page"), (F.col("k") * 3 % 5).cast("double").alias("y"), F.col("k").alias("seq"), "text")
    images = spans.groupBy("doc", "page").agg(F.min("seq").alias("image_id")).withColumn("y", F.col("page") % 5 - 0.5)
    return files.surrounding_text(images, spans).select("doc", "image_id", "text_before", "text_after")


def image_texts(spark, sf):
    """Every document's text around a caption, and the caption that its text alone would give."""
    d = table(spark, sf, "documents").select("doc_id", F.when(F.col("doc_id") % 4 > 0, F.col("text")).alias("b"), F.concat_ws(" ", F.lit(" a picture of"), "source").alias("c"), F.when(F.col("doc_id") % 3 > 0, F.col("text")).alias("a"))
    return d.select("doc_id", F.md5(rk.image_text(F.col("b"), F.col("c"), F.col("a"))).alias("md5"), rk.context_caption(F.col("b"), F.col("a")).alias("caption"))


def sql_text(spark, sf):
    """Users by nation with their orders, in SQL with a registered function."""
    register(spark)
    views(spark, sf, ["customer", "orders", "nation"])
    return spark.sql("""SELECT n_name, count(*) AS n_orders, CAST(sum(size(chunk_text(c_name, 'fixed', 10, 2))) AS BIGINT) AS pieces, round(sum(o_totalprice), 2) AS total
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderstatus = 'F' GROUP BY n_name""")


_LINE = """text AS (SELECT conv_id, turn, regexp_replace(replace(text, 'ß', 'ss'), '\\s+', ' ', 'g') AS t FROM conversations),
 line AS (SELECT conv_id, turn, trim(CASE turn % 8 WHEN 0 THEN upper(t) || ':' WHEN 1 THEN '•' || t WHEN 2 THEN '- ' || t || ' **b** & <c>' WHEN 3 THEN '1. ' || t WHEN 4 THEN '' WHEN 5 THEN '* ' || t WHEN 6 THEN '2) ' || t ELSE t END) AS line FROM text),
 k AS (SELECT *, CASE WHEN line = '' THEN 'blank' WHEN upper(line) = line AND lower(line) <> line AND length(line) > 3 THEN 'heading' WHEN regexp_matches(line, '^[-•*]') THEN 'bullet' WHEN regexp_matches(line, '^[0-9][.)] ') THEN 'number' ELSE 'paragraph' END AS kind FROM line WHERE NOT starts_with(line, '#')),
 g AS (SELECT *, kind = 'bullet' AND coalesce(lag(kind) OVER w, '') <> 'bullet' AS opens, kind = 'bullet' AND coalesce(lead(kind) OVER w, '') <> 'bullet' AS closes FROM k WINDOW w AS (PARTITION BY conv_id ORDER BY turn))"""
_HTML = "regexp_replace(replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\\*\\*([^*]+)\\*\\*', '<strong>\\1</strong>', 'g')"
_HEAD = "replace(replace(replace(replace(rtrim(line, ':'), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"
_BODY = _HTML.format(x="trim(regexp_replace(line, '^[-•* ]+', ''))")

QUERIES = {
    "report_line_kinds": report_kinds, "report_html": report_html, "status_lines": status_lines, "summary_texts": summaries, "model_family": families, "row_access": access,
    "page_links": page_links, "image_texts": image_texts, "image_context": image_context, "sql_text": sql_text,
}
ORACLE_SQL = {
    "report_line_kinds": f"WITH {_LINE} SELECT kind, count(*) AS n, count(*) FILTER (opens) AS opened, count(*) FILTER (closes) AS closed FROM g WHERE kind <> 'blank' GROUP BY 1",
    "report_html": f"""WITH {_LINE} SELECT conv_id, string_agg(CASE WHEN opens THEN '<ul>' || chr(10) ELSE '' END || CASE kind WHEN 'heading' THEN '<h2>' || {_HEAD} || '</h2>' WHEN 'bullet' THEN '<li>' || {_BODY} || '</li>' ELSE '<p>' || {_HTML.format(x='line')} || '</p>' END
 || CASE WHEN closes THEN chr(10) || '</ul>' ELSE '' END, chr(10) ORDER BY turn) AS html FROM g WHERE kind <> 'blank' GROUP BY 1""",
    "status_lines": """SELECT conv_id, turn, CASE conv_id % 6 WHEN 0 THEN 'Searching documents for ' || chr(39) || left(text, 60) || chr(39) || '…' WHEN 1 THEN 'Looking for documents about ' || chr(39) || left(text, 60) || chr(39) || '…'
 WHEN 2 THEN 'Listing available documents' || CASE WHEN turn % 2 = 0 THEN ' (budget)' ELSE '' END || '…' WHEN 3 THEN 'Searching financial/tabular data for ' || chr(39) || left(text, 60) || chr(39) || '…'
 WHEN 4 THEN 'Examining document ' || conv_id || '…' ELSE 'Running answer_faq_exact_match…' END AS status FROM conversations""",
    "summary_texts": """SELECT doc_id, CASE WHEN doc_id % 5 > 0 AND text <> '' THEN text || chr(10) || chr(10) ELSE '' END || CASE WHEN doc_id % 2 = 0 THEN 'Key topics: a; ' || source || chr(10) || chr(10) ELSE '' END || 'Key entities: ' || lang || '; x' AS stored,
 CASE WHEN lang <> 'en' THEN lang ELSE '' END || ' – 2024' || CASE WHEN doc_id % 5 > 0 AND text <> '' THEN chr(10) || text ELSE '' END || CASE WHEN doc_id % 2 = 0 THEN chr(10) || 'Topics: a; ' || source ELSE '' END AS embedded FROM documents""",
    "model_family": "WITH m AS (SELECT ['gpt-4-turbo-preview', 'gpt-4', 'gpt-4o-2024', 'o1-mini', 'unknown'][user_id % 5 + 1] AS model, count(*) AS n FROM events GROUP BY 1) SELECT model, n, coalesce(list_filter(['gpt-4-turbo', 'gpt-4o', 'gpt-4', 'o1'], lambda p: starts_with(model, p))[1], 'gpt-4o-mini') AS family FROM m",
    "row_access": "SELECT 'user' AS role, count(*) AS n FROM orders WHERE o_custkey = 13 HAVING count(*) > 0 UNION ALL SELECT 'admin', count(*) FROM orders WHERE o_custkey % 10 = 3 UNION ALL SELECT 'super_admin', count(*) FROM orders",
    "page_links": "SELECT page_id, CASE WHEN page_id % 2 = 0 AND nullif(page_id % 4, 2) <> 0 THEN url || '#page=' || nullif(page_id % 4, 2) ELSE url END AS link FROM pages",
    "image_context": """WITH line AS (SELECT doc_id AS doc, x[i] AS t, i - 1 AS k FROM (SELECT doc_id, string_split(text, chr(10)) AS x, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)),
 span AS (SELECT doc, k // 5 AS page, k * 3 % 5 AS y, k AS seq, trim(t, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t FROM line),
 image AS (SELECT doc, page, min(seq) AS image_id, page % 5 - 0.5 AS y FROM span GROUP BY doc, page),
 near AS (SELECT i.doc, i.image_id, string_agg(t, ' ' ORDER BY s.y, seq) FILTER (t <> '' AND s.y <= i.y) AS b, string_agg(t, ' ' ORDER BY s.y, seq) FILTER (t <> '' AND s.y > i.y) AS a FROM image i JOIN span s USING (doc, page) GROUP BY ALL)
SELECT doc, CAST(image_id AS INT) AS image_id, trim(right(coalesce(b, ''), 500)) AS text_before, trim(left(coalesce(a, ''), 500)) AS text_after FROM near""",
    "image_texts": """WITH d AS (SELECT doc_id, CASE WHEN doc_id % 4 > 0 THEN text END AS b, ' a picture of ' || source AS c, CASE WHEN doc_id % 3 > 0 THEN text END AS a FROM documents),
 e AS (SELECT *, concat_ws(' ', CASE WHEN b <> '' THEN trim(b, ' ' || chr(10)) END, trim(c), CASE WHEN a <> '' THEN trim(a, ' ' || chr(10)) END) AS whole, CAST((8000 - length(c) - 2) // 2 AS BIGINT) AS h FROM d),
 f AS (SELECT *, concat_ws(' ', CASE WHEN b <> '' THEN trim(right(b, 100), ' ' || chr(10)) END, CASE WHEN a <> '' THEN trim(left(a, 100), ' ' || chr(10)) END) AS k FROM e)
SELECT doc_id, md5(CASE WHEN length(whole) <= 8000 THEN whole ELSE trim(left(coalesce(b, ''), h) || ' ' || c || ' ' || left(coalesce(a, ''), h), ' ' || chr(10)) END) AS md5,
 CASE WHEN coalesce(b, '') = '' AND coalesce(a, '') = '' THEN 'Image from document' WHEN length(k) > 300 THEN left(k, 297) || '...' ELSE k END AS caption FROM f""",
    "sql_text": "SELECT n_name, count(*) AS n_orders, CAST(sum(CASE WHEN length(c_name) <= 8 THEN 1 ELSE CAST(ceil((length(c_name) - 0) / 8.0) AS INT) END) AS BIGINT) AS pieces, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderstatus = 'F' GROUP BY 1",
}
