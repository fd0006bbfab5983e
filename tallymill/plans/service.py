"""Documents, summaries, images and the whole retrieval chain as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallymill.operators import accounts, chunking
from tallymill.operators import chain as ch
from tallymill.operators import config_history as hist
from tallymill.operators import documents as dc
from tallymill.operators import listing as ls
from tallymill.operators import pipeline_state as ps
from tallymill.operators import vectors as vc
from tallymill.sources import files, tables

from .retrieval import VECTOR, _points, _texts
from .standins import DOCUMENTS_SQL, MESSAGES_SQL, documents, messages, table


def _documents(spark, sf):
    """Documents with a category, dates, a source's JSON and an error message."""
    d = documents(spark, sf)
    path = F.when(F.col("id") % 3 > 0, F.to_json(F.struct(F.concat(F.lit("/box/"), "source").alias("box_path"))))
    return d.select("*", F.col("id").alias("doc_id"), F.nullif("lang", F.lit("fr")).alias("doc_category"), F.when(F.col("id") % 2 == 0, "FY2024").alias("doc_date_range"), F.md5("text").alias("summary"), path.alias("source_metadata"), (F.col("id") % 6).cast("int").alias("chunk_count"), F.col("source").alias("source_type"), F.concat(F.lit("failed: "), "source").alias("error_message"))


def details(spark, sf):
    d = _documents(spark, sf)
    return dc.details(d, 15, 1).unionByName(dc.details(d, 16, 1)).unionByName(dc.details(d, -1, 1))


def completed(spark, sf):
    return dc.completed(_documents(spark, sf), 2, date_range="FY2024", search="doc")


def _errors(spark, sf):
    e = table(spark, sf, "events").where("event_type = 'error'")
    stage = F.get(F.array(*map(F.lit, dc.STAGES)), (F.col("event_id") % 5).cast("int"))
    return e.select(F.col("user_id").alias("document_id"), "ts", "event_id", stage.alias("stage"), F.col("props").alias("error"), (F.col("event_id") % 4).cast("int").alias("retry"))


def failures(spark, sf):
    return dc.failures(_documents(spark, sf), _errors(spark, sf))


def breakdown(spark, sf):
    e = table(spark, sf, "events")
    status = F.get(F.array(*map(F.lit, ("completed", "failed", "processing", "in_progress", "queued", None))), (F.col("event_id") % 6).cast("int"))
    stage = F.get(F.array(*map(F.lit, (*dc.STAGES, "other"))), (F.col("user_id") % 6).cast("int"))
    return dc.breakdown(e.select((F.col("user_id") % 10).alias("tenant_id"), status.alias("status"), stage.alias("stage")), ["tenant_id"])


def parents(spark, sf):
    """Orders with their customer."""
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("customer_id"))
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), "c_name", "c_acctbal")
    return dc.with_parent(o, c, "customer_id", "customer").select("o_orderkey", "customer.c_name", "customer.c_acctbal")


def lookups(spark, sf):
    """Customers with the names of their nation and its region."""
    n = table(spark, sf, "nation")
    names = n.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("value"))
    regions = n.join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("id"), F.col("r_name").alias("value"))
    c = table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("nation_id"), F.col("c_nationkey").alias("region_id"))
    return dc.with_lookups(c, {"nation": names, "region": regions}).select("c_custkey", "nation", "region")


def first_urls(spark, sf):
    """The first page of each host."""
    p = table(spark, sf, "pages").select("page_id", F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("host"))
    return dc.first_of_key(p, ["host"], "page_id")


def inserted(spark, sf):
    old = table(spark, sf, "labels").select("doc_id", "quality", "toxic")
    new = table(spark, sf, "documents").where("doc_id % 10 = 0").select("doc_id", F.lit(1).alias("quality"))
    return dc.appended(old, new).groupBy("quality", "toxic").agg(F.count(F.lit(1)).alias("n"), F.sum("doc_id").alias("total"))


def _configs(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("tenant_id"), (F.col("o_orderkey") % 3 == 0).alias("is_default"), F.col("o_orderdate").alias("created_at"))


def without_config(spark, sf):
    """The tenants' configurations less number 3."""
    return dc.without_config(_configs(spark, sf), 3)


def new_default(spark, sf):
    return hist.set_default(_configs(spark, sf), 5, 7).groupBy("tenant_id").agg(F.count_if("is_default").alias("n_default"))


def _histories(spark, sf):
    """A history in JSON for orders of even customers, from their columns for the others."""
    o = table(spark, sf, "orders")
    entry = F.struct(F.lit(1).alias("version"), F.lit("2024").alias("timestamp"), F.create_map(F.lit("top_k"), (F.col("o_orderkey") % 9).cast("string"), F.lit("title"), F.when(F.col("o_orderkey") % 4 > 0, F.col("o_orderpriority"))).alias("config"))
    old = F.when(F.col("o_custkey") % 2 == 0, F.to_json(F.array(entry), {"ignoreNullFields": "false"}))
    config = F.create_map(F.lit("top_k"), F.col("o_orderstatus"), F.lit("title"), F.lit(None).cast("string"))
    return o.select("o_orderkey", "o_orderpriority", dc.backfilled(old, F.lit("2023"), config).alias("history"))


def history_settings(spark, sf):
    """Histories filled and patched, then read by path: casts that do not fit are null."""
    h = _histories(spark, sf).withColumn("history", dc.patched(F.col("history"), "title", F.lit("none")))
    return h.select("o_orderkey", dc.last_setting(F.col("history"), "top_k", "int").alias("top_k"), dc.last_setting(F.col("history"), "title", "string").alias("title"))


def message_defaults(spark, sf):
    m = messages(spark, sf).withColumn("total_tokens", F.when(F.col("id") % 7 > 0, F.col("total_tokens")))
    return ls.message_defaults(m).groupBy("role", "model_used").agg(F.count(F.lit(1)).alias("n"), F.count("total_tokens").alias("n_tokens"), F.sum("total_tokens").alias("total"))


def stage_durations(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.col("user_id").alias("document_id"), F.col("ts").cast("timestamp_ntz").alias("ts"))
    return ps.durations(e, "document_id").groupBy("document_id").agg(F.count("seconds").alias("n"), F.sum("seconds").alias("seconds"))


def latest_order(spark, sf):
    """The newest order of each customer, and its highest number."""
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    by_key = dc.latest(o, ["o_custkey"], ["o_orderkey"]).select("o_custkey", F.col("o_orderkey").alias("highest"))
    return dc.latest(o, ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", F.col("o_orderkey").alias("newest")).join(by_key, "o_custkey")


def page_total(spark, sf):
    return dc.page_of(documents(spark, sf).select("id", "processing_status"), 3, 15)


def stage_lists(spark, sf):
    """The five kinds of events as stages of every user."""
    e = table(spark, sf, "events").select("event_id", F.col("user_id").alias("document_id"), F.col("event_type").alias("status"), F.col("ts").cast("timestamp_ntz").alias("ts"))
    return ps.stage_list(e, ["signup", "view", "click", "purchase", "refund"], e.select("document_id").distinct(), "document_id")


def sign_up_stages(spark, sf):
    """Customers' names as emails: users, signups and invitations among them by number."""
    c = table(spark, sf, "customer")
    email, k = F.col("c_name").alias("email"), F.col("c_custkey")
    users = c.where(k % 5 == 0).select(email, F.when(k % 3 > 0, k % 2 == 0).alias("email_verified"))
    signups = c.where(k % 4 == 0).select(email, (k % 8 == 0).alias("is_verified"), (k % 3 == 0).alias("pending"))
    invitations = c.where(k % 3 == 0).select(k.alias("id"), email, (k % 2 == 1).alias("valid"))
    asked = c.select(F.concat(F.lit(" "), F.upper("c_name"), F.lit(" ")).alias("email"))
    return accounts.stages(asked, users, signups, invitations.unionByName(invitations.withColumn("id", F.col("id") + 1_000_000)))


# points


def _summaries(spark, sf):
    """A summary of each document that has an embedding."""
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("vec_id").alias("document_id"), (F.col("label") % 3).alias("tenant_id"), "embedding")
    d = _documents(spark, sf).select(F.col("id").alias("document_id"), F.col("name").alias("document_name"), "doc_category", "doc_date_range", "summary", F.col("text").alias("summary_text"))
    return e.join(d, "document_id", "left")


def chunk_points(spark, sf):
    p = _points(spark, sf).drop("id").withColumn("document_name", F.when(F.col("document_id") % 2 == 0, F.col("document_name")))
    return vc.chunk_points(p).select("id", F.get_json_object("payload", "$.document_name").alias("name"), F.get_json_object("payload", "$.chunk_index").cast("int").alias("chunk_index"))


def image_points(spark, sf):
    i = table(spark, sf, "embeddings").select((F.col("label") % 3).alias("tenant_id"), F.floor(F.col("vec_id") / 4).cast("long").alias("document_id"), (F.col("vec_id") % 2).alias("page_number"), F.concat(F.lit("text "), "vec_id").alias("combined_text"), F.when(F.col("vec_id") % 3 > 0, F.concat(F.lit("picture "), "vec_id")).alias("caption"), "embedding")
    return vc.image_points(i).select("id", "document_id", "image_index", "type", "caption", F.get_json_object("payload", "$.combined_text").alias("text"))


def summary_upsert(spark, sf):
    """Summaries written again for even documents take the old ones' place."""
    old = vc.summary_points(_summaries(spark, sf).drop("id"))
    new = vc.summary_points(_summaries(spark, sf).drop("id").where("document_id % 2 = 0").withColumn("summary", F.lit("new")))
    return vc.upsert(old, new).select("id", "document_id", "summary", F.get_json_object("payload", "$.doc_category").alias("category"))


def summary_delete(spark, sf):
    """Without the summaries of every fifth document, and without tenant 2."""
    s = vc.summary_points(_summaries(spark, sf).drop("id"))
    return vc.drop_tenant(vc.delete(s, s.where("document_id % 5 = 0")), 2).select("id", "tenant_id", "document_id")


def relevant(spark, sf):
    return vc.relevant_documents(_summaries(spark, sf), VECTOR, 1)


def scroll(spark, sf):
    """All chunks of a document in order."""
    p = _points(spark, sf).withColumn("tenant_id", F.lit(0))
    return vc.scroll(p, 0, 7).select("id", "chunk_index")


def replaced(spark, sf):
    """Documents of even number processed again into two chunks each."""
    p = _points(spark, sf).select("id", "tenant_id", "document_id", "chunk_index")
    new = p.where("document_id % 2 = 0 AND chunk_index < 2").withColumn("id", F.col("id") + 500_000)
    return vc.replace_document(p, new)


def hit_ids(spark, sf):
    d = table(spark, sf, "documents").where("doc_id % 3 > 0").select((F.col("doc_id") + 1000).alias("id"), "doc_id")
    return vc.hits_with_ids(vc.top_k(_points(spark, sf), VECTOR, 20), d).select("id", "document_id", "document_db_id")


def deleted_everywhere(spark, sf):
    """What is left of each store when every third document goes."""
    stores = {"points": _points(spark, sf), "rows": table(spark, sf, "documents").select(F.col("doc_id").alias("document_id"))}
    left = tables.delete_documents(stores, table(spark, sf, "documents").where("doc_id % 3 = 0").select(F.col("doc_id").alias("document_id")))
    counts = [rows.agg(F.count(F.lit(1)).alias("n"), F.sum("document_id").alias("total")).withColumn("store", F.lit(name)) for name, rows in left.items()]
    return counts[0].unionByName(counts[1])


def chunk_payloads(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.create_map(F.lit("lang"), F.lit("?"), F.lit("kind"), F.lit("text")).alias("base"), F.create_map(F.lit("lang"), "lang", F.lit("_raw"), "text").alias("doc"), F.create_map(F.lit("source"), "source").alias("chunk"))
    p = chunking.chunk_payload(F.col("base"), F.col("doc"), F.col("chunk"))
    return d.select("doc_id", F.size(p).alias("n"), p["lang"].alias("lang"), p["kind"].alias("kind"), p["source"].alias("source"))


def uploads(spark, sf):
    """Files that are taken and those that are refused, by reason."""
    f = documents(spark, sf).select(F.concat("id", F.get(F.array(*map(F.lit, (".PDF", ".md", ".exe", "", ".xlsx"))), (F.col("id") % 5).cast("int"))).alias("path"), (F.col("n_chars") * 20_000).alias("length"))
    good, bad = files.split_uploads(f)
    return good.agg(F.count(F.lit(1)).alias("n")).select(F.lit("ok").alias("problem"), "n").unionByName(bad.groupBy("problem").agg(F.count(F.lit(1)).alias("n")))


def request(spark, sf):
    """The request for a question about conversation 1, and for a greeting."""
    turns = table(spark, sf, "conversations").where("conv_id = 1").select(F.col("conv_id").alias("conversation_id"), F.col("turn").alias("id"), F.col("turn").alias("created_at"), "role", F.col("text").alias("content"))
    points = _points(spark, sf)
    ask = lambda q: ch.request(points, _texts(spark, sf), _documents(spark, sf).withColumn("tenant_id", F.lit(1)), turns, q, VECTOR, 1)
    out = ask("What of the erst tion?").unionByName(ask("Hello there!"))
    return out.select("query", "query_type", "chunks_retrieved", "user_content", "answer", F.size("history").alias("n_history"), F.array_join(F.transform("citations", lambda c: F.concat_ws(" ", c["position"].cast("string"), c["document_url"])), ",").alias("citations"))


def requests(spark, sf):
    """A request for every conversation, in one job: a question or a greeting by number, every fourth one about four documents of its own."""
    points = _points(spark, sf).withColumn("tenant_id", F.col("document_id") % 3)
    docs = _documents(spark, sf).withColumn("tenant_id", F.col("id") % 3)
    turns = table(spark, sf, "conversations").select(F.col("conv_id").alias("conversation_id"), F.col("turn").alias("id"), F.col("turn").alias("created_at"), "role", F.col("text").alias("content"))
    c = F.col("conversation_id")
    asked = F.when(c % 5 == 0, "Hello there!").otherwise(F.concat(F.lit("What of {context} the erst "), c.cast("string"), F.lit("?")))
    tenant = F.when(c % 11 == 7, 9).otherwise(c % 3)
    own = F.when(c % 4 == 1, F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: c + k))
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("conversation_id"), "embedding")
    questions = turns.select("conversation_id").distinct().join(vectors, "conversation_id", "left").select(c.alias("request_id"), "conversation_id", tenant.alias("tenant_id"), asked.alias("query"), "embedding", own.alias("document_ids"))
    i = F.col("id").cast("string")
    images = points.where("id % 2 = 1").select("id", "tenant_id", "document_id", "embedding", F.concat(F.lit("/images/"), i).alias("image_url"), F.concat(F.lit("the picture "), i).alias("caption"), F.concat(F.lit("erst "), i).alias("text"), F.lit("what").alias("text_before"), F.lit(None).cast("string").alias("text_after"))
    out = ch.requests(points, _texts(spark, sf), docs, turns, questions, images, most_images=2)
    listed = lambda column, f: F.array_join(F.transform(column, f), ",")
    return out.select(
        "request_id", "query_type", "chunks_retrieved", F.md5("user_content").alias("user_content"), F.left("answer", F.lit(20)).alias("answer"), F.size("history").alias("n_history"),
        listed("citations", lambda x: F.concat_ws(" ", x["position"].cast("string"), x["document_url"])).alias("citations"), listed("images", lambda x: x["image_url"]).alias("images"),
    )


_DOC = f"WITH {DOCUMENTS_SQL}"
_FULL = f"""{_DOC}, full_doc AS (SELECT *, nullif(lang, 'fr') AS doc_category, CASE WHEN id % 2 = 0 THEN 'FY2024' END AS doc_date_range, md5(text) AS summary, CASE WHEN id % 3 > 0 THEN '/box/' || source END AS box_path FROM doc)"""
_NEAR = "list_cosine_similarity(CAST(embedding AS DOUBLE[]), [" + ", ".join(f"CAST({x!r} AS DOUBLE)" for x in VECTOR) + "])"
_STAGE_COUNTS = ", ".join(f"count(*) FILTER (event_id % 6 IN (2, 3) AND user_id % 6 = {k}) AS stage_{s}" for k, s in enumerate(("downloading", "extracting", "chunking", "embedding", "storing")))

#: The share of a query's words (``words``) among those of a text, and half the share found in it, at most 1.
_KEYS = "least(1.0, len(list_intersect(words, regexp_extract_all(lower({t}), '[a-z0-9]+'))) / len(words) + 0.5 * len(list_filter(words, lambda x: contains(lower({t}), x))) / len(words))"

QUERIES = {
    "document_details": details, "documents_completed": completed, "failed_documents": failures, "progress_breakdown": breakdown, "eager_parent": parents, "select_in_load": lookups, "first_per_key": first_urls,
    "bulk_insert": inserted, "config_delete_default": without_config, "config_set_default": new_default, "config_history_json": history_settings, "message_defaults": message_defaults, "stage_durations": stage_durations,
    "vector_chunk_points": chunk_points, "vector_image_points": image_points, "vector_summary_upsert": summary_upsert, "vector_summary_delete": summary_delete, "summary_search": relevant, "vector_scroll": scroll,
    "vector_replace_document": replaced, "vector_hit_ids": hit_ids, "delete_everywhere": deleted_everywhere, "chunk_payload": chunk_payloads, "upload_split": uploads, "retrieval_request": request, "retrieval_requests": requests, "latest_of_key": latest_order, "page_with_total": page_total, "stage_list": stage_lists, "sign_up_stages": sign_up_stages,
}

ORACLE_SQL = {
    "document_details": f"""{_FULL} SELECT CAST(w.id AS BIGINT) AS document_id, name, document_type, doc_category, summary, processing_status, box_path, CASE WHEN f.id IS NULL THEN 'Document ' || w.id || ' not found.' END AS error
FROM (VALUES (15), (16), (-1)) w(id) LEFT JOIN full_doc f ON f.id = w.id AND tenant_id = 1""",
    "documents_completed": f"""{_FULL} SELECT id AS document_id, name, document_type, coalesce(doc_category, '') AS doc_category, doc_date_range, CAST(id % 6 AS INT) AS chunk_count, source AS source_type FROM full_doc
WHERE tenant_id = 2 AND processing_status = 'completed' AND doc_date_range = 'FY2024' AND name ILIKE '%doc%'""",
    "failed_documents": f"""{_DOC}, e AS (SELECT user_id, ['downloading', 'extracting', 'chunking', 'embedding', 'storing'][event_id % 5 + 1] AS stage, props AS error, CAST(event_id % 4 AS INT) AS retry FROM events WHERE event_type = 'error'
 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)
SELECT id AS document_id, name, coalesce(stage, 'unknown') AS failed_at_stage, CASE WHEN user_id IS NULL THEN 'failed: ' || source ELSE error END AS error, coalesce(retry, 0) AS retry_count FROM doc LEFT JOIN e ON user_id = id WHERE processing_status = 'failed'""",
    "progress_breakdown": f"""SELECT user_id % 10 AS tenant_id, count(*) AS total, count(*) FILTER (event_id % 6 = 0) AS completed, count(*) FILTER (event_id % 6 = 1) AS failed, count(*) FILTER (event_id % 6 IN (2, 3)) AS processing,
 count(*) FILTER (event_id % 6 > 3) AS pending, {_STAGE_COUNTS} FROM events GROUP BY 1""",
    "eager_parent": "SELECT o_orderkey, c_name, c_acctbal FROM orders LEFT JOIN customer ON o_custkey = c_custkey",
    "select_in_load": "SELECT c_custkey, n_name AS nation, r_name AS region FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey",
    "first_per_key": "SELECT regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, min(page_id) AS page_id FROM pages GROUP BY 1",
    "bulk_insert": "SELECT quality, toxic, count(*) AS n, CAST(sum(doc_id) AS BIGINT) AS total FROM (SELECT doc_id, quality, toxic FROM labels UNION ALL SELECT doc_id, 1, NULL FROM documents WHERE doc_id % 10 = 0) GROUP BY 1, 2",
    "config_delete_default": """WITH c AS (SELECT o_orderkey AS id, o_custkey AS tenant_id, o_orderkey % 3 = 0 AS is_default, o_orderdate AS created_at FROM orders), gone AS (SELECT tenant_id AS t FROM c WHERE id = 3 AND is_default),
 r AS (SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY is_default DESC, created_at DESC, id DESC) AS r FROM c WHERE id <> 3) SELECT id, tenant_id, is_default OR (r = 1 AND tenant_id IN (SELECT t FROM gone)) AS is_default, created_at FROM r""",
    "config_set_default": "SELECT o_custkey AS tenant_id, CASE WHEN o_custkey = 5 THEN count(*) FILTER (o_orderkey = 7) ELSE count(*) FILTER (o_orderkey % 3 = 0) END AS n_default FROM orders GROUP BY 1",
    "config_history_json": """SELECT o_orderkey, CASE WHEN o_custkey % 2 = 0 THEN CAST(o_orderkey % 9 AS INT) END AS top_k, CASE WHEN o_custkey % 2 = 0 AND o_orderkey % 4 > 0 THEN o_orderpriority ELSE 'none' END AS title FROM orders""",
    "message_defaults": f"""WITH {MESSAGES_SQL}, m AS (SELECT role, model_used, CASE WHEN id % 7 > 0 THEN total_tokens END AS t FROM msg), d AS (SELECT role, CASE WHEN role = 'assistant' THEN coalesce(model_used, 'unknown') ELSE model_used END AS model_used, CASE WHEN role = 'assistant' THEN coalesce(t, 0) ELSE t END AS t FROM m)
SELECT role, model_used, count(*) AS n, count(t) AS n_tokens, CAST(sum(t) AS BIGINT) AS total FROM d GROUP BY 1, 2""",
    "stage_durations": """WITH d AS (SELECT user_id AS document_id, epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) - epoch_us(ts) AS us FROM events)
SELECT document_id, count(us) AS n, CAST(sum(us // 1000000) AS BIGINT) AS seconds FROM d GROUP BY 1""",
    "vector_chunk_points": """SELECT sha256((vec_id // 4) || '_chunk_' || (vec_id % 4)) AS id, CASE WHEN (vec_id // 4) % 2 = 0 THEN 'doc' || ((vec_id // 4) % 11) END AS name, CAST(vec_id % 4 AS INT) AS chunk_index FROM embeddings""",
    "retrieval_request": f"""WITH point AS (SELECT vec_id AS id, CAST(vec_id // 4 AS BIGINT) AS document_id, coalesce(text, '') AS text, 'doc' || ((vec_id // 4) % 11) AS document_name, round({_NEAR}, 6) AS score FROM embeddings LEFT JOIN documents ON doc_id = vec_id
  WHERE label % 3 = 1 AND vec_id // 4 IN (SELECT doc_id FROM documents WHERE doc_id % 4 = 2)),
 hit AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS rank FROM point QUALIFY rank <= 5),
 p AS (SELECT *, '[Source ' || rank || '] ' || document_name || ': ' AS prefix FROM hit),
 s AS (SELECT *, length(prefix) + length(text) AS n, sum(length(prefix) + length(text)) OVER (ORDER BY rank) AS total FROM p),
 o AS (SELECT *, sum(CAST(total > 8000 AS INT)) OVER (ORDER BY rank) AS over_, 8000 - (total - n) - length(prefix) - 5 AS room FROM s),
 l AS (SELECT *, CAST(least(2000, room) AS BIGINT) AS lim FROM o WHERE over_ <= 1),
 c AS (SELECT rank, CASE WHEN over_ = 0 THEN prefix || text WHEN room > 200 THEN prefix || CASE WHEN length(text) <= lim THEN text ELSE left(text, CAST(floor((lim - 19) * 0.8) AS BIGINT)) || '... [truncated] ...' || right(text, lim - 19 - CAST(floor((lim - 19) * 0.8) AS BIGINT)) END END AS part FROM l),
 k AS (SELECT coalesce(string_agg(part, chr(10) || chr(10) ORDER BY rank), '') AS context FROM c),
 r AS (SELECT count(*) AS n, coalesce(string_agg(rank || ' /documents/' || document_id, ',' ORDER BY rank), '') AS cited FROM hit),
 h AS (SELECT CAST(least(6, count(*)) AS INT) AS n_history FROM conversations WHERE conv_id = 1)
SELECT 'What of the erst tion?' AS query, CASE WHEN r.n > 0 THEN 'retrieval' ELSE 'no_results' END AS query_type, r.n AS chunks_retrieved, CASE WHEN r.n > 0 THEN 'Retrieved Documents:' || chr(10) || context || chr(10) || chr(10) || 'Current Question: What of the erst tion?' || chr(10) || chr(10)
 || 'IMPORTANT: Please answer the question using the information provided in the "Retrieved Documents" section above. If the answer is in the retrieved documents, provide it directly. Only say you don' || chr(39) || 't have information if the retrieved documents truly don' || chr(39) || 't contain relevant information about the question.' END AS user_content,
 CASE WHEN r.n = 0 THEN 'I couldn' || chr(39) || 't find any relevant information in the documents to answer your question. Please try rephrasing your query or ensure documents have been processed.' END AS answer, n_history, cited AS citations FROM k, r, h
UNION ALL SELECT 'Hello there!', 'casual', 0, 'Hello there!', NULL, n_history, '' FROM h""",
    "retrieval_requests": f"""WITH q AS (SELECT c.conv_id AS request_id, CASE WHEN conv_id % 11 = 7 THEN 9 ELSE conv_id % 3 END AS tenant_id, conv_id % 5 = 0 AS casual, conv_id % 4 = 1 AS own, CAST(embedding AS DOUBLE[]) AS asked,
  CASE WHEN conv_id % 5 = 0 THEN 'Hello there!' ELSE 'What of {{context}} the erst ' || conv_id || '?' END AS query FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN embeddings ON vec_id = conv_id),
 point AS (SELECT vec_id AS id, vec_id // 4 AS document_id, (vec_id // 4) % 3 AS tenant_id, CAST(embedding AS DOUBLE[]) AS embedding, text, 'doc' || ((vec_id // 4) % 11) AS document_name FROM embeddings LEFT JOIN documents ON doc_id = vec_id
  WHERE vec_id // 4 IN (SELECT doc_id FROM documents WHERE doc_id % 4 = 2)),
 scored AS (SELECT request_id, own, query, p.*, round(list_cosine_similarity(p.embedding, asked), 6) AS score FROM q JOIN point p USING (tenant_id) WHERE NOT casual AND asked IS NOT NULL),
 hit AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, id) AS rank FROM scored WHERE NOT own OR document_id BETWEEN request_id AND request_id + 3 QUALIFY rank <= 5),
 p AS (SELECT *, '[Source ' || rank || '] ' || document_name || ': ' AS prefix FROM hit),
 s AS (SELECT *, length(prefix) + length(coalesce(text, '')) AS n, sum(length(prefix) + length(coalesce(text, ''))) OVER (PARTITION BY request_id ORDER BY rank) AS total FROM p),
 o AS (SELECT *, sum(CAST(total > 8000 AS INT)) OVER (PARTITION BY request_id ORDER BY rank) AS over_, 8000 - (total - n) - length(prefix) - 5 AS room FROM s),
 l AS (SELECT *, CAST(least(2000, room) AS BIGINT) AS lim FROM o WHERE over_ <= 1),
 c AS (SELECT request_id, rank, CASE WHEN over_ = 0 THEN prefix || coalesce(text, '') WHEN room > 200 THEN prefix || CASE WHEN length(text) <= lim THEN text ELSE left(text, CAST(floor((lim - 19) * 0.8) AS BIGINT)) || '... [truncated] ...' || right(text, lim - 19 - CAST(floor((lim - 19) * 0.8) AS BIGINT)) END END AS part FROM l),
 k AS (SELECT request_id, coalesce(string_agg(part, chr(10) || chr(10) ORDER BY rank), '') AS context FROM c GROUP BY 1),
 r AS (SELECT request_id, count(*) AS n, string_agg(rank || ' /documents/' || document_id, ',' ORDER BY rank) AS cited FROM hit GROUP BY 1),
 pic AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, id) AS place FROM scored WHERE id % 2 = 1 QUALIFY place <= 6),
 w AS (SELECT *, list_distinct(regexp_extract_all(lower(query), '[a-z0-9]+')) AS words FROM pic),
 f AS (SELECT request_id, id, round(0.7 * score + 0.3 * (0.5 * {_KEYS.format(t="'the picture ' || id")} + 0.3 * {_KEYS.format(t="'erst ' || id")} + 0.2 * {_KEYS.format(t="'what'")}), 6) AS final FROM w),
 g AS (SELECT request_id, string_agg('/images/' || id, ',' ORDER BY final DESC, id) AS pictures FROM (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY final DESC, id) <= 2) GROUP BY 1),
 h AS (SELECT conv_id AS request_id, CAST(least(6, count(*)) AS INT) AS n_history FROM conversations GROUP BY 1),
 kind AS (SELECT q.*, n, context, cited, pictures, n_history, CASE WHEN casual THEN 'casual' WHEN tenant_id = 9 THEN 'no_documents' WHEN n IS NULL THEN 'no_results' ELSE 'retrieval' END AS query_type FROM q LEFT JOIN k USING (request_id) LEFT JOIN r USING (request_id) LEFT JOIN g USING (request_id) JOIN h USING (request_id))
SELECT request_id, query_type, coalesce(n, 0) AS chunks_retrieved, md5(CASE query_type WHEN 'casual' THEN query WHEN 'retrieval' THEN 'Retrieved Documents:' || chr(10) || context || chr(10) || chr(10) || 'Current Question: ' || query || chr(10) || chr(10)
 || 'IMPORTANT: Please answer the question using the information provided in the "Retrieved Documents" section above. If the answer is in the retrieved documents, provide it directly. Only say you don' || chr(39) || 't have information if the retrieved documents truly don' || chr(39) || 't contain relevant information about the question.' END) AS user_content,
 CASE query_type WHEN 'no_documents' THEN left('I don' || chr(39) || 't have any documents to search.', 20) WHEN 'no_results' THEN left('I couldn' || chr(39) || 't find any relevant', 20) END AS answer, n_history, coalesce(cited, '') AS citations, CASE WHEN query_type = 'retrieval' THEN coalesce(pictures, '') ELSE '' END AS images FROM kind""",
    "vector_image_points": """WITH i AS (SELECT vec_id // 4 AS d, label % 3 AS t, vec_id % 2 AS p, 'text ' || vec_id AS txt, CASE WHEN vec_id % 3 > 0 THEN 'picture ' || vec_id ELSE 'text ' || vec_id END AS caption FROM embeddings),
 n AS (SELECT *, CAST(row_number() OVER (PARTITION BY t, d ORDER BY p, txt) - 1 AS INT) AS image_index FROM i) SELECT sha256(d || '_image_' || image_index) AS id, CAST(d AS BIGINT) AS document_id, image_index, 'image' AS type, caption, txt AS text FROM n""",
    "vector_summary_upsert": f"{_FULL} SELECT sha256(vec_id || '_summary') AS id, vec_id AS document_id, CASE WHEN vec_id % 2 = 0 THEN 'new' ELSE summary END AS summary, doc_category AS category FROM embeddings LEFT JOIN full_doc ON id = vec_id",
    "vector_summary_delete": "SELECT sha256(vec_id || '_summary') AS id, CAST(label % 3 AS INT) AS tenant_id, vec_id AS document_id FROM embeddings WHERE vec_id % 5 <> 0 AND label % 3 <> 2",
    "summary_search": f"""{_FULL}, s AS (SELECT vec_id, round({_NEAR}, 6) AS score FROM embeddings WHERE label % 3 = 1), h AS (SELECT *, row_number() OVER (ORDER BY score DESC, vec_id) AS rank FROM s QUALIFY rank <= 5)
SELECT rank, vec_id AS document_id, coalesce(name, '') AS document_name, coalesce(doc_category, '') AS doc_category, coalesce(doc_date_range, '') AS doc_date_range, coalesce(summary, '') AS summary, round_even(score, 4) AS score FROM h LEFT JOIN full_doc ON id = vec_id""",
    "vector_scroll": "SELECT vec_id AS id, vec_id % 4 AS chunk_index FROM embeddings WHERE vec_id // 4 = 7",
    "vector_replace_document": """WITH p AS (SELECT vec_id AS id, CAST(label % 3 AS INT) AS tenant_id, CAST(vec_id // 4 AS BIGINT) AS document_id, vec_id % 4 AS chunk_index FROM embeddings), n AS (SELECT id + 500000 AS id, tenant_id, document_id, chunk_index FROM p WHERE document_id % 2 = 0 AND chunk_index < 2)
SELECT * FROM n UNION ALL SELECT * FROM p WHERE NOT EXISTS (FROM n WHERE n.tenant_id = p.tenant_id AND n.document_id = p.document_id)""",
    "vector_hit_ids": f"""WITH h AS (SELECT vec_id AS id, CAST(vec_id // 4 AS BIGINT) AS document_id FROM embeddings ORDER BY round({_NEAR}, 6) DESC, vec_id LIMIT 20)
SELECT h.id, document_id, CASE WHEN document_id % 3 > 0 THEN d.doc_id + 1000 END AS document_db_id FROM h LEFT JOIN documents d ON d.doc_id = document_id""",
    "delete_everywhere": """WITH g AS (SELECT doc_id FROM documents WHERE doc_id % 3 = 0) SELECT 'points' AS store, count(*) AS n, CAST(sum(vec_id // 4) AS BIGINT) AS total FROM embeddings WHERE vec_id // 4 NOT IN (FROM g)
UNION ALL SELECT 'rows', count(*), CAST(sum(doc_id) AS BIGINT) FROM documents WHERE doc_id NOT IN (FROM g)""",
    "chunk_payload": "SELECT doc_id, CAST(3 AS INT) AS n, lang, 'text' AS kind, source FROM documents",
    "latest_of_key": "SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS newest, max(o_orderkey) AS highest FROM orders GROUP BY 1",
    "sign_up_stages": """WITH c AS (SELECT lower(c_name) AS email, c_custkey AS k FROM customer),
 s AS (SELECT email, k, CASE WHEN k % 5 = 0 THEN CASE WHEN k % 3 > 0 AND k % 2 = 0 THEN 'fully_active' ELSE 'user_exists_unverified' END WHEN k % 4 = 0 THEN CASE WHEN k % 8 = 0 AND k % 3 = 0 THEN 'email_verified_pending_tenant_setup' ELSE 'signed_up_pending_verification' END
 WHEN k % 3 = 0 AND k % 2 = 1 THEN 'invited_pending_registration' ELSE 'not_signed_up' END AS stage FROM c)
SELECT email, stage, CASE stage WHEN 'fully_active' THEN 'login' WHEN 'user_exists_unverified' THEN 'verify_email' WHEN 'email_verified_pending_tenant_setup' THEN 'setup_tenant' WHEN 'signed_up_pending_verification' THEN 'verify_email'
 WHEN 'invited_pending_registration' THEN 'register_with_invite' ELSE 'register' END AS next_action, CASE WHEN stage = 'invited_pending_registration' THEN k + 1000000 END AS invitation_id FROM s""",
    "page_with_total": f"{_DOC} SELECT id, processing_status, count(*) OVER () AS total, greatest(1, (count(*) OVER () + 14) // 15) AS pages FROM doc ORDER BY id LIMIT 15 OFFSET 30",
    "stage_list": """WITH s AS (SELECT unnest(['signup', 'view', 'click', 'purchase', 'refund']) AS stage, CAST(unnest(range(0, 5)) AS INT) AS position), f AS (SELECT user_id, event_type, min(ts) AS started_at FROM events GROUP BY 1, 2)
SELECT u.user_id AS document_id, position, stage, started_at FROM (SELECT DISTINCT user_id FROM events) u CROSS JOIN s LEFT JOIN f ON f.user_id = u.user_id AND event_type = stage""",
    "upload_split": """WITH p AS (SELECT CASE WHEN doc_id % 5 IN (2, 3) THEN 'unsupported type ' || CASE WHEN doc_id % 5 = 2 THEN '.exe' ELSE '' END WHEN n_chars * 20000 > 52428800 THEN 'too large' ELSE 'ok' END AS problem FROM documents)
SELECT problem, count(*) AS n FROM p GROUP BY 1""",
}
