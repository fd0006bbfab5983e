"""Listing, paging and configuration queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tallymill.functions.text import conversation_title
from tallymill.operators import config_history as ch
from tallymill.operators import listing as ls
from tallymill.operators import substring_index as si

from .standins import DOCUMENTS_SQL, documents, folder, table


def _turns(spark, sf):
    c = table(spark, sf, "conversations")
    return c.select(F.col("conv_id").alias("conversation_id"), F.col("turn").alias("id"), F.col("turn").alias("created_at"), "role", F.col("text").alias("content"))


def _conversations(spark, sf):
    return table(spark, sf, "conversations").groupBy(F.col("conv_id").alias("id")).agg(F.count(F.lit(1)).alias("n_turns"))


def last_message(spark, sf):
    return ls.last_messages(_turns(spark, sf))


def conversation_page(spark, sf):
    page = ls.sorted_page(_conversations(spark, sf), "n_turns", descending=True, offset=10, limit=25)
    return ls.with_preview(page, _turns(spark, sf))


def eager_children(spark, sf):
    """The first customers by name with their orders."""
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), "c_name").orderBy("c_name").limit(50)
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    held = ls.with_children(c, o, "o_custkey", ["o_orderkey"], "orders")
    return held.select("id", "c_name", F.coalesce(F.size("orders"), F.lit(0)).cast("long").alias("n_orders"), F.array_join(F.transform("orders", lambda x: x["o_orderkey"].cast("string")), ",").alias("order_keys"))


def context_window(spark, sf):
    return ls.recent(_turns(spark, sf), 3).select("conversation_id", "id", "role", "content")


def transcript(spark, sf):
    return ls.transcript(_turns(spark, sf), 600)


def sorted_page(spark, sf):
    return ls.sorted_page(documents(spark, sf), "file_size", descending=True, offset=20, limit=40).select("id", "name", "file_size")


def status_page(spark, sf):
    return ls.sorted_page(documents(spark, sf), "processing_status", offset=5, limit=40).select("id", "processing_status")


def search(spark, sf):
    return ls.filtered(documents(spark, sf), search="doc the%", exclude_failed=True).select("id", "name", "processing_status")


def substring(spark, sf):
    """The search of documents_ilike by an index of three-letter runs."""
    index = si.build(documents(spark, sf).select("id", "name", "processing_status"), f"{folder(spark)}/names-{uuid.uuid4().hex}")
    return ls.filtered(si.search(spark, index, "doc the%"), exclude_failed=True)


def status_counts(spark, sf):
    return ls.status_counts(documents(spark, sf), ["tenant_id"])


def batch_progress(spark, sf):
    rows = documents(spark, sf).where("batch_id <> 3 OR processing_status = 'completed'").where("batch_id <> 4 OR processing_status = 'failed'")
    return ls.batch_progress(rows.where("batch_id <> 5 OR processing_status IN ('completed', 'failed')"))


def length_stats(spark, sf):
    return ls.length_stats(documents(spark, sf), ["tenant_id", "document_type"])


def dedupe_rename(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 3).alias("tenant_id"), F.concat("p_brand", F.lit(" "), "p_size").alias("name"))
    return ls.rename_duplicates(p, ["tenant_id"])


def duplicate_names(spark, sf):
    p = table(spark, sf, "part").select((F.col("p_partkey") % 3).alias("tenant_id"), F.concat("p_brand", F.lit(" "), "p_size").alias("name"))
    return ls.duplicate_keys(p, ["tenant_id", "name"])


def default_config(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("tenant_id"), (F.col("o_orderstatus") == "P").alias("is_default"), F.col("o_orderdate").alias("created_at"))
    return ls.default_or_latest(o, ["tenant_id"]).select("tenant_id", "id", "is_default")


def titles(spark, sf):
    first = table(spark, sf, "conversations").where("turn = 0")
    return first.select("conv_id", conversation_title(F.col("text")).alias("title"))


def bulk_delete(spark, sf):
    wanted = documents(spark, sf).select((F.col("id") * 3).alias("id")).unionByName(documents(spark, sf).select("id").where("id % 5 = 0"))
    return ls.bulk_delete_plan(documents(spark, sf), wanted, 3)


def _configs(spark, sf):
    """A configuration for each customer, with a version for each order in order of date."""
    o = table(spark, sf, "orders")
    entry = F.struct(F.col("o_orderdate").cast("string").alias("timestamp"), F.col("o_orderkey"), F.col("o_orderpriority"), F.col("o_orderstatus"))
    held = o.groupBy(F.col("o_custkey").alias("id")).agg(F.array_sort(F.collect_list(entry)).alias("h"))
    version = lambda x, i: F.struct(i.cast("int").alias("version"), x["timestamp"].alias("timestamp"), F.create_map(F.lit("priority"), x["o_orderpriority"], F.lit("status"), x["o_orderstatus"]).alias("config"))
    return held.select("id", (F.col("id") % 10).alias("tenant_id"), F.transform("h", version).alias("config_version_history"))


def config_latest(spark, sf):
    c = _configs(spark, sf).select("id", F.get(F.filter("config_version_history", lambda h: h["version"] == F.array_max(F.transform("config_version_history", lambda x: x["version"]))), 0).alias("v"))
    return c.select("id", "v.version", F.col("v.config")["priority"].alias("priority"))


def config_update(spark, sf):
    """Two updates of even configurations; what the two ways of picking a missing index give."""
    c = _configs(spark, sf)
    change = lambda v: c.where("id % 2 = 0").select("id", F.create_map(F.lit("status"), F.lit(v)).alias("changes"), F.lit("2025-01-01").alias("timestamp"))
    c = ch.append_version(ch.append_version(c, change("X")), change("Y"))
    h = F.col("config_version_history")
    old, new = ch.pick(h, F.lit(99)), ch.pick(h, F.lit(99), "latest")
    return c.select("id", F.size(h).alias("n"), old["version"].alias("as_written"), new["version"].alias("latest"), new["config"]["status"].alias("status"), new["config"]["priority"].alias("priority"))


_TURNS = "turn AS (SELECT conv_id AS conversation_id, turn AS id, turn AS created_at, role, text AS content FROM conversations)"
_DOC = f"WITH {DOCUMENTS_SQL}"
_PARTS = "SELECT p_partkey AS id, p_partkey % 3 AS tenant_id, p_brand || ' ' || p_size AS name FROM part"
_HISTORY = """h AS (SELECT o_custkey AS id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS INT) AS version, o_orderpriority, o_orderstatus FROM orders)"""
_COUNTS = """count(*) AS total, count(*) FILTER (processing_status NOT IN ('processing', 'completed', 'failed')) AS pending, count(*) FILTER (processing_status = 'processing') AS processing,
 count(*) FILTER (processing_status = 'completed') AS completed, count(*) FILTER (processing_status = 'failed') AS failed"""

QUERIES = {
    "conversation_last_message": last_message, "conversation_page": conversation_page, "eager_children": eager_children, "recent_context_window": context_window, "transcript_budget": transcript,
    "documents_sorted_page": sorted_page, "documents_status_page": status_page, "documents_ilike": search, "documents_substring": substring, "status_counts": status_counts, "batch_progress": batch_progress,
    "chunk_length_stats": length_stats, "dedupe_rename": dedupe_rename, "duplicate_names": duplicate_names, "default_config_per_tenant": default_config, "title_from_first_message": titles,
    "bulk_delete_plan": bulk_delete, "latest_config_version": config_latest, "config_version_append": config_update,
}

ORACLE_SQL = {
    "conversation_last_message": f"WITH {_TURNS} SELECT conversation_id, id, role, content, created_at FROM turn QUALIFY row_number() OVER (PARTITION BY conversation_id ORDER BY created_at DESC, id DESC) = 1",
    "conversation_page": f"""WITH {_TURNS}, page AS (SELECT conv_id AS id, count(*) AS n_turns FROM conversations GROUP BY 1 ORDER BY 2 DESC, 1 DESC LIMIT 25 OFFSET 10),
 last AS (SELECT * FROM turn QUALIFY row_number() OVER (PARTITION BY conversation_id ORDER BY id DESC) = 1)
SELECT page.id, n_turns, CASE WHEN length(content) > 100 THEN left(content, 100) || '...' ELSE content END AS preview FROM page LEFT JOIN last ON page.id = conversation_id""",
    "eager_children": "SELECT c_custkey AS id, c_name, count(o_orderkey) AS n_orders, string_agg(o_orderkey, ',' ORDER BY o_orderkey) AS order_keys FROM (FROM customer ORDER BY c_name LIMIT 50) LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL",
    "recent_context_window": f"WITH {_TURNS} SELECT conversation_id, id, role, content FROM turn QUALIFY row_number() OVER (PARTITION BY conversation_id ORDER BY id DESC) <= 3",
    "transcript_budget": f"""WITH {_TURNS}, l AS (SELECT *, upper(role) || ': ' || coalesce(content, '') || chr(10) AS line FROM turn),
 f AS (SELECT * FROM l QUALIFY sum(length(line)) OVER (PARTITION BY conversation_id ORDER BY id DESC) <= 600)
SELECT conversation_id, count(*) AS n_messages, string_agg(line, '' ORDER BY id) AS transcript FROM f GROUP BY 1""",
    "documents_sorted_page": f"{_DOC} SELECT id, name, file_size FROM doc ORDER BY file_size DESC NULLS FIRST, id DESC LIMIT 40 OFFSET 20",
    "documents_status_page": f"{_DOC} SELECT id, processing_status FROM doc ORDER BY list_position(['pending', 'processing', 'completed', 'failed'], processing_status), id LIMIT 40 OFFSET 5",
    "documents_ilike": f"{_DOC} SELECT id, name, processing_status FROM doc WHERE name ILIKE '%doc the%%' AND processing_status <> 'failed'",
    "status_counts": f"{_DOC} SELECT tenant_id, {_COUNTS} FROM doc GROUP BY 1",
    "batch_progress": f"""{_DOC}, c AS (SELECT batch_id, {_COUNTS} FROM doc WHERE (batch_id <> 3 OR processing_status = 'completed') AND (batch_id <> 4 OR processing_status = 'failed')
 AND (batch_id <> 5 OR processing_status IN ('completed', 'failed')) GROUP BY 1)
SELECT *, CASE WHEN completed = total THEN 'completed' WHEN failed = total THEN 'failed' WHEN completed > 0 AND pending + processing > 0 THEN 'processing' WHEN completed > 0 THEN 'partial_success' ELSE 'processing' END AS batch_status,
 round_even((completed + failed) / total * 100, 2) AS progress, CASE WHEN processing > 0 AND completed > 0 THEN processing * 30 END AS seconds_left FROM c""",
    "chunk_length_stats": f"{_DOC} SELECT tenant_id, document_type, count(*) AS n_chunks, CAST(min(length(text)) AS BIGINT) AS min_chars, CAST(max(length(text)) AS BIGINT) AS max_chars, CAST(sum(length(text)) AS BIGINT) AS total_chars, CAST(sum(length(text)) // count(*) AS BIGINT) AS mean_chars FROM doc GROUP BY 1, 2",
    "dedupe_rename": f"SELECT id, tenant_id, CASE WHEN r > 1 THEN name || ' ' || r ELSE name END AS name FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id, name ORDER BY id) AS r FROM ({_PARTS}))",
    "duplicate_names": f"SELECT tenant_id, name FROM ({_PARTS}) GROUP BY 1, 2 HAVING count(*) > 1",
    "default_config_per_tenant": "SELECT o_custkey AS tenant_id, o_orderkey AS id, o_orderstatus = 'P' AS is_default FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus = 'P' DESC, o_orderdate DESC, o_orderkey DESC) = 1",
    "title_from_first_message": r"""WITH w AS (SELECT conv_id, trim(text, chr(10) || chr(9) || chr(13) || ' ') AS c, array_to_string(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')[1:7], ' ') AS t FROM conversations WHERE turn = 0),
 k AS (SELECT conv_id, c, CASE WHEN length(t) > 50 THEN CASE WHEN contains(left(t, 50), ' ') THEN regexp_replace(left(t, 50), ' [^ ]*$', '') ELSE left(t, 50) END ELSE t END AS t FROM w)
SELECT conv_id, CASE WHEN length(t) < length(c) THEN t || '...' ELSE t END AS title FROM k""",
    "bulk_delete_plan": f"{_DOC} SELECT w.id, CASE WHEN d.id IS NULL THEN 'not_found' WHEN d.tenant_id <> 3 THEN 'wrong_tenant' ELSE 'deleted' END AS outcome FROM (SELECT id * 3 AS id FROM doc UNION SELECT id FROM doc WHERE id % 5 = 0) w LEFT JOIN doc d USING (id)",
    "latest_config_version": f"WITH {_HISTORY} SELECT id, version, o_orderpriority AS priority FROM h QUALIFY row_number() OVER (PARTITION BY id ORDER BY version DESC) = 1",
    "config_version_append": f"""WITH {_HISTORY}, t AS (SELECT id, count(*) AS n, max_by(o_orderpriority, version) AS priority, max_by(o_orderstatus, version) AS status FROM h GROUP BY 1)
SELECT id, CAST(CASE WHEN id % 2 = 0 THEN n + 2 ELSE n END AS INT) AS n, CAST(CASE WHEN id % 2 = 0 THEN 0 ELSE n - 1 END AS INT) AS as_written, CAST(CASE WHEN id % 2 = 0 THEN n + 1 ELSE n - 1 END AS INT) AS latest,
 CASE WHEN id % 2 = 0 THEN 'Y' ELSE status END AS status, priority FROM t""",
}

ORACLE_SQL["documents_substring"] = ORACLE_SQL["documents_ilike"]
