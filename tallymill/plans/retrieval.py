"""Vector search, ranking, citation and context queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tallymill.functions import text as tx
from tallymill.operators import ranking as rk
from tallymill.operators import vector_index as vi
from tallymill.operators import vectors as vc

from .standins import folder, table

QUERY = "the that of in and"
#: A fixed query vector.
VECTOR = [((7 * k * k + 3 * k) % 19 - 9) / 37 for k in range(64)]


def _points(spark, sf):
    """Embeddings as chunks of documents: tenant by label, four chunks a document. Their texts are the documents with the same numbers."""
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), (F.col("label") % 3).alias("tenant_id"), F.floor(F.col("vec_id") / 4).cast("long").alias("document_id"), (F.col("vec_id") % 4).alias("chunk_index"), "embedding")
    kind = F.get(F.array(*map(F.lit, (".pdf", ".xlsx", ".md"))), (F.col("document_id") % 3).cast("int"))
    return e.withColumn("document_type", kind).withColumn("document_name", F.concat(F.lit("doc"), F.col("document_id") % 11))


def _texts(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")


def _hits(spark, sf, k=40):
    """The k best points in rank order, with their whole texts, which are read for these alone."""
    return vc.ranked(vc.top_k(_points(spark, sf), VECTOR, k)).join(_texts(spark, sf), "id", "left")


def _columns(df):
    return df.select("id", "tenant_id", "document_id", "score", "distance")


def topk(spark, sf):
    return _columns(vc.top_k(_points(spark, sf), VECTOR, 10))


def topk_filtered(spark, sf):
    return _columns(vc.top_k(vc.payload_filter(_points(spark, sf), 1, document_types=[".pdf", ".xlsx"]), VECTOR, 10))


def topk_tables(spark, sf):
    return _columns(vc.top_k(vc.payload_filter(_points(spark, sf), 2, document_types=".xlsx"), VECTOR, 5))


def topk_each(spark, sf):
    """The three best points of every tenant for every vector whose id is divisible by 20."""
    queries = table(spark, sf, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("id"), "embedding")
    return vc.top_k_each(_points(spark, sf), queries, 3, "tenant_id")


def _index(spark, sf):
    """The index of all points, their schema, and every vector whose id is divisible by 20 as queries."""
    queries = table(spark, sf, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("id"), "embedding")
    points = _points(spark, sf)
    return vi.build(points, f"{folder(spark)}/vectors-{uuid.uuid4().hex}"), points.schema, queries


def index_each(spark, sf):
    """As topk_each, by an index of which all lists are read."""
    index, schema, queries = _index(spark, sf)
    return vi.search_each(spark, index, schema, queries, 3, len(index.centroids), "tenant_id")


def index_one(spark, sf):
    """The ten best points of a tenant by the index; lists are read until there are ten."""
    index, schema, _ = _index(spark, sf)
    return _columns(vi.search(spark, index, schema, VECTOR, 10, len(index.centroids), tenant_id=1, document_types=[".pdf", ".xlsx"]))


def index_recall(spark, sf):
    """Of the ten nearest of each query over all points, how many the index finds with the number of lists that it has measured."""
    index, schema, queries = _index(spark, sf)
    found = vi.search_each(spark, index, schema, queries, 10)
    exact = vc.top_k_each(_points(spark, sf).withColumn("all", F.lit(0)), queries, 10, "all")
    return vi.recall(found, exact)


def search_ids(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("doc_id").alias("doc_id"))
    return _columns(vc.search(_points(spark, sf), docs, VECTOR, 0, wanted=[1, 2, 3, 10, 20, 30], k=5))


def stats(spark, sf):
    return vc.statistics(_points(spark, sf))


def delete(spark, sf):
    targets = _points(spark, sf).where("document_id % 5 = 0").select("tenant_id", "document_id")
    return vc.delete(_points(spark, sf), targets).select("id", "tenant_id", "document_id")


def upsert(spark, sf):
    points = _points(spark, sf).join(_texts(spark, sf), "id", "left").select("id", "document_id", F.md5("text").alias("text"))
    new = points.where("id % 10 = 0").withColumn("text", F.lit("new")).withColumn("id", F.when(F.col("id") % 20 == 0, F.col("id")).otherwise(F.col("id") + 1_000_000))
    return vc.upsert(points, new)


def patch(spark, sf):
    changes = _points(spark, sf).where("document_id % 4 = 0").select("tenant_id", "document_id", F.lit("renamed").alias("document_name"), F.lit(None).cast("string").alias("document_type")).distinct()
    return vc.patch(_points(spark, sf), changes, ["document_name", "document_type"]).select("id", "document_name", "document_type")


def rerank(spark, sf):
    return rk.lexical_rerank(_hits(spark, sf), F.lit(QUERY), 10).select("id", "rank", "combined_score")


def boosts(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.round(tx.lexical_boost(F.lit("Of the THAT   zzz"), F.col("text")), 4).alias("boost"))


def keywords(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.round(tx.keyword_score(F.lit("The erst tion, zzzz"), F.col("text")), 6).alias("score"))


def faq(spark, sf):
    """Two questions: the second line of document 5, numbered and with a question mark, and one that no document answers."""
    hits = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text", (F.col("doc_id") % 10 / 10).alias("score"), F.col("doc_id").alias("rank"), F.col("doc_id").alias("document_id"), F.concat(F.lit("doc"), "doc_id").alias("document_name"), F.lit(1).alias("page_number"), F.lit(0).alias("chunk_index"))
    docs = table(spark, sf, "documents").where("doc_id % 2 = 1").select(F.col("doc_id") + 100_000, "doc_id").toDF("id", "doc_id")
    asked = [rk.faq_match(hits, docs, F.lit(q)) for q in ("  3) The and  ATTION to thanedble the, anea. Eriner thanea.?! ", "zzqx zzqy zzqz?")]
    return asked[0].unionByName(asked[1])


def citations_best(spark, sf):
    hits = _hits(spark, sf).select("tenant_id", F.col("rank").alias("seq"), "document_name", F.col("document_id").alias("document_db_id"), F.lit("").alias("document_id"), "text", F.lit(1).alias("page_number"), "score")
    return rk.best_citations(hits, ["tenant_id"])


def citations_as_written(spark, sf):
    """Citations of every tenant's chunks in the order of their ids, so that better chunks come after worse ones."""
    hits = vc.ranked(vc.top_k(_points(spark, sf), VECTOR, 200)).select((F.col("id") % 3).alias("tenant_id"), F.col("id").alias("seq"), "document_name", F.col("document_id").alias("document_db_id"), F.lit("").alias("document_id"), F.lit("t").alias("text"), F.lit(1).alias("page_number"), "score")
    return rk.best_citations(hits, ["tenant_id"], as_written=True).select("tenant_id", "document_title", "document_url", "position")


def _by_metric(metric):
    def query(spark, sf):
        return vc.top_k(_points(spark, sf).withColumn("type", F.when(F.col("id") % 3 == 0, "image").otherwise("chunk")).transform(vc.payload_filter, 1, kind="image"), VECTOR, 10, metric).select("id", "score", "distance")

    return query


def citations(spark, sf):
    docs = table(spark, sf, "documents").where("doc_id % 3 > 0").select(F.col("doc_id").alias("id"), "doc_id")
    return rk.citations(_hits(spark, sf, 12), docs)


def context(spark, sf):
    return rk.pack_context(_hits(spark, sf).withColumn("tenant_id", F.col("tenant_id").cast("long")), ["tenant_id"])


def casual(spark, sf):
    """Greetings with a role or a word after them, and whole turns."""
    q = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("Thanks "), "role", F.lit("!"))).when(F.col("turn") % 3 == 1, F.concat_ws(" ", F.lit("good MORNING to"), "role", F.lit("and all the others here?"))).otherwise(F.col("text"))
    c = table(spark, sf, "conversations").select("conv_id", "turn", q.alias("q"))
    return c.select("conv_id", "turn", tx.is_casual(F.col("q")).alias("casual"))


def images(spark, sf):
    hits = vc.top_k(_points(spark, sf), VECTOR, vc.over_fetch(10)).select("id", "score")
    captions = table(spark, sf, "documents").where("doc_id % 4 <> 1").select(F.col("doc_id").alias("id"), F.concat_ws(" ", F.lit("the picture of"), "source").alias("caption"), "text", F.col("lang").alias("text_before"), F.lit(None).cast("string").alias("text_after"))
    return rk.image_rank(hits, captions, F.lit("the of erst"), 10).select("id", "keyword_score", "final_score")


_Q = "[" + ", ".join(f"CAST({x!r} AS DOUBLE)" for x in VECTOR) + "]"
_POINTS = """point AS (SELECT vec_id AS id, CAST(label % 3 AS INT) AS tenant_id, CAST(vec_id // 4 AS BIGINT) AS document_id, vec_id % 4 AS chunk_index, CAST(embedding AS DOUBLE[]) AS embedding, text,
 ['.pdf', '.xlsx', '.md'][(vec_id // 4) % 3 + 1] AS document_type, 'doc' || ((vec_id // 4) % 11) AS document_name FROM embeddings LEFT JOIN documents ON doc_id = vec_id)"""
_SCORED = f"{_POINTS}, scored AS (SELECT *, round(list_cosine_similarity(embedding, {_Q}), 6) AS score, round(1 - round(list_cosine_similarity(embedding, {_Q}), 6), 6) AS distance FROM point)"
_TOP = "SELECT id, tenant_id, document_id, score, distance FROM scored {where} ORDER BY score DESC, id LIMIT {k}"
_HITS = f"{_SCORED}, hit AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS rank FROM (FROM scored ORDER BY score DESC, id LIMIT {{k}}))"
_NORM = r"trim(regexp_replace(lower({c}), '\s+', ' ', 'g'))"
_WORDS = "list_distinct(list_filter(string_split({c}, ' '), lambda x: x <> ''))"


def _boost_sql(q: str, text: str) -> str:
    n = _NORM.format(c=text)
    words = "[" + ", ".join(f"'{w}'" for w in dict.fromkeys(q.split())) + "]"
    ratio = f"len(list_intersect({words}, {_WORDS.format(c=n)})) / {len(dict.fromkeys(q.split()))}"
    return f"CASE WHEN {n} = '' THEN 0 ELSE CASE WHEN contains({n}, '{q}') THEN 0.7 ELSE 0 END + CASE WHEN {ratio} >= 0.5 THEN 0.4 WHEN {ratio} >= 0.3 THEN 0.2 ELSE 0 END END"


def _keyword_sql(words: list[str], text: str) -> str:
    lw = "[" + ", ".join(f"'{w}'" for w in words) + "]"
    tokens = rf"regexp_extract_all(lower({text}), '[\p{{L}}\p{{N}}_]+')"
    exact = f"len(list_intersect({lw}, list_distinct({tokens}))) / {len(words)}"
    part = " + ".join(f"CAST(contains(lower({text}), '{w}') AS INT)" for w in words)
    return f"CASE WHEN coalesce({text}, '') = '' THEN 0 ELSE least(1, {exact} + ({part}) / {len(words)} * 0.5) END"


_FAQ_Q = "the and attion to thanedble the, anea. eriner thanea"
QUERIES = {
    "vector_topk": topk, "vector_topk_filtered": topk_filtered, "vector_topk_tables": topk_tables, "vector_topk_per_tenant": topk_each, "vector_index_per_tenant": index_each, "vector_index_filtered": index_one, "vector_index_recall": index_recall, "vector_search_ids": search_ids, "vector_stats": stats,
    "vector_delete": delete, "vector_upsert": upsert, "vector_patch": patch, "lexical_boost_rerank": rerank, "lexical_boost": boosts, "keyword_score": keywords, "faq_match": faq,
    "citations_best_per_doc": citations_best, "citations": citations, "citations_as_written": citations_as_written, "vector_topk_dot": _by_metric("dot"), "vector_topk_l2": _by_metric("l2"), "context_pack": context, "casual_query": casual, "image_rank": images,
}

_NQ = r"regexp_replace(trim(regexp_replace(lower(regexp_replace({c}, '^\s*[0-9]+[.):\-\s]+', '')), '\s+', ' ', 'g')), '[?.!]+$', '')"
ORACLE_SQL = {
    "vector_topk": f"WITH {_SCORED} {_TOP.format(where='', k=10)}",
    "vector_topk_filtered": f"WITH {_SCORED} " + _TOP.format(where="WHERE tenant_id = 1 AND document_type IN ('.pdf', '.xlsx')", k=10),
    "vector_topk_tables": f"WITH {_SCORED} " + _TOP.format(where="WHERE tenant_id = 2 AND document_type = '.xlsx'", k=5),
    "vector_topk_per_tenant": f"WITH {_POINTS} SELECT q.vec_id AS query_id, tenant_id, CAST(row_number() OVER w AS INT) AS rank, id, score FROM (SELECT vec_id, p.id, CAST(p.tenant_id AS BIGINT) AS tenant_id, round(list_cosine_similarity(p.embedding, CAST(e.embedding AS DOUBLE[])), 6) AS score FROM point p JOIN embeddings e ON vec_id % 20 = 0 AND vec_id <> id) q WINDOW w AS (PARTITION BY vec_id, tenant_id ORDER BY score DESC, id) QUALIFY row_number() OVER w <= 3",
    "vector_index_filtered": f"WITH {_SCORED} " + _TOP.format(where="WHERE tenant_id = 1 AND document_type IN ('.pdf', '.xlsx')", k=10),
    "vector_search_ids": f"WITH {_SCORED} " + _TOP.format(where="WHERE tenant_id = 0 AND document_id IN (1, 2, 3, 10, 20, 30)", k=5),
    "vector_stats": f"WITH {_POINTS} SELECT tenant_id, count(*) AS total_points, count(DISTINCT document_id) AS unique_documents FROM point GROUP BY 1",
    "vector_delete": f"WITH {_POINTS} SELECT id, tenant_id, document_id FROM point WHERE document_id % 5 <> 0",
    "vector_upsert": f"WITH {_POINTS}, n AS (SELECT CASE WHEN id % 20 = 0 THEN id ELSE id + 1000000 END AS id, document_id, 'new' AS text FROM point WHERE id % 10 = 0) SELECT * FROM n UNION ALL SELECT id, document_id, md5(text) FROM point WHERE id NOT IN (SELECT id FROM n)",
    "vector_patch": f"WITH {_POINTS} SELECT id, CASE WHEN document_id % 4 = 0 THEN 'renamed' ELSE document_name END AS document_name, document_type FROM point",
    "lexical_boost_rerank": f"WITH {_HITS.format(k=40)} SELECT id, rank, round(score + {_boost_sql(QUERY, 'text')}, 4) AS combined_score FROM hit ORDER BY 3 DESC, rank LIMIT 10",
    "lexical_boost": f"SELECT doc_id, CAST({_boost_sql('of the that zzz', 'text')} AS DOUBLE) AS boost FROM documents",
    "keyword_score": f"SELECT doc_id, round({_keyword_sql(['the', 'erst', 'tion', 'zzzz'], 'text')}, 6) AS score FROM documents",
    "faq_match": f"""WITH l AS (SELECT doc_id AS id, text, doc_id % 10 / 10 AS score, contains({_NQ.format(c='text')}, '{_FAQ_Q}') AS whole,
  list_filter(list_transform(string_split(text, chr(10)), lambda x: {_NQ.format(c='x')}), lambda x: x <> '') AS lines FROM (FROM documents ORDER BY doc_id LIMIT 50)),
 s AS (SELECT id, text, score, CASE WHEN whole THEN 2 ELSE coalesce(list_filter(list_transform(lines, lambda x: CASE WHEN x = '{_FAQ_Q}' THEN 2 WHEN len(list_intersect(list_distinct(string_split('{_FAQ_Q}', ' ')), string_split(x, ' '))) / len(list_distinct(string_split('{_FAQ_Q}', ' '))) >= 0.8 THEN 1.5 ELSE 0 END), lambda v: v > 0)[1], 0) END AS lexical FROM l),
 b AS (SELECT * FROM s WHERE lexical > 0 ORDER BY score + lexical DESC, id LIMIT 1)
SELECT b.id IS NOT NULL AS matched, '  3) The and  ATTION to thanedble the, anea. Eriner thanea.?! ' AS question, text AS answer, 'doc' || b.id AS document_name, CASE WHEN b.id % 2 = 1 THEN b.id + 100000 END AS document_db_id, CASE WHEN b.id IS NOT NULL THEN 1 END AS page_number,
 CASE WHEN b.id IS NOT NULL THEN 0 END AS chunk_index, CAST(score + lexical AS DOUBLE) AS combined_score FROM (SELECT 1) o LEFT JOIN b ON true UNION ALL SELECT false, 'zzqx zzqy zzqz?', NULL, NULL, NULL, NULL, NULL, NULL""",
    "citations_best_per_doc": f"""WITH {_HITS.format(k=40)}, b AS (SELECT tenant_id, document_name, min(rank) AS first, arg_max(rank, (score, -rank)) AS best FROM hit GROUP BY 1, 2)
SELECT b.tenant_id, b.document_name AS document_title, '/documents/' || document_id AS document_url, CASE WHEN length(text) > 500 THEN left(text, 500) || '…' ELSE text END AS snippet, CAST(1 AS INT) AS page_number,
 CAST(row_number() OVER (PARTITION BY b.tenant_id ORDER BY first) AS INT) AS position FROM b JOIN hit ON best = rank""",
    "citations": f"WITH {_HITS.format(k=12)} SELECT rank, document_id, CASE WHEN d.doc_id IS NULL THEN '#' ELSE '/documents/' || d.doc_id END AS document_url, CASE WHEN length(hit.text) > 500 THEN left(hit.text, 500) || '...' ELSE hit.text END AS snippet, rank AS position FROM hit LEFT JOIN (FROM documents WHERE doc_id % 3 > 0) d ON d.doc_id = document_id",
    "context_pack": f"""WITH {_HITS.format(k=40)}, p AS (SELECT * REPLACE (coalesce(text, '') AS text), '[Source ' || rank || '] ' || document_name || ': ' AS prefix FROM hit),
 s AS (SELECT *, length(prefix) + length(text) AS n, sum(length(prefix) + length(text)) OVER (PARTITION BY tenant_id ORDER BY rank) AS total FROM p),
 o AS (SELECT *, sum(CAST(total > 8000 AS INT)) OVER (PARTITION BY tenant_id ORDER BY rank) AS over_, CAST(least(2000, 8000 - (total - n) - length(prefix) - 5) AS BIGINT) AS lim, 8000 - (total - n) - length(prefix) - 5 AS room FROM s),
 c AS (SELECT tenant_id, rank, CASE WHEN over_ = 0 THEN prefix || text WHEN room > 200 THEN prefix || CASE WHEN length(text) <= lim THEN text ELSE left(text, CAST(floor((lim - 19) * 0.8) AS BIGINT)) || '... [truncated] ...' || right(text, lim - 19 - CAST(floor((lim - 19) * 0.8) AS BIGINT)) END END AS part FROM o WHERE over_ <= 1)
SELECT CAST(tenant_id AS BIGINT) AS tenant_id, CAST(count(part) AS INT) AS n_sources, string_agg(part, chr(10) || chr(10) ORDER BY rank) AS context FROM c GROUP BY 1""",
    "casual_query": r"""WITH c AS (SELECT conv_id, turn, regexp_replace(trim(lower(CASE turn % 3 WHEN 0 THEN 'Thanks ' || role || '!' WHEN 1 THEN 'good MORNING to ' || role || ' and all the others here?' ELSE text END), ' ' || chr(10)), '[!?.,:;]+$', '') AS q FROM conversations)
SELECT conv_id, turn, len(list_filter(['hi', 'hello', 'hey', 'howdy', 'greetings', 'good morning', 'good afternoon', 'good evening', 'sup', 'what' || chr(39) || 's up', 'whats up', 'yo', 'how are you', 'how are you doing',
 'how' || chr(39) || 's it going', 'hows it going', 'what' || chr(39) || 's new', 'whats new', 'how do you do', 'thanks', 'thank you', 'ok', 'okay', 'cool', 'nice', 'bye', 'goodbye', 'see you', 'later', 'good night', 'goodnight'],
 lambda p: starts_with(q, p) AND length(q) <= length(p) + 20)) > 0 AS casual FROM c""",
    "image_rank": f"""WITH {_HITS.format(k=30)}, w AS (SELECT id, score, 0.5 * {_keyword_sql(['the', 'of', 'erst'], "'the picture of ' || d.source")} + 0.3 * {_keyword_sql(['the', 'of', 'erst'], 'd.text')} + 0.2 * {_keyword_sql(['the', 'of', 'erst'], 'd.lang')} AS k
 FROM hit JOIN documents d ON doc_id = id WHERE doc_id % 4 <> 1) SELECT id, round(k, 6) AS keyword_score, round(0.7 * score + 0.3 * k, 6) AS final_score FROM w ORDER BY 3 DESC, id LIMIT 10""",
}

ORACLE_SQL["vector_index_per_tenant"] = ORACLE_SQL["vector_topk_per_tenant"]
ORACLE_SQL["citations_as_written"] = f"""WITH {_HITS.format(k=200)}, h AS (SELECT id % 3 AS t, id AS seq, document_name AS name, document_id AS db, score FROM hit), f AS (SELECT *, min(seq) OVER (PARTITION BY t, name) AS first FROM h),
 n AS (SELECT *, sum(CAST(seq = first AS INT)) OVER (PARTITION BY t ORDER BY seq) AS seen FROM f), b AS (SELECT t, name, arg_max(seq, (score, -seq)) AS best FROM n GROUP BY 1, 2)
SELECT b.t AS tenant_id, b.name AS document_title, '/documents/' || db AS document_url, CAST(CASE WHEN seq = first THEN seen ELSE seen + 1 END AS INT) AS position FROM b JOIN n ON n.t = b.t AND n.seq = b.best"""
_METRIC = {"dot": f"list_inner_product(embedding, {_Q})", "l2": f"1 - list_sum(list_transform(list_zip(embedding, {_Q}), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"}
for _name, _sql in _METRIC.items():
    ORACLE_SQL[f"vector_topk_{_name}"] = f"WITH {_POINTS} SELECT id, s AS score, CASE WHEN s <= 1 THEN round(1 - s, 6) ELSE 0 END AS distance FROM (SELECT id, round({_sql}, 6) AS s FROM point WHERE tenant_id = 1 AND id % 3 = 0) ORDER BY s DESC, id LIMIT 10"
