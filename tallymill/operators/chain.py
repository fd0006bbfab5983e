"""The whole retrieval chain: from a question to the request that a language model gets."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymill.functions import text as t
from tallymill.functions import vectors as v
from tallymill.operators import ranking, vectors
from tallymill.operators.listing import recent

# What goes before and after the retrieved text in the user's turn.
WITH_CONTEXT = (
    "Retrieved Documents:\n{context}\n\nCurrent Question: {query}\n\n"
    "IMPORTANT: Please answer the question using the information provided "
    'in the "Retrieved Documents" section above. If the answer is in the '
    "retrieved documents, provide it directly. Only say you don't have "
    "information if the retrieved documents truly don't contain relevant "
    "information about the question."
)
# Answers without a model.
NO_DOCUMENTS = "I don't have any documents to search. Please upload and process documents first."
NO_RESULTS = (
    "I couldn't find any relevant information in the documents to answer your question. "
    "Please try rephrasing your query or ensure documents have been processed."
)


def user_turn(context: Column, query: Column) -> Column:
    """The user's turn; braces in the texts stay as they are."""
    before, between, after = re.split(r"\{context\}|\{query\}", WITH_CONTEXT)
    return F.concat(F.lit(before), context, F.lit(between), query, F.lit(after))


def request(points: DataFrame, texts: DataFrame, documents: DataFrame, history: DataFrame, query: str, vector: Sequence[float], tenant_id: int, k: int = 5, most_history: int = 6, budget: int = 8000) -> DataFrame:
    """One row: query_type, the number of chunks, the user's turn, the history's turns and the citations.

    points: id, tenant_id, document_id, document_name, embedding; texts: id, text; documents: id, doc_id, tenant_id,
    processing_status; history: conversation_id, id, role, content, created_at of one conversation. A casual question
    takes no documents; otherwise the tenant's completed documents are searched, and texts are read for the k hits only.
    """
    spark = points.sparkSession
    casual = t.is_casual(F.lit(query))
    done = documents.where((F.col("tenant_id") == tenant_id) & (F.col("processing_status") == "completed"))
    pool = vectors.payload_filter(points, tenant_id).where(~casual).join(done.select(F.col("doc_id").alias("document_id")), "document_id", "left_semi")
    hits = vectors.ranked(vectors.top_k(pool, vector, k)).join(texts, "id", "left").withColumn("_all", F.lit(1))
    packed = ranking.pack_context(hits, ["_all"], budget).select("context")
    cited = ranking.citations(hits, documents).agg(F.array_sort(F.collect_list(F.struct("position", "document_url", "snippet"))).alias("citations"), F.count(F.lit(1)).alias("chunks_retrieved"))
    turns = F.transform(F.array_sort(F.collect_list(F.struct("created_at", "id", "role", "content"))), lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    before = recent(history, most_history).agg(turns.alias("history"))
    any_document = done.agg((F.count(F.lit(1)) > 0).alias("any_document"))
    row = spark.range(1).select(F.lit(query).alias("query")).join(packed, F.lit(True), "left").join(cited, F.lit(True)).join(before, F.lit(True)).join(any_document, F.lit(True))  # one row each
    kind = F.when(casual, "casual").when(~F.col("any_document"), "no_documents").when(F.col("chunks_retrieved") == 0, "no_results").otherwise("retrieval")
    own = F.when(kind == "casual", F.lit(query)).when(kind == "retrieval", user_turn(F.coalesce("context", F.lit("")), F.lit(query)))
    answer = F.when(kind == "no_documents", NO_DOCUMENTS).when(kind == "no_results", NO_RESULTS)
    last = F.try_element_at("history", F.lit(-1))
    repeated = F.coalesce((last["role"] == "user") & (last["content"] == query), F.lit(False))  # the caller has stored the question already
    return row.select("query", kind.alias("query_type"), "chunks_retrieved", F.when(~repeated, own).alias("user_content"), answer.alias("answer"), "history", "citations")


def requests(
    points: DataFrame, texts: DataFrame, documents: DataFrame, history: DataFrame, questions: DataFrame, images: DataFrame | None = None, k: int = 5, most_history: int = 6, budget: int = 8000, most_images: int = 1
) -> DataFrame:
    """The requests for a table of questions in one job: request_id, query_type, chunks_retrieved, user_content, answer, history, citations and images.

    questions: request_id (a number, unique), tenant_id, conversation_id, query, embedding, document_ids (null or empty: all).
    Tables are as for ``request``; images: id, tenant_id, document_id, embedding, image_url, caption, text, text_before,
    text_after. Each question that is not casual is searched among its own tenant's completed documents: questions and
    points of a tenant meet in blocks, a question with its own documents meets their points alone. Texts are read for
    hits only. A question without a vector finds nothing. Conversations without turns have an empty history.
    """
    keys = ["request_id"]
    asked = questions.withColumn("casual", F.coalesce(t.is_casual(F.col("query")), F.lit(False)))
    searching = asked.where("NOT casual AND embedding IS NOT NULL")
    done = documents.where("processing_status = 'completed'").select("tenant_id", F.col("doc_id").alias("document_id")).distinct()
    of_tenant = lambda rows: rows.join(done, ["tenant_id", "document_id"], "left_semi")
    pool = of_tenant(points)
    all_documents = F.coalesce(F.size("document_ids"), F.lit(0)) <= 0
    as_query = lambda rows: rows.select(F.col("request_id").alias("id"), "tenant_id", "embedding")
    free = vectors.top_k_own(pool, as_query(searching.where(all_documents)), k).select(F.col("query_id").alias("request_id"), "id", "score")
    wanted = searching.where(~all_documents).select("request_id", "tenant_id", F.explode(F.array_distinct("document_ids")).alias("document_id"), F.col("embedding").alias("asked"))
    near = pool.join(wanted, ["tenant_id", "document_id"]).where(F.size("embedding") == F.size("asked"))
    bound = near.select("request_id", "id", F.round(v.score(F.col("embedding"), F.col("asked")), 6).alias("score"))
    best = Window.partitionBy("request_id").orderBy(F.desc("score"), "id")
    hits = free.unionByName(bound).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    hits = hits.join(points.select("id", "tenant_id", "document_id", "document_name"), "id").join(texts.select("id", "text"), "id", "left")

    packed = ranking.pack_context(hits, keys, budget).select(*keys, "context")
    cited = ranking.citations(hits, documents, tuple(keys), ("tenant_id",)).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("position", "document_url", "snippet"))).alias("citations"), F.count(F.lit(1)).alias("chunks"))
    turns = F.transform(F.array_sort(F.collect_list(F.struct("created_at", "id", "role", "content"))), lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    before = recent(history, most_history).groupBy("conversation_id").agg(turns.alias("history"))
    tenants = done.select("tenant_id").distinct().withColumn("any_document", F.lit(True))
    rows = asked.join(packed, keys, "left").join(cited, keys, "left").join(before, "conversation_id", "left").join(tenants, "tenant_id", "left")

    if images is not None:
        seen = of_tenant(images)
        near = vectors.top_k_own(seen, as_query(searching), vectors.over_fetch(most_images)).select(F.col("query_id").alias("request_id"), "id", "score")
        shown = near.join(seen.select("id", "image_url", "caption", "text", "text_before", "text_after"), "id").join(searching.select("request_id", "query"), "request_id")
        shown = ranking.scored_images(shown, F.col("query"))
        first = Window.partitionBy("request_id").orderBy(F.desc("final_score"), "id")
        shown = shown.withColumn("place", F.row_number().over(first)).where(F.col("place") <= most_images)
        shown = shown.groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct("place", "id", "image_url", "caption", "final_score"))).alias("images"))
        rows = rows.join(shown, keys, "left")
    else:
        rows = rows.withColumn("images", F.lit(None).cast("array<struct<place:int,id:bigint,image_url:string,caption:string,final_score:double>>"))

    chunks = F.coalesce("chunks", F.lit(0))
    kind = F.when(F.col("casual"), "casual").when(F.col("any_document").isNull(), "no_documents").when(chunks == 0, "no_results").otherwise("retrieval")
    own = F.when(kind == "casual", F.col("query")).when(kind == "retrieval", user_turn(F.coalesce("context", F.lit("")), F.col("query")))
    answer = F.when(kind == "no_documents", NO_DOCUMENTS).when(kind == "no_results", NO_RESULTS)
    last = F.try_element_at("history", F.lit(-1))
    repeated = F.coalesce((last["role"] == "user") & (last["content"] == F.col("query")), F.lit(False))
    empty = lambda c: F.coalesce(c, F.array())
    pictures = F.when(kind == "retrieval", F.col("images"))
    return rows.select("request_id", "query", kind.alias("query_type"), chunks.alias("chunks_retrieved"), F.when(~repeated, own).alias("user_content"), answer.alias("answer"), empty("history").alias("history"), empty("citations").alias("citations"), empty(pictures).alias("images"))
