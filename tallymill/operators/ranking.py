"""Re-ranking of hits, FAQ matching, image ranking, citations and context packing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymill.functions import text as t


def lexical_rerank(hits: DataFrame, query: Column, k: int | None = None) -> DataFrame:
    """Hits (id, text, score, rank) by score plus lexical boost, rounded to 4; ties keep the vector rank."""
    out = hits.withColumn("combined_score", F.bround(F.col("score") + t.lexical_boost(query, F.col("text")), 4))
    out = out.orderBy(F.desc("combined_score"), "rank")
    return out.limit(k) if k else out


def faq_match(hits: DataFrame, documents: DataFrame, query: Column, k: int = 50) -> DataFrame:
    """One row: whether an answer is found among the first ``k`` hits (id, text, score, rank, document_id, document_name,
    page_number, chunk_index), and the best one with its document's database id.

    The question within the chunk counts 2; else the first line that equals it (2) or has four fifths of its tokens (1.5).
    """
    q = t.normalise_question(query)
    tokens = t.words(q)
    lines = F.transform(F.split("text", r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"), t.normalise_question)
    value = lambda x: F.when(x == "", 0.0).when(x == q, 2.0).when((q != "") & (t.overlap_ratio(tokens, t.words(x)) >= 0.8), 1.5).otherwise(0.0)
    first = F.get(F.filter(F.transform(lines, value), lambda s: s > 0), 0)
    lexical = F.when((q != "") & F.contains(t.normalise_question(F.col("text")), q), 2.0).otherwise(F.coalesce(first, F.lit(0.0)))
    near = hits.orderBy("rank").limit(k).where("text <> ''").withColumn("lexical", F.when(q != "", lexical).otherwise(0.0)).where("lexical > 0")
    best = near.withColumn("combined_score", F.col("score") + F.col("lexical")).orderBy(F.desc("combined_score"), "rank").limit(1)
    ids = documents.select(F.col("doc_id").alias("document_id"), F.col("id").alias("document_db_id"))
    fields = ["answer", "document_name", "document_db_id", "page_number", "chunk_index", "combined_score"]
    found = best.join(ids, "document_id", "left").select(F.struct(F.col("text").alias("answer"), *fields[1:]).alias("b"))
    one = hits.sparkSession.range(1).select(query.alias("question"))
    return one.join(found, F.lit(True), "left").select(F.col("b").isNotNull().alias("matched"), "question", *(f"b.{c}" for c in fields))


def scored_images(rows: DataFrame, query: Column) -> DataFrame:
    """Image hits with captions: 0.7 of the vector score and 0.3 of the words' (caption 0.5, all text 0.3, surroundings 0.2)."""
    around = F.concat_ws(" ", "text_before", "text_after")
    words = 0.5 * t.keyword_score(query, F.col("caption")) + 0.3 * t.keyword_score(query, F.col("text")) + 0.2 * t.keyword_score(query, around)
    return rows.withColumn("keyword_score", F.bround(words, 6)).withColumn("final_score", F.bround(0.7 * F.col("score") + 0.3 * words, 6))


def image_rank(hits: DataFrame, captions: DataFrame, query: Column, k: int) -> DataFrame:
    """The k best image hits by vector and words, joined with their captions."""
    return scored_images(hits.join(captions, "id"), query).orderBy(F.desc("final_score"), "id").limit(k)


def image_text(before: Column, caption: Column, after: Column, most: int = 8000) -> Column:
    """Text before, caption and text after, stripped; if that is too long, the beginnings of both surroundings in half of what the caption leaves."""
    held = lambda c: F.when(c != "", t.strip(c))
    caption = F.coalesce(caption, F.lit(""))
    every = F.concat_ws(" ", held(before), t.strip(caption), held(after))
    room = F.lit(most) - F.length(caption) - 2
    half = F.floor(room / 2).cast("int")
    part = lambda c: F.left(F.coalesce(c, F.lit("")), half)
    cut = F.when(room > 0, t.strip(F.concat_ws(" ", part(before), caption, part(after)))).otherwise(F.left(caption, F.lit(most)))
    return F.when(F.length(every) <= most, every).otherwise(cut)


def context_caption(before: Column, after: Column) -> Column:
    """A caption from what surrounds an image: 100 characters of either side, at most 300 in all."""
    parts = F.concat_ws(" ", F.when(before != "", t.strip(F.right(before, F.lit(100)))), F.when(after != "", t.strip(F.left(after, F.lit(100)))))
    cut = F.when(F.length(parts) > 300, F.concat(F.left(parts, F.lit(297)), F.lit("..."))).otherwise(parts)
    return F.when((F.coalesce(before, F.lit("")) == "") & (F.coalesce(after, F.lit("")) == ""), "Image from document").otherwise(cut)


def best_citations(hits: DataFrame, keys: list[str], as_written: bool = False) -> DataFrame:
    """The best-scored chunk of each document (the earliest of equal ones; no score is 0) in the order in which documents were first seen.

    Positions are dense; ``as_written`` they are what a list gives that writes the number of documents seen so far, plus one,
    whenever a better chunk takes a document's place.
    """
    key = F.coalesce(F.nullif("document_name", F.lit("")), F.col("document_db_id").cast("string"), F.nullif("document_id", F.lit("")))
    rows = hits.select(*keys, "seq", key.alias("name"), F.struct("document_name", "document_db_id", "text", "page_number").alias("hit"), F.coalesce("score", F.lit(0.0)).alias("score")).where("name IS NOT NULL")
    mine = Window.partitionBy(*keys, "name")
    seen = Window.partitionBy(*keys).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("first", F.min("seq").over(mine))
    rows = rows.withColumn("n_seen", F.sum((F.col("seq") == F.col("first")).cast("int")).over(seen))
    best = F.max_by(F.struct("hit", "seq", "n_seen"), F.struct("score", (-F.col("seq")).alias("s")))
    kept = rows.groupBy(*keys, "name").agg(F.min("seq").alias("first"), best.alias("b"))
    dense = F.row_number().over(Window.partitionBy(*keys).orderBy("first"))
    position = F.when(F.col("b.seq") == F.col("first"), dense).otherwise(F.col("b.n_seen") + 1).cast("int") if as_written else dense
    url = F.coalesce(F.concat(F.lit("/documents/"), F.col("b.hit.document_db_id").cast("string")), F.lit("#"))
    return kept.select(*keys, F.col("b.hit.document_name").alias("document_title"), url.alias("document_url"), t.snippet(F.col("b.hit.text"), 500, "…").alias("snippet"), F.col("b.hit.page_number").alias("page_number"), position.alias("position"))


def citations(hits: DataFrame, documents: DataFrame, keys: tuple[str, ...] = (), within: tuple[str, ...] = ()) -> DataFrame:
    """A citation for each hit in rank order: link by document id, unique ``within`` some columns (``#`` without one), 500 characters."""
    ids = documents.select(*within, F.col("doc_id").alias("document_id"), F.struct("id").alias("_db"))
    url = F.coalesce(F.concat(F.lit("/documents/"), F.col("_db.id").cast("string")), F.lit("#"))
    return hits.join(ids, [*within, "document_id"], "left").select(*keys, "rank", "document_id", url.alias("document_url"), t.snippet(F.col("text"), 500, "...").alias("snippet"), F.col("rank").alias("position"))


def pack_context(hits: DataFrame, keys: list[str], budget: int = 8000, most_snippet: int = 2000, reserve: int = 5, least: int = 200) -> DataFrame:
    """Sources in rank order as long as they fit; the first that does not is cut in the middle if over ``least`` characters are left, and ends the packing."""
    prefix = F.concat(F.lit("[Source "), F.col("rank").cast("string"), F.lit("] "), F.coalesce("document_name", F.lit("Unknown")), F.lit(": "))
    w = Window.partitionBy(*keys).orderBy("rank")
    rows = hits.withColumn("_prefix", prefix).withColumn("_n", F.length("_prefix") + F.length(F.coalesce("text", F.lit(""))))
    rows = rows.withColumn("_sum", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("_over", F.sum((F.col("_sum") > budget).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    room = (F.lit(budget) - (F.col("_sum") - F.col("_n")) - F.length("_prefix") - reserve).cast("int")
    cut = F.concat("_prefix", t.truncate_middle(F.col("text"), F.least(room, F.lit(most_snippet))))
    part = F.when(F.col("_over") == 0, F.concat("_prefix", F.coalesce("text", F.lit("")))).when((F.col("_over") == 1) & (room > least), cut)
    parts = F.array_sort(F.collect_list(F.struct("rank", part.alias("part"))))
    kept = F.filter(parts, lambda p: p["part"].isNotNull())
    return rows.where("_over <= 1").groupBy(*keys).agg(F.size(kept).alias("n_sources"), F.array_join(F.transform(kept, lambda p: p["part"]), "\n\n").alias("context"))
