"""Document fingerprints by I-Match over several lexicon subsets, in DataFrame functions only.

1. A term is a word (run outside white space) in lower case. The lexicon holds the terms
   whose inverse document frequency ln(N / df) is within ``BAND``: neither what everybody
   writes nor what nobody else does. A term whose idf is below 7 is in more than N / e^7 of
   the N documents, so the lexicon has at most (mean distinct terms of a document) * e^7
   terms, however many documents there are.
2. The lexicon has ``SUBSETS`` random subsets: four of each density 2^-9 to 2^-2, sparse ones
   first, and at last the whole of it. Which subsets a term is in follows from its hash.
3. A document's distinct lexicon terms are sorted; each subset's share of them is hashed.
   The fingerprint is these 32-bit hashes in hexadecimal, dots for a subset without terms. A
   text without any lexicon term has ``=`` and its own hash.
4. Likeness of two fingerprints: of the ``SEEN`` sparsest subsets that have terms in either, the
   share with equal hashes. Sparse subsets bear small edits, so long texts compare by them,
   and short ones by what they have. Without such subsets, 1 if equal and 0 if not.

``edited`` replaces the end of each text by the beginning of the next document's. The order of
documents comes from ranges: each takes its next within its range, the last one from the
first of the next range. Texts are shuffled once, cut beginnings of texts once more; terms are
found, grouped and hashed where the texts are.

Null text is an empty one. The order is by doc_id, nulls first, then by the text's hash; after
the last comes the first, so a single document is its own next. Rows of one doc_id and equal
text are one document, and each gets its row. Ties in frequency do not matter. An empty table
gives no rows. A very long text is one row's array of words. Extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import written

#: Inverse document frequencies, ln(N / df), of the lexicon's terms: from the first, below the second.
BAND = (2.0, 7.0)
DENSITIES = range(9, 1, -1)
OF_EACH = 4
SUBSETS = len(DENSITIES) * OF_EACH + 1
SEEN = 12
#: A lexicon up to this number of terms is broadcast; a larger one, of very long documents only, is joined by shuffle.
BROADCAST_TERMS = 1_000_000
KEY = ["id", "no_id", "row_key"]
#: So many subsets are sparse: few terms are in any of them.
_SPARSE = 5 * OF_EACH


def keyed(docs: DataFrame) -> DataFrame:
    """The key of each row, its text (never null), and whether it has a doc_id."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", text.alias("text")).select(F.coalesce("doc_id", F.lit(0)).cast("long").alias("id"), F.col("doc_id").isNull().alias("no_id"), F.xxhash64("text").alias("row_key"), "text")


def terms_of(text: Column) -> Column:
    return F.array_distinct(F.split(F.lower(text), r"[\x20\x09-\x0D]+"))


def lexicon(docs: DataFrame, band: tuple[float, float] = BAND) -> DataFrame:
    """term (hash) and code of the terms within the band, over all rows of ``docs``.

    A code's upper 31 bits are the term's, the others say which subsets it is in.
    """
    n = docs.count()
    most, least = n * math.exp(-band[0]), n * math.exp(-band[1])
    terms = docs.select(F.explode(terms_of(F.col("text"))).alias("word")).where("word <> ''").select(F.xxhash64("word").alias("term"))
    kept = terms.groupBy("term").agg(F.count(F.lit(1)).alias("df")).where((F.col("df") <= most) & (F.col("df") > least)).select("term")
    densities = [d for d in DENSITIES for _ in range(OF_EACH)]
    member = [F.when(F.pmod(F.xxhash64("term", F.lit(k)), F.lit(1 << d)) == 0, F.lit(1 << k)).otherwise(F.lit(0)).cast("long") for k, d in enumerate(densities)]
    mask = sum(member, F.lit(1 << (SUBSETS - 1)).cast("long"))
    return kept.select("term", F.shiftleft("term", SUBSETS).bitwiseOR(mask).alias("code"))


def in_order(docs: DataFrame) -> DataFrame:
    """Each document's key, and those of the documents before and after it (``prev``, ``next``), with their lengths."""
    here = F.struct((~F.col("no_id")).alias("has_id"), "id", "row_key", "n_chars")
    keys = written(docs.groupBy(*KEY).agg(F.max(F.length("text")).alias("n_chars")), "document-keys")
    ranges = keys.select(here.alias("here")).repartitionByRange("here").select("here", F.spark_partition_id().alias("range"))
    ranges = written(ranges, "document-ranges")
    ends = ranges.groupBy("range").agg(F.min("here").alias("first"), F.max("here").alias("last"))
    order = Window.orderBy("range")  # a row for each range
    across = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = ends.select(
        "range", F.coalesce(F.lag("last").over(order), F.last("last").over(across)).alias("before"), F.coalesce(F.lead("first").over(order), F.first("first").over(across)).alias("after")
    )
    within = Window.partitionBy("range").orderBy("here")
    out = ranges.withColumn("prev", F.lag("here").over(within)).withColumn("next", F.lead("here").over(within)).join(ends, "range")
    return out.select(
        "here.id", (~F.col("here.has_id")).alias("no_id"), "here.row_key", "here.n_chars", F.coalesce("prev", "before").alias("prev"), F.coalesce("next", "after").alias("next")
    )


def with_edits(docs: DataFrame) -> DataFrame:
    """Each document once: key, n_chars, text, edited and the next one's key (``next``)."""
    order = written(in_order(docs), "document-order")
    texts = docs.dropDuplicates(KEY).join(order, KEY)
    heads = texts.select("prev.id", (~F.col("prev.has_id")).alias("no_id"), "prev.row_key", F.expr("left(text, int(prev.n_chars div 4))").alias("head"))
    kept = F.expr("left(text, int(n_chars - n_chars div 4))")
    return texts.join(heads, KEY).select(*KEY, "n_chars", "next", "text", F.concat(kept, "head").alias("edited"))


def lexicon_codes(texts: DataFrame, words: DataFrame) -> DataFrame:
    """KEY and the sorted codes of each row's lexicon terms, of ``text`` (codes0) and of ``edited`` (codes1)."""
    if words.count() <= BROADCAST_TERMS:
        words = F.broadcast(words)
    sides = texts.select(*KEY, F.posexplode(F.array(terms_of(F.col("text")), terms_of(F.col("edited")))).alias("side", "words"))
    found = sides.select(*KEY, "side", F.explode("words").alias("word")).where("word <> ''").select(*KEY, "side", F.xxhash64("word").alias("term")).join(words, "term")
    return found.groupBy(*KEY).agg(*(F.sort_array(F.collect_list(F.when(F.col("side") == k, F.col("code")))).alias(f"codes{k}") for k in (0, 1)))


def subset_hashes(codes: str) -> Column:
    """The hash of each subset's codes, null for a subset without any; null if there are no codes at all."""
    of = lambda first, last, held: f"transform(sequence({first}, {last}), k -> filter({held}, c -> getbit(c, k) = 1))"
    # the sparse subsets look through the codes that are in any of them
    sparse = f"flatten(transform(array(filter({codes}, c -> (c & {(1 << _SPARSE) - 1}L) <> 0)), few -> {of(0, _SPARSE - 1, 'few')}))"
    parts = F.expr(f"concat({sparse}, {of(_SPARSE, SUBSETS - 1, codes)})")
    hashes = F.transform(parts, lambda x: F.when(F.size(x) > 0, F.xxhash64(x).bitwiseAND(F.lit(0xFFFFFFFF))))
    return F.when(F.size(codes) > 0, hashes)


def written_out(hashes: str, whole: str) -> Column:
    """The fingerprint as a string."""
    parts = F.transform(F.col(hashes), lambda h: F.coalesce(F.lpad(F.lower(F.hex(h)), 8, "0"), F.lit("." * 8)))
    return F.coalesce(F.array_join(parts, ""), F.concat(F.lit("="), F.lpad(F.lower(F.hex(F.col(whole))), 16, "0")))


def likeness(a: str, whole_a: str, b: str, whole_b: str) -> Column:
    """Of two columns of hashes, with the texts' own hashes for texts without any."""
    seen = f"slice(filter(sequence(0, {SUBSETS - 1}), k -> {a}[k] IS NOT NULL OR {b}[k] IS NOT NULL), 1, {SEEN})"
    share = f"aggregate({seen}, named_struct('same', 0, 'n', 0), (x, k) -> named_struct('same', x.same + int({a}[k] <=> {b}[k]), 'n', x.n + 1), x -> x.same / x.n)"
    return F.expr(f"double(CASE WHEN {a} IS NULL AND {b} IS NULL THEN int({whole_a} = {whole_b}) WHEN {a} IS NULL OR {b} IS NULL THEN 0 ELSE {share} END)")


def fingerprint_edits(docs: DataFrame, band: tuple[float, float] = BAND) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of each row of ``docs``."""
    rows = keyed(docs)
    words = written(lexicon(rows, band), "lexicon")
    texts = with_edits(rows)
    codes = lexicon_codes(texts, words).select(*KEY, *(subset_hashes(f"codes{k}").alias(f"hashes{k}") for k in (0, 1)))
    about = texts.select(*KEY, "n_chars", "next", F.col("row_key").alias("whole0"), F.xxhash64("edited").alias("whole1"), F.sha2("edited", 256).alias("edited_sha256"))
    each = written(about.join(codes, KEY, "left"), "fingerprints")

    next_key = {"next_id": F.col("next.id"), "next_no_id": ~F.col("next.has_id"), "next_row_key": F.col("next.row_key")}
    after = each.select(F.col("id").alias("next_id"), F.col("no_id").alias("next_no_id"), F.col("row_key").alias("next_row_key"), F.col("hashes0").alias("next_hashes"), F.col("whole0").alias("next_whole"))
    near = each.withColumns(next_key).join(after, [*next_key]).select(
        *KEY, F.col("n_chars").cast("long").alias("n_chars"), "edited_sha256", written_out("hashes0", "whole0").alias("fingerprint"), written_out("hashes1", "whole1").alias("edited_fingerprint"),
        likeness("hashes0", "whole0", "hashes1", "whole1").alias("near_edited"), likeness("hashes0", "whole0", "next_hashes", "next_whole").alias("near_next"),
    )
    out = rows.select(*KEY).join(near, KEY)
    return out.select(F.when(~F.col("no_id"), F.col("id")).alias("doc_id"), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
