"""What five filters remove alone, together and in every order, by a relational word pipeline.

1. Texts are dealt out by document, words are exploded and counted by (document, word), and
   those counts by document to totals and distinct words. Texts are all that is shuffled:
   both aggregates keep the partitioning, so no row for each word travels.
2. The other conditions are outer-joined: capitals and symbols by row, copies by a group of
   equal digests with its smallest doc_id, labels by doc_id.
3. A document's failing filters are a number below 32. Each part takes 32 conditional counts,
   and as many of good and of toxic documents; any order of the filters is sums of them.

Filters, with the conditions under which a document fails: A: fewer than ``MIN_WORDS`` words;
B: 100 * distinct words < 65 * words; C: 100 * capitals A-Z > 5 * code points; D: holds any of
``#$%&*|``; E: identical to the text of any smaller doc_id in the table, removed or not. Words
are runs outside white space, case-sensitive.

Null text is an empty one: no words (fails A; and E after a smaller doc_id with an empty or
null text). Null source and the empty source are one part, the empty string. A null doc_id is
neither smaller nor larger than any, and has no labels. Repeated rows each count. A document
with several labels is good, or toxic, if any says so; a label of no document does nothing. An
empty table gives no rows. A very long text is one task's while it is exploded, its words
travel through spillable aggregates. A row that is repeated very often is dealt out by the task
that read it. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import written

FILTERS = "ABCDE"
MIN_WORDS = 50
SPACE = r"[\x20\x09-\x0D]+"
#: A document: its id (0 where ``no_id``) and its text's hash. Rows alike in both are alike in all that is counted.
KEY = ["id", "no_id", "row_key"]


def keyed(docs: DataFrame) -> DataFrame:
    """The key, source and text (never null) of each row."""
    return docs.select("doc_id", "source", F.coalesce("text", F.lit("")).alias("text")).select(
        F.coalesce("doc_id", F.lit(0)).cast("long").alias("id"), F.col("doc_id").isNull().alias("no_id"), F.xxhash64("text").alias("row_key"), F.coalesce("source", F.lit("")).alias("part"), "text"
    )


def word_totals(docs: DataFrame) -> DataFrame:
    """words and distinct_words of each document (``KEY``).

    A null word stands for each row of a document, so that repeated rows can be told from repeated words.
    """
    key = [*KEY, "read_by"]
    dealt = docs.select(*KEY, F.spark_partition_id().alias("read_by"), "text").repartition(*key)
    words = dealt.select(*key, F.explode(F.concat(F.split("text", SPACE), F.array(F.lit(None).cast("string")))).alias("word")).where("word IS NULL OR word <> ''")
    counts = words.groupBy(*key, "word").agg(F.count(F.lit(1)).alias("n"))
    rows = F.max(F.when(F.col("word").isNull(), F.col("n")))
    total = F.coalesce(F.sum(F.when(F.col("word").isNotNull(), F.col("n"))), F.lit(0))
    each = counts.groupBy(*key).agg(total.alias("total"), rows.alias("rows"), F.count("word").alias("distinct_words"))
    return each.groupBy(*KEY).agg(F.max(F.expr("total div rows")).alias("words"), F.max("distinct_words").alias("distinct_words"))


def failing(docs: DataFrame) -> DataFrame:
    """part, id, no_id and the failing filters of each row, as a number with a bit for each letter."""
    docs = keyed(docs)
    capitals = F.length("text") - F.length(F.regexp_replace("text", "[A-Z]", ""))
    rows = docs.select(*KEY, "part", (100 * capitals > 5 * F.length("text")).alias("C"), F.col("text").rlike(r"[#$%&*|]").alias("D"), F.unhex(F.sha2("text", 256)).alias("digest"))
    rows = written(rows, "filter-rows")
    copies = written(rows.groupBy("digest").agg(F.min(F.when(~F.col("no_id"), F.col("id"))).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "first"), "copied-texts")
    out = rows.join(copies, "digest", "left").join(word_totals(docs), KEY, "left")
    words = F.coalesce("words", F.lit(0))
    conditions = [words < MIN_WORDS, 100 * F.coalesce("distinct_words", F.lit(0)) < 65 * words, F.col("C"), F.col("D"), F.coalesce(~F.col("no_id") & (F.col("first") < F.col("id")), F.lit(False))]
    return out.select("part", "id", "no_id", sum((c.cast("int") * (1 << k) for k, c in enumerate(conditions)), F.lit(0)).alias("failing"))


def pattern_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """For each part: how many documents fail exactly each set of filters (``n``), of them good and toxic ones; arrays of 32."""
    marks = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    marks = marks.withColumn("no_id", F.lit(False))
    rows = failing(docs).join(marks, ["id", "no_id"], "left")
    mark = {"n": F.lit(True), "good": F.col("good"), "toxic": F.col("toxic")}
    counts = [F.count_if((F.col("failing") == k) & mark[name]).alias(f"{name}{k}") for name in mark for k in range(32)]
    return rows.groupBy("part").agg(*counts).select("part", *(F.array(*(f"{name}{k}" for k in range(32))).alias(name) for name in ("n", "good", "toxic")))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per part, order of the filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley."""
    steps = []
    for order in permutations(range(5)):
        for k, own in enumerate(order):
            steps.append(F.struct(F.lit("".join(FILTERS[i] for i in order)).alias("filter_order"), F.lit(k + 1).alias("step"), F.lit(1 << own).alias("own"), F.lit(sum(1 << i for i in order[:k])).alias("before")))
    rows = pattern_counts(docs, labels).select("*", F.explode(F.array(*steps)).alias("s")).select("part", "n", "good", "toxic", "s.*")

    def total(counts: str, which) -> Column:
        add = lambda so_far, s: so_far + F.when(which(s), F.get(F.col(counts), s)).otherwise(F.lit(0))
        return F.aggregate(F.sequence(F.lit(0), F.lit(31)), F.lit(0).cast("long"), add)

    fails = lambda s: s.bitwiseAND(F.col("own")) != 0
    gone = lambda s: s.bitwiseAND(F.col("before")) != 0
    removed = lambda s: fails(s) & ~gone(s)
    share = sum((F.when(F.lit(k).bitwiseAND(F.col("own")) != 0, F.get(F.col("n"), F.lit(k)) * (120 // k.bit_count())).otherwise(0) for k in range(1, 32)), F.lit(0).cast("long"))
    return rows.select(
        "part", "filter_order", "step", total("n", lambda s: ~fails(s) & ~gone(s)).alias("kept"), total("n", removed).alias("removed"), total("n", lambda s: fails(s) & gone(s)).alias("redundant"),
        F.get(F.col("n"), F.col("own")).alias("unique_fails"), total("good", removed).alias("good_lost"), total("toxic", removed).alias("toxic_lost"), share.alias("shapley"),
    )
