"""Line deduplication by a deletion-neighbourhood join, in DataFrame functions only.

Lines are compared as sequences of words (runs outside white space); blank lines
always stay. Of lines with equal words, the earliest occurrence stays; order is by
doc_id, then line number. Two lines of at least ``MIN_WORDS`` words are near
duplicates when at most one word is replaced, inserted or deleted between them,
and a line goes if any near duplicate of it occurs earlier.

Near duplicates are found without forming pairs of a group: each line's hashed
variants, the line less one word, are joined on equal hash. Lines with the same
variant at the same place all differ by one word at that place, so each is held
against the earliest of them; a line equal to another's variant is held against it
likewise. Each match is then verified by edit distance on the words. Before that, a
lossless sieve: with one edit, the first or the last half of the words is the same,
so only lines that share such a half with another line get variants, and only at
places outside that half. Lines of over ``LONG`` words get theirs from running sums
over their words, so a very long line costs in proportion to its length.

Null text or null doc_id: the row stays as it is. Rows of one doc_id and equal text
are one document. Documents all of whose lines go are left out; empty ones that
come in stay. An empty table gives no rows. Other columns stay, whatever their names,
with ``n_chars`` set to the new length if it is there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import written

#: Lines of fewer words go only when equal.
MIN_WORDS = 5
#: Lines of more words have their variants hashed from running sums.
LONG = 1024
#: Candidate lines up to this number are broadcast to the second pass over the texts; more are joined by shuffle.
BROADCAST_LINES = 200_000
_SPACE = r"[\x20\x09-\x0D]+"
POS = ["doc_id", "row_key", "line_no"]


def folded(line: Column) -> Column:
    """The line's words with one space between; lines that are so already are not taken apart."""
    odd = F.startswith(line, F.lit(" ")) | F.endswith(line, F.lit(" "))
    for c in ("  ", "\t", "\r", "\x0b", "\x0c"):
        odd = odd | F.contains(line, F.lit(c))
    return F.when(odd, F.array_join(F.filter(F.split(line, _SPACE), lambda w: w != ""), " ")).otherwise(line)


def raw_lines(docs: DataFrame) -> DataFrame:
    """doc_id, row_key, line_no and line of every line."""
    rows = docs.where("doc_id is not null and text is not null")
    return rows.select("doc_id", F.xxhash64("text").alias("row_key"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def word_count(norm: str) -> Column:
    """Number of words of a folded line; 0 if it is empty."""
    spaces = F.octet_length(norm) - F.octet_length(F.replace(norm, F.lit(" "), F.lit("")))
    return F.when(F.col(norm) != "", spaces + 1).otherwise(0)


def hashed_lines(docs: DataFrame, min_words: int) -> DataFrame:
    """The place of every line, two hashes of its folded words, their number, and the hashes of its halves.

    The halves are those that a line shares with any line one word away: the first
    and the last half of the words, for even numbers also each less one word.
    """
    lines = raw_lines(docs).select(*POS, folded(F.col("line")).alias("norm"))
    lines = lines.select(*POS, "norm", F.xxhash64("norm").alias("h1"), F.hash("norm").alias("h2"), word_count("norm").alias("n"))
    first = lambda m: f"xxhash64('first', {m}, substring_index(norm, ' ', {m}))"
    last = lambda m: f"xxhash64('last', {m}, substring_index(norm, ' ', -({m})))"
    even = f"n >= {min_words} AND n % 2 = 0"
    halves = [F.expr(f"CASE WHEN {when} THEN {half} END").alias(f"half{k}") for k, (when, half) in enumerate([(f"n >= {min_words}", f("n div 2")) for f in (first, last)] + [(even, f("n div 2 - 1")) for f in (first, last)])]
    return lines.select(*POS, "h1", "h2", "n", *halves)


def distinct_lines(lines: DataFrame) -> DataFrame:
    """Each distinct line's first place and number of occurrences; blank lines have no part in anything."""
    halves = [F.first(f"half{k}").alias(f"half{k}") for k in range(4)]
    return lines.where("n > 0").groupBy("h1", "h2", "n").agg(F.min(F.struct(*POS)).alias("first"), F.count(F.lit(1)).alias("times"), *halves)


def sieve(lines: DataFrame) -> DataFrame:
    """First places of lines that share a half with another distinct line: edits are from ``from_place`` on, or up to ``to_place``."""
    halves = F.array(*(f"half{k}" for k in range(4)))
    keys = lines.where("half0 is not null").select("first.*", "n", F.posexplode(halves).alias("k", "half")).where("half is not null")
    shared = keys.groupBy("half").agg(F.count(F.lit(1)).alias("held")).where("held > 1").select("half")
    kept = keys.join(shared, "half", "left_semi").withColumn("m", F.expr("n div 2 - k div 2"))  # words of the half; first and last ones take turns
    return kept.groupBy(*POS).agg(F.min(F.expr("CASE WHEN k % 2 = 0 THEN m + 1 END")).alias("from_place"), F.max(F.expr("CASE WHEN k % 2 = 1 THEN n - m END")).alias("to_place"))


def _short_variants(lines: DataFrame) -> DataFrame:
    less = F.expr(
        "transform(filter(sequence(1, n), i -> coalesce(i >= from_place, false) OR coalesce(i <= to_place, false)),"
        " i -> struct(xxhash64(concat_ws(' ', nullif(substring_index(norm, ' ', i - 1), ''), nullif(substring_index(norm, ' ', i - n), ''))) AS key, i AS place))"
    )
    whole = F.array(F.struct(F.xxhash64("norm").alias("key"), F.lit(0).alias("place")))
    return lines.select("id", F.explode(F.concat(whole, less)).alias("v")).select("v.key", "v.place", "id")


def _long_variants(lines: DataFrame) -> DataFrame:
    """The same by sums (exclusive or) of hashes of words with their places: those before the gap, and those after it one place lower."""
    words = lines.select("id", "from_place", "to_place", F.posexplode(F.split("norm", " ")).alias("at", "word"))
    words = words.select("id", "from_place", "to_place", (F.col("at") + 1).alias("place"), F.xxhash64("word", F.col("at") + 1).alias("here"), F.xxhash64("word", "at").alias("moved"))
    line = Window.partitionBy("id")
    so_far = line.orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    before = F.bit_xor("here").over(so_far).bitwiseXOR(F.col("here"))
    after = F.bit_xor("moved").over(line).bitwiseXOR(F.bit_xor("moved").over(so_far))
    less = words.withColumn("key", F.xxhash64(F.lit("long"), before.bitwiseXOR(after)))
    less = less.where("coalesce(place >= from_place, false) OR coalesce(place <= to_place, false)").select("key", "place", "id")
    return less.union(words.groupBy("id").agg(F.bit_xor("here").alias("whole")).select(F.xxhash64(F.lit("long"), "whole"), F.lit(0), "id"))


def variants(lines: DataFrame) -> DataFrame:
    """(key, place, id): the hash of the line less the word at each place where an edit may be; place 0 is the line itself.

    Lines that may be one word apart are hashed alike: those about as long as ``LONG`` in both ways.
    """
    return _short_variants(lines.where(F.col("n") <= LONG + 1)).union(_long_variants(lines.where(F.col("n") >= LONG)))


def within_one_word(a: Column, b: Column) -> Column:
    """Whether the word sequences differ by at most one replaced, inserted or deleted word."""
    short = F.when(F.size(a) <= F.size(b), a).otherwise(b)
    long = F.when(F.size(a) <= F.size(b), b).otherwise(a)
    head = F.zip_with(short, F.slice(long, F.lit(1), F.size(short)), lambda x, y: x == y)
    at = F.array_position(head, False).cast("int")  # the first difference, 0 if there is none
    replaced = F.slice(short, at + 1, F.size(short)) == F.slice(long, at + 1, F.size(long))
    inserted = F.slice(short, at, F.size(short)) == F.slice(long, at + 1, F.size(long))
    gap = F.size(long) - F.size(short)
    return (gap == 0) & ((at == 0) | replaced) | (gap == 1) & ((at == 0) | inserted)


def near_duplicates(docs: DataFrame, lines: DataFrame, min_words: int) -> DataFrame:
    """First places of lines that have an earlier near duplicate."""
    wanted = written(sieve(lines), "sieve")
    few = wanted.count() <= BROADCAST_LINES
    texts = raw_lines(docs).join(F.broadcast(wanted) if few else wanted, POS).dropDuplicates(POS)
    ordered = texts.repartitionByRange(*POS).sortWithinPartitions(*POS)
    cands = ordered.select(F.monotonically_increasing_id().alias("id"), *POS, "from_place", "to_place", folded(F.col("line")).alias("norm"))
    cands = written(cands.withColumn("n", word_count("norm")), "lines")

    every = written(variants(cands), "variants", "none")
    shared = every.groupBy("key").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a < b").select("key")
    v = written(every.join(shared, "key", "left_semi"), "shared-variants")
    same = v.where("place > 0").groupBy("key", "place").agg(F.min("id").alias("other"), F.max("id").alias("last")).where("other < last")
    replaced = v.join(same.drop("last"), ["key", "place"]).where("id > other").select("id", "other")
    cross = v.groupBy("key").agg(F.min(F.when(F.col("place") == 0, F.col("id"))).alias("whole"), F.min(F.when(F.col("place") > 0, F.col("id"))).alias("less"))
    cross = cross.where("whole is not null and less is not null and whole <> less")
    changed = v.join(cross, "key").select("id", F.when(F.col("place") == 0, F.col("less")).otherwise(F.col("whole")).alias("other")).where("id > other")
    pairs = replaced.union(changed).distinct()

    a = cands.select("id", *POS, F.split("norm", " ").alias("a"))
    b = cands.select(F.col("id").alias("other"), F.split("norm", " ").alias("b"))
    shorter = F.least(F.size("a"), F.size("b")) >= min_words
    return pairs.join(a, "id").join(b, "other").where(shorter & within_one_word(F.col("a"), F.col("b"))).select(*POS).distinct()


def dropped_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, row_key and the numbers of the lines that go."""
    docs = docs.select("doc_id", "text")
    each = written(hashed_lines(docs, min_words), "line-hashes", "snappy")
    lines = written(distinct_lines(each), "distinct-lines", "snappy")
    near = written(near_duplicates(docs, lines, min_words), "near-lines").withColumn("near", F.lit(True))
    flat = lines.select("h1", "h2", "first.*", "times")
    repeated = flat.join(near, POS, "left").where("times > 1 or near")
    repeated = repeated.select("h1", "h2", F.struct(*POS).alias("first"), F.coalesce("near", F.lit(False)).alias("near"))
    gone = each.where("n > 0").select(*POS, "h1", "h2").join(repeated, ["h1", "h2"]).where(F.col("near") | (F.struct(*POS) != F.col("first")))
    return gone.groupBy("doc_id", "row_key").agg(F.collect_set("line_no").alias("gone"))


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """row (of docs, as a struct), doc_id, lines, gone and the text that is left of each row; null if nothing is."""
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("doc_id"), F.col("text").alias("text"), F.xxhash64("text").alias("row_key"))
    rows = rows.join(gone, ["doc_id", "row_key"], "left").withColumn("lines", F.split("text", "\n"))
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    left = F.array_join(F.transform(kept, lambda i: F.get("lines", i)), "\n")
    return rows.withColumn("left", F.when(F.col("gone").isNull(), F.col("text")).when(left.rlike(r"[^\x20\x09-\x0D]"), left))


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with its repeated lines gone."""
    out = without(docs, dropped_lines(docs, min_words)).where("gone is null or left is not null")
    field = lambda c: F.col("row").getField(c)
    made = {"text": F.col("left"), "n_chars": F.length("left")}
    return out.select(*(made[f.name].cast(f.dataType).alias(f.name) if f.name in made else field(f.name).alias(f.name) for f in docs.schema.fields))


def report(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, n_lines, n_dropped and the text that is left (null if nothing is) of each row."""
    out = without(docs.select("doc_id", "text"), dropped_lines(docs, min_words))
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size("lines")).cast("long")
    return out.select("doc_id", n_lines.alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"), F.col("left").alias("text"))
