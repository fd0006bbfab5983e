"""Column expressions over text: normalisation, matching, titles, snippets, links."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallymill.functions.arrow import parts

#: Unicode white space, as Python's strip() and split() take it. Visible ASCII is ruled out first, which halves the time of a match.
SPACE = r"[[^!-~]&&[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]]"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def fold_space(c: Column) -> Column:
    return F.btrim(F.regexp_replace(c, f"{SPACE}+", " "))


def words(c: Column) -> Column:
    """Words between white space; an empty array for blank or null text."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), f"{SPACE}+"), lambda w: w != "")


def normalise(c: Column) -> Column:
    """Lower case, white space folded; null becomes empty."""
    return fold_space(F.lower(F.coalesce(c, F.lit(""))))


def strip_question_prefix(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), rf"^{SPACE}*[0-9]+[.):\-\s]+", "")


def normalise_question(c: Column) -> Column:
    return strip(F.regexp_replace(normalise(strip_question_prefix(c)), r"[?.!]+$", ""))


def normalise_model_name(c: Column) -> Column:
    """A model's name without dates or a four-digit build; "" and "unknown" stay."""
    dated = F.regexp_replace(c, r"-?[0-9]{4}-?[0-9]{2}-?[0-9]{2}", "")
    return F.when((c == "") | (c == "unknown"), c).otherwise(F.regexp_replace(F.regexp_replace(dated, r"-[0-9]{4}$", ""), r"-+$", ""))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once for a row, however often it is used."""
    return F.get(F.transform(F.array(value), use), 0)


def overlap_ratio(query_tokens: Column, tokens: Column) -> Column:
    q = F.array_distinct(query_tokens)
    return F.size(F.array_intersect(q, tokens)) / F.greatest(F.size(q), F.lit(1))


def lexical_boost(query: Column, text: Column) -> Column:
    """0.7 if the text contains the query, 0.2 from three tenths of its tokens, 0.2 more from a half."""
    q = normalise(query)
    tokens = F.array_distinct(words(q))

    def value(padded: Column) -> Column:  # the text's words with one space at either side of each
        held = F.filter(tokens, lambda w: F.contains(padded, F.concat(F.lit(" "), w, F.lit(" "))))
        steps = once(F.size(held) / F.greatest(F.size(tokens), F.lit(1)), lambda ratio: F.when(ratio >= 0.5, 0.4).when(ratio >= 0.3, 0.2).otherwise(0.0))
        return F.when((q == "") | (padded == "  "), 0.0).otherwise(F.when(F.contains(padded, q), 0.7).otherwise(0.0) + steps)

    return once(F.concat(F.lit(" "), normalise(text), F.lit(" ")), value)


def keyword_score(query: Column, text: Column) -> Column:
    """Share of the query's words among the text's, plus half the share found as substrings, at most 1."""
    q, t = F.lower(F.coalesce(query, F.lit(""))), F.lower(F.coalesce(text, F.lit("")))
    qs = F.array_distinct(F.regexp_extract_all(q, F.lit(r"(?U)\b\w+\b"), 0))
    n = F.size(qs)
    # only words that are in the text at all are looked for between word bounds, up to the first place
    held = F.transform(qs, lambda w: F.when(~F.contains(t, w), 0).when(F.rlike(t, F.concat(F.lit(r"(?U)\b"), w, F.lit(r"\b"))), 3).otherwise(1))
    score = F.aggregate(held, F.lit(0.0), lambda s, x: s + F.when(x == 3, 1.5).when(x == 1, 0.5).otherwise(0.0)) / F.nullif(n, F.lit(0))
    return F.when((q == "") | (t == ""), 0.0).otherwise(F.coalesce(F.least(F.lit(1.0), score), F.lit(0.0)))


def listed_name(model: Column, names: Sequence[str]) -> Column:
    """The first of the names, in their order, that holds the model's name or is held by it, whatever the case; null for none."""
    m = F.lower(model)
    return F.get(F.filter(F.array(*map(F.lit, names)), lambda p: F.contains(m, F.lower(p)) | F.contains(F.lower(p), m)), 0)


def conversation_title(content: Column, max_length: int = 50, max_words: int = 7) -> Column:
    """The first words, cut at a word before ``max_length``, with "..." if anything is missing."""
    clean = strip(content)
    title = F.array_join(F.slice(words(clean), 1, max_words), " ")
    cut = F.left(title, F.lit(max_length))
    cut = F.when(F.contains(cut, F.lit(" ")), F.regexp_replace(cut, r" [^ ]*$", "")).otherwise(cut)
    title = F.when(F.length(title) > max_length, cut).otherwise(title)
    return F.when(content.isNull(), None).when(F.length(title) < F.length(clean), F.concat(title, F.lit("..."))).otherwise(title)


def snippet(c: Column, limit: int, mark: str) -> Column:
    return F.when(F.length(c) > limit, F.concat(F.left(c, F.lit(limit)), F.lit(mark))).otherwise(c)


def truncate_middle(c: Column, limit: Column) -> Column:
    """At most ``limit`` characters: four fifths from the beginning, the rest from the end."""
    mark = "... [truncated] ..."
    usable = limit - len(mark)
    begin = F.floor(usable * 0.8).cast("int")
    cut = F.concat(F.left(c, begin), F.lit(mark), F.right(c, usable - begin))
    return F.when(F.coalesce(c, F.lit("")) == "", "").when(F.length(c) <= limit, c).when(limit <= len(mark), F.left(c, limit)).otherwise(cut)


def escape_html(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def bold_html(c: Column) -> Column:
    """HTML-escaped text with ``**x**`` as strong; strong tags that are there stay."""
    bold = F.regexp_replace(escape_html(c), r"\*\*([^*]+)\*\*", "<strong>$1</strong>")
    return F.replace(F.replace(bold, F.lit("&lt;strong&gt;"), F.lit("<strong>")), F.lit("&lt;/strong&gt;"), F.lit("</strong>"))


# Content types by extension.
MIME = {
    ".pdf": "application/pdf",
    ".md": "text/markdown; charset=utf-8",
    ".txt": "text/plain; charset=utf-8",
    ".doc": "application/msword",
    ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    ".xls": "application/vnd.ms-excel",
    ".xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
}


def extension(path: Column) -> Column:
    """The last extension with its dot, lower case; empty without one."""
    return F.lower(F.regexp_extract(path, r"[^/.][^/]*?(\.[^./]*)$", 1))


def mime_type(ext: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in MIME.items() for x in pair])
    return F.coalesce(F.try_element_at(table, ext), F.lit("application/octet-stream"))


def page_link(url: Column, ext: Column, page: Column) -> Column:
    return F.when((ext == ".pdf") & (page.isNotNull() & (page != 0)), F.concat(url, F.lit("#page="), page.cast("string"))).otherwise(url)


def s3_key(url: Column, bucket: str | None = None) -> Column:
    """Object key of an ``s3://`` address, an Amazon address in either style, another web address, or a bare key."""
    u = strip(url)
    s3 = F.when(F.contains(F.substring(u, 6, 1 << 30), F.lit("/")), F.regexp_replace(u, "^s3://[^/]*/", ""))
    halves = F.split(u, r"amazonaws\.com/")
    amazon = F.split_part(F.get(halves, 1), F.lit("?"), F.lit(1))
    path = F.regexp_extract(u, r"^https?://[^/?#]*/*([^?#]*)", 1)
    web = F.startswith(u, F.lit("https://")) | F.startswith(u, F.lit("http://"))

    def bare(c: Column) -> Column:
        return F.regexp_replace(c, f"^{re.escape(bucket)}/", "") if bucket else c

    key = F.when(F.startswith(u, F.lit("s3://")), s3).when(web & (F.size(halves) == 2), bare(amazon)).when(web, bare(path)).otherwise(bare(u))
    return F.nullif(key, F.lit(""))


def scraped_name(label: Column, title: Column, url: Column) -> Column:
    """Label, else a real title, else host and path joined with underscores (100 characters); ends with .md."""
    host = F.replace(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1), F.lit("www."), F.lit(""))
    path = F.regexp_replace(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1), r"^/+|/+$", "")
    made = F.left(F.when(path != "", F.concat(host, F.lit("_"), F.replace(path, F.lit("/"), F.lit("_")))).otherwise(host), F.lit(100))
    name = F.when(label != "", label).when((title != "") & (title != "Untitled"), title).otherwise(made)
    return F.when(F.endswith(name, F.lit(".md")), name).otherwise(F.concat(name, F.lit(".md")))


# Greetings and small talk that need no search.
CASUAL = (
    "hi", "hello", "hey", "howdy", "greetings", "good morning", "good afternoon", "good evening", "sup", "what's up", "whats up", "yo",
    "how are you", "how are you doing", "how's it going", "hows it going", "what's new", "whats new", "how do you do",
    "thanks", "thank you", "ok", "okay", "cool", "nice", "bye", "goodbye", "see you", "later", "good night", "goodnight",
)


def is_casual(query: Column) -> Column:
    """Whether a query is a known phrase, or begins with one and goes on for at most 20 characters."""
    q = F.regexp_replace(strip(F.lower(query)), r"[!?.,:;]+$", "")
    return F.exists(F.array(*map(F.lit, CASUAL)), lambda p: F.startswith(q, p) & (F.length(q) <= F.length(p) + 20))


# Punctuation and its ASCII form.
_ASCII = {
    "‑": "-", "‒": "-", "–": "-", "—": "-", "―": "-", "‘": "'", "’": "'", "“": '"', "”": '"', "…": "...",
}


@F.arrow_udf(T.StringType())
def to_ascii(names: pa.Array) -> pa.Array:
    """Compatibility decomposition without what is not ASCII (Spark has no such function)."""
    table = str.maketrans(_ASCII)
    plain = lambda s: s if s is None or s.isascii() else unicodedata.normalize("NFKD", s.translate(table)).encode("ascii", "ignore").decode()
    return pa.concat_arrays([pa.array([], pa.string()), *(pa.array([plain(s) for s in names[rows].to_pylist()], pa.string()) for rows in parts(names))])


def safe_filename(name: Column) -> Column:
    """A name of ASCII word characters, dots and single hyphens."""
    clean = F.btrim(F.regexp_replace(to_ascii(name), "[^A-Za-z0-9_.]+", "-"), F.lit("-"))
    return F.when(clean == "", "conversation-report").otherwise(clean)
