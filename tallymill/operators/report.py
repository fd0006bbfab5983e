"""Conversation reports and prompts: lines classified to HTML, status lines, summaries as text, model families, access."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymill.functions.text import bold_html, escape_html, strip


def report_lines(reports: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Each line's kind (heading, bullet, number, paragraph), its HTML, and whether a bullet list opens before or closes after it.

    Lines with # are passed over; blank lines only close a list. Upper-case lines of over three characters are headings,
    without colons at their end; a bullet needs no space after its sign; numbered lines are paragraphs that keep their number.
    """
    rows = reports.select(key, F.posexplode(F.split(text, "\n")).alias("line_no", "line")).withColumn("line", strip(F.col("line"))).where("NOT startswith(line, '#')")
    line = F.col("line")
    upper = (F.upper(line) == line) & (F.lower(line) != line) & (F.length(line) > 3)
    kind = F.when(line == "", "blank").when(upper, "heading").when(line.rlike(r"^[-•*]"), "bullet").when(line.rlike(r"^[0-9][.)] "), "number").otherwise("paragraph")
    rows = rows.withColumn("kind", kind)
    heading = F.concat(F.lit("<h2>"), F.replace(escape_html(F.regexp_replace(line, ":+$", "")), F.lit('"'), F.lit("&quot;")), F.lit("</h2>"))
    bullet = F.concat(F.lit("<li>"), bold_html(strip(F.regexp_replace(line, r"^[-•* ]+", ""))), F.lit("</li>"))
    html = F.when(F.col("kind") == "heading", heading).when(F.col("kind") == "bullet", bullet).otherwise(F.concat(F.lit("<p>"), bold_html(line), F.lit("</p>")))
    w = Window.partitionBy(key).orderBy("line_no")
    listed = F.col("kind") == "bullet"
    edge = lambda other: listed & ~F.coalesce(other == "bullet", F.lit(False))
    out = rows.withColumn("html", html).withColumn("opens", edge(F.lag("kind").over(w))).withColumn("closes", edge(F.lead("kind").over(w)))
    return out.where("kind <> 'blank'").select(key, "line_no", "kind", "html", "opens", "closes")


def report_html(lines: DataFrame, key: str) -> DataFrame:
    """The lines of each report joined, lists opened and closed on lines of their own."""
    part = F.concat(F.when(F.col("opens"), "<ul>\n").otherwise(""), "html", F.when(F.col("closes"), "\n</ul>").otherwise(""))
    held = F.array_sort(F.collect_list(F.struct("line_no", part.alias("part"))))
    return lines.groupBy(key).agg(F.array_join(F.transform(held, lambda x: x["part"]), "\n").alias("html"))


# What the service says while a tool runs.
STATUS = {
    "search_knowledge_base": "Searching documents for '{query}'…",
    "find_relevant_documents": "Looking for documents about '{query}'…",
    "list_documents": "Listing available documents{category}…",
    "search_tables": "Searching financial/tabular data for '{query}'…",
    "get_document_details": "Examining document {document_id}…",
}


def status_line(tool: Column, query: Column, category: Column, document_id: Column) -> Column:
    """The line of a tool's call: 60 characters of the query, the category in brackets if there is one, the document."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    values = {"{query}": F.left(text(query), F.lit(60)), "{category}": F.when(text(category) != "", F.concat(F.lit(" ("), category, F.lit(")"))).otherwise(""), "{document_id}": text(document_id)}
    out = F.concat(F.lit("Running "), tool, F.lit("…"))
    for name, template in STATUS.items():
        line = F.lit(template)
        for field, value in values.items():
            line = F.replace(line, F.lit(field), value) if field in template else line
        out = F.when(tool == name, line).otherwise(out)
    return out


def _named(label: str, values: Column) -> Column:
    return F.when(F.size(values) > 0, F.concat(F.lit(label), F.array_join(values, "; ")))


def stored_summary(summary: Column, topics: Column, entities: Column) -> Column:
    """A document's summary as people read it; empty parts are left out."""
    return F.concat_ws("\n\n", F.nullif(summary, F.lit("")), _named("Key topics: ", topics), _named("Key entities: ", entities))


def embedded_summary(kind: Column, date: Column, summary: Column, topics: Column, entities: Column) -> Column:
    """A document's summary as it is embedded: type and date always, then the parts that are not empty."""
    head = F.concat(F.coalesce(kind, F.lit("")), F.lit(" – "), F.coalesce(date, F.lit("")))
    return F.concat_ws("\n", head, F.nullif(summary, F.lit("")), _named("Topics: ", topics), _named("Entities: ", entities))


def first_prefix(name: Column, prefixes: list[str], default: str) -> Column:
    """The name itself if listed, else the first listed prefix of it, else the default."""
    listed = F.array(*map(F.lit, prefixes))
    return F.when(F.array_contains(listed, name), name).otherwise(F.coalesce(F.get(F.filter(listed, lambda p: F.startswith(name, p)), 0), F.lit(default)))


def accessible(rows: DataFrame, tenant_id: int, role: str, user_id: int | None = None) -> DataFrame:
    """Rows a caller may see: a super-admin all, an admin the tenant's, others their own in the tenant."""
    if role == "super_admin":
        return rows
    mine = rows.where(F.col("tenant_id") == tenant_id)
    return mine if role == "admin" else mine.where(F.col("user_id") == user_id)
