"""Pages to sections and chunks: headings that carry forward, subsections, paragraphs, long texts and context markers.

Order is a column: rows of a document are ordered by (page, line) or by seq, never by where they happen to be.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions.text import best_match, stripped


def lines(pages: DataFrame) -> DataFrame:
    """(doc_id, page, line, text): the lines of pages (doc_id, page, text)."""
    return pages.select("doc_id", "page", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line", "text"))


def section_chunks(pages: DataFrame, titles: Sequence[str]) -> DataFrame:
    """(doc_id, seq, page, section, text, fallback) of pages (doc_id, page, text).

    A heading opens a section until the next; a page without one goes on with the last, and so does the text above a page's first
    heading. Text before a document's first heading is dropped. A document without any heading falls back to its paragraphs, with a null section.
    """
    rows = lines(pages).withColumn("heading", best_match(F.col("text"), titles))
    before = Window.partitionBy("doc_id").orderBy("page", "line").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("section", F.last("heading", ignorenulls=True).over(before)).withColumn("part", F.count("heading").over(before))
    body = rows.where(F.col("section").isNotNull() & F.col("heading").isNull())
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n")
    known = body.groupBy("doc_id", "page", "part", "section").agg(stripped(text).alias("text")).where("text <> ''")
    seq = Window.partitionBy("doc_id").orderBy("page", "part")
    known = known.withColumn("seq", F.row_number().over(seq) - 1).select("doc_id", "seq", "page", "section", "text", F.lit(False).alias("fallback"))
    plain = pages.join(rows.where("heading is not null").select("doc_id").distinct(), "doc_id", "left_anti")
    return known.unionByName(paragraphs(plain).select("doc_id", "seq", "page", F.lit(None).cast("string").alias("section"), "text", F.lit(True).alias("fallback")))


def paragraphs(pages: DataFrame) -> DataFrame:
    """(doc_id, page, seq, text): what blank lines divide, without blank parts; seq runs over a document's pages."""
    parts = pages.select("doc_id", "page", F.posexplode(F.split("text", r"\n\s*\n")).alias("p", "text")).withColumn("text", stripped(F.col("text"))).where("text <> ''")
    return parts.withColumn("seq", F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "p")) - 1).drop("p")


def carry_subsections(chunks: DataFrame, headers: Column) -> DataFrame:
    """chunks (doc_id, seq, section, text) with ``subsection``: the last header of earlier chunks of the same run of a section.

    ``headers`` is an array of a text's headers in order. A chunk that begins with a header has that one; a change of section
    starts anew, also when an earlier section comes back; a header in the middle counts from the next chunk on.
    """
    order = Window.partitionBy("doc_id").orderBy("seq")
    changed = (~F.col("section").eqNullSafe(F.lag("section").over(order))).cast("int")
    rows = chunks.withColumn("headers", headers).withColumn("changed", changed).withColumn("stretch", F.sum("changed").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    earlier = Window.partitionBy("doc_id", "stretch").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("last", F.when(F.size("headers") > 0, F.element_at("headers", -1)))
    first = F.trim(F.regexp_extract("text", r"^\s*([^\n]*)", 1))
    own = F.when((F.size("headers") > 0) & (first == F.get("headers", F.lit(0))), first)
    return rows.withColumn("subsection", F.coalesce(own, F.last("last", ignorenulls=True).over(earlier))).drop("headers", "changed", "stretch", "last")


def marked(text: Column, marker: Column) -> Column:
    """The marker on a line before the text, once: a null marker or a text that has it changes nothing."""
    return F.when(marker.isNull() | F.startswith(text, marker), text).otherwise(F.concat(marker, F.lit("\n"), text))


def with_markers(chunks: DataFrame) -> DataFrame:
    """The continuation of a subsection, then before it the section, as lines above each text."""
    inner = marked(F.col("text"), F.when(F.col("subsection").isNotNull(), F.concat(F.lit("[continued: "), F.col("subsection"), F.lit("]"))))
    inner = F.when(F.startswith(F.col("text"), F.coalesce("subsection", F.lit("\0"))), F.col("text")).otherwise(inner)
    return chunks.withColumn("text", marked(inner, F.when(F.col("section").isNotNull(), F.concat(F.lit("[section: "), F.col("section"), F.lit("]")))))


def sections_joined(chunks: DataFrame) -> DataFrame:
    """(doc_id, section, text): a section's texts in order, one to a line."""
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), "\n")
    return chunks.groupBy("doc_id", "section").agg(text.alias("text"))


def page_of_offset(offsets: DataFrame, pages: DataFrame) -> DataFrame:
    """offsets (doc_id, offset) with the page that the offset lies on in the pages' texts joined by line ends; clamped to the ends."""
    before = Window.partitionBy("doc_id").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    starts = pages.select("doc_id", "page", F.coalesce(F.sum(F.length("text") + 1).over(before), F.lit(0)).alias("begin"))
    spans = starts.withColumn("next", F.lead("begin").over(Window.partitionBy("doc_id").orderBy("page"))).withColumn("first", F.row_number().over(Window.partitionBy("doc_id").orderBy("page")) == 1)
    left = (F.col("offset") >= F.col("begin")) | F.col("first")
    right = F.col("next").isNull() | (F.col("offset") < F.col("next"))
    o, s = offsets.alias("o"), spans.alias("s")
    return o.join(s, (F.col("o.doc_id") == F.col("s.doc_id")) & left & right, "left").select("o.*", "s.page")


def line_groups(rows: DataFrame) -> DataFrame:
    """rows (doc_id, line, text) with group: runs of lines that are not blank, from 0; blank lines go."""
    order = Window.partitionBy("doc_id").orderBy("line")
    blank = F.trim("text") == ""
    opens = ~blank & F.coalesce(F.lag(blank).over(order), F.lit(True))
    return rows.withColumn("group", F.sum(opens.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1).where(~blank)


def blocks(rows: DataFrame, anchor: Column) -> DataFrame:
    """rows (doc_id, line, ...) with block: from an anchor to the one before the next, from 0; rows above the first anchor go."""
    order = Window.partitionBy("doc_id").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("block", F.sum(anchor.cast("int")).over(order) - 1).where("block >= 0")
