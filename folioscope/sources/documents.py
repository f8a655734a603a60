"""Reading pages, files and question sets."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions.text import content_id, stripped

#: Pages with less text than this are read from their image, where a reader is given.
LEAST_TEXT = 20


def files(spark: SparkSession, path: str) -> DataFrame:
    """(path, doc_id, length, content) of all files below a path."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return raw.select("path", content_id(F.col("content")).alias("doc_id"), "length", "content")


def page_text(blocks: DataFrame) -> DataFrame:
    """(doc_id, page, text) of text blocks (doc_id, page, kind, x0, y0, text): kind 0, not blank, from top to bottom, a blank line apart."""
    kept = blocks.where((F.col("kind") == 0) & (stripped(F.col("text")) != ""))
    parts = F.sort_array(F.collect_list(F.struct("y0", "x0", stripped(F.col("text")).alias("text"))))
    return kept.groupBy("doc_id", "page").agg(F.array_join(F.transform(parts, lambda b: b["text"]), "\n\n").alias("text"))


def with_image_text(pages: DataFrame, read: Column) -> DataFrame:
    """Pages with little text get what ``read`` (a column, perhaps of a function on the image) finds; an empty finding changes nothing."""
    short = F.length(F.trim(F.coalesce("text", F.lit("")))) < LEAST_TEXT
    return pages.withColumn("text", F.when(short, F.coalesce(F.nullif(read, F.lit("")), F.col("text"))).otherwise(F.col("text")))


def html_text(html: Column) -> Column:
    """The visible text of a web page, a line for each block: scripts, styles, navigation, comments and tags go, entities are resolved."""
    t = F.regexp_replace(html, r"(?is)<(script|style|nav|head)\b[^>]*>.*?</\1\s*>|<!--.*?-->", " ")
    t = F.regexp_replace(t, r"(?i)<(?:br|/?(?:p|div|article|h[1-6]|li|ul|ol|tr|table|section))\b[^>]*>", "\n")
    t = F.regexp_replace(t, r"<[^>]*>", "")
    for name, c in (("nbsp", " "), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "'"), ("amp", "&")):
        t = F.replace(t, F.lit(f"&{name};"), F.lit(c))
    return stripped(F.regexp_replace(F.regexp_replace(t, r"[ \t]+", " "), r"\s*\n\s*", "\n"))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One record a line; blank lines are skipped, and a bad line fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


#: The column of a line that is no record.
BROKEN = "broken_line"


def json_lines_or_problems(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """The records of a file of JSON lines; and (id, problem, line) of the lines that are none, which the read goes past.

    A line is broken if it isn't JSON, or if a value does not fit the schema. The id of a broken line is the one that can still be read in it, or null. Blank lines are skipped.
    """
    lines = spark.read.text(path).where(F.trim("value") != "")
    kept = lines.select("value", F.from_json("value", f"{schema}, {BROKEN} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BROKEN}).alias("r"))
    bad = F.col("r").isNull() | F.col(f"r.{BROKEN}").isNotNull()
    names = [c for c in spark.createDataFrame([], schema).columns]
    own = F.nullif(F.regexp_extract("value", r'"id"\s*:\s*"?([^",}\s]+)', 1), F.lit(""))
    return kept.where(~bad).select(*[F.col(f"r.{c}").alias(c) for c in names]), kept.where(bad).select(own.alias("id"), F.lit("bad json").alias("problem"), F.col("value").alias("line"))


def json_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One array of records in a file."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def latest_version(listing: DataFrame, name: str, version: str = "latest") -> DataFrame:
    """From paths ``.../name/vN.txt`` the one of the given version, or of the largest number (v10 after v9)."""
    if version != "latest" and not re.fullmatch(r"v\d+", version):
        raise ValueError(f"not a version: {version}")
    found = listing.withColumn("n", F.regexp_extract("path", rf"/{re.escape(name)}/v(\d+)\.txt$", 1)).where("n <> ''").withColumn("n", F.col("n").cast("int"))
    found = found if version == "latest" else found.where(F.col("n") == int(version[1:]))
    return found.agg(F.max_by("path", "n").alias("path"), F.max("n").alias("version")).where("path is not null")


def access(requests: DataFrame, documents: DataFrame, contents: DataFrame, root: str, enabled: bool = True, largest: int = 50 << 20) -> DataFrame:
    """requests (doc_id, person_id, period) with refusal: the first reason not to hand out a stored file, or null.

    documents has (doc_id, person_id, period, path), contents (path, length, content; a null content could not be read).
    """
    rows = requests.join(documents, ["doc_id", "person_id", "period"], "left").join(contents, "path", "left")
    escapes = ~F.startswith(F.col("path"), F.lit(root.rstrip("/") + "/")) | F.col("path").rlike(r"(^|/)\.\.(/|$)")
    refusal = (
        F.when(F.lit(not enabled), "disabled").when(F.col("path").isNull(), "no_such_document").when(escapes, "outside_root").when(F.col("length").isNull(), "missing")
        .when(~F.lower("path").endswith(".pdf"), "not_pdf").when(F.col("length") > largest, "too_large").when(F.col("content").isNull(), "unreadable")
        .when(content_id(F.col("content")) != F.col("doc_id"), "changed")
    )
    return rows.select("doc_id", "person_id", "period", refusal.alias("refusal"))
