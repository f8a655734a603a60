"""Tables that a text holds as groups of lines below a header: found, read as rows, and rewritten in place as labelled lines."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions.text import stripped

#: rank, date of decision, decision (one line or more), date of promotion
LEAST_LINES = 4


#: White space within a line, a run of lines that are not blank (possessive, so that its length is no depth of recursion), and all else below a header.
_BLANK = r"[^\S\n]"
_GROUP = rf"{_BLANK}*+\S[^\n]*+(?:\n{_BLANK}*+\S[^\n]*+)*+"
_TOKEN = rf"{_GROUP}|\n|{_BLANK}++"


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def head(text: Column, header: Sequence[str]) -> Column:
    """The text down to the end of the header, whose lines stand one after another, each by itself; null without one."""
    lines = r"\n".join(rf"{_BLANK}*+{re.escape(x)}{_BLANK}*+" for x in header)
    return F.nullif(F.regexp_extract(text, rf"(?s)\A(?:.*?\n)??{lines}(?=\n|\z)", 0), F.lit(""))


def _below(text: Column, upto: Column) -> Column:
    return F.substring(text, F.length(upto) + 1, F.length(text))


def _decision(group: Column) -> Column:
    """The lines between the second and the last, joined by blanks, but for none behind a hyphen."""
    lines = F.transform(F.slice(group, F.lit(3), F.greatest(F.size(group) - 3, F.lit(0))), stripped)
    return F.replace(F.replace(F.array_join(lines, "\n"), F.lit("-\n"), F.lit("-")), F.lit("\n"), F.lit(" "))


def _parsed(group: Column) -> Column:
    last = F.element_at(group, -1)
    return F.struct(stripped(F.get(group, F.lit(0))).alias("rank"), stripped(F.get(group, F.lit(1))).alias("decision_date"), _decision(group).alias("decision"), stripped(last).alias("promotion_date"))


def _kind(group: Column, header: Sequence[str]) -> Column:
    """labelled: it was rewritten before; short: too few lines to tell which is which; row."""
    labelled = F.exists(group, lambda line: F.startswith(stripped(line), F.lit(f"{header[0]}: ")))
    return F.when(labelled, "labelled").when(F.size(group) < LEAST_LINES, "short").otherwise("row")


def annotated(text: Column, header: Sequence[str]) -> Column:
    """The text with each row of the table below the header as one line ``label: value | ...`` with the header's labels.

    What stands above, the header itself, blank lines, groups of under four lines and rows that are labelled already stay as they are, so a second
    time changes nothing. A text without the header stays; null stays null.
    """
    upto = head(text, header)

    def closed(run: Column) -> Column:
        row = _parsed(run)
        line = F.concat(*[x for i, (label, name) in enumerate(zip(header, ("rank", "decision_date", "decision", "promotion_date"), strict=True)) for x in (F.lit(f"{' | ' if i else ''}{label}: "), row[name])])
        return F.when(_kind(run, header) == "row", line).otherwise(F.array_join(run, "\n"))

    runs = F.transform(F.regexp_extract_all(_below(text, upto), F.lit(_TOKEN), F.lit(0)), _lines)
    return F.when(upto.isNull(), text).otherwise(F.concat(upto, F.array_join(F.transform(runs, closed), "")))


def promotion_groups(texts: DataFrame, header: Sequence[str]) -> DataFrame:
    """(doc_id, place, kind, rank, decision_date, decision, promotion_date, lines) of texts (doc_id, text): every group below the header, from 0.

    kind is row, or why the group is none: short (a reject, with its lines) or labelled. Values are as they stand in the text.
    """
    if len(header) != LEAST_LINES:
        raise ValueError("the header has a line for each of the four values")
    upto = head(F.col("text"), header)
    groups = texts.where(upto.isNotNull()).select("doc_id", F.posexplode(F.regexp_extract_all(_below(F.col("text"), upto), F.lit(_GROUP), F.lit(0))).alias("place", "g"))
    groups = groups.select("doc_id", "place", _lines(F.col("g")).alias("lines"))
    rows = groups.withColumn("kind", _kind(F.col("lines"), header)).withColumn("row", F.when(F.col("kind") == "row", _parsed(F.col("lines"))))
    return rows.select("doc_id", "place", "kind", "row.rank", "row.decision_date", "row.decision", "row.promotion_date", "lines")
