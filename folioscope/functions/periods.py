"""Periods as ``start..end`` text, and how they and their scores are written."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def period(start: Column, end: Column) -> Column:
    return F.concat_ws("..", F.date_format(start, "yyyy-MM-dd"), F.date_format(end, "yyyy-MM-dd"))


def period_range(text: Column) -> Column:
    """from, to (one day past the end) and middle (a timestamp) of a period; a single date is one day."""
    start, last = F.try_to_date(F.substring_index(text, "..", 1), "yyyy-MM-dd"), F.try_to_date(F.substring_index(text, "..", -1), "yyyy-MM-dd")
    end = F.date_add(last, 1)
    half = (F.unix_timestamp(end.cast("timestamp")) + F.unix_timestamp(start.cast("timestamp"))) / 2
    return F.struct(start.alias("from"), end.alias("to"), F.timestamp_seconds(half).alias("middle"))


def period_label(start: Column, end: Column) -> Column:
    """A whole year or half year by name, else the range."""
    same, s, e = F.year(start) == F.year(end), F.date_format(start, "MM-dd"), F.date_format(end, "MM-dd")
    y = F.year(start).cast("string")
    return (
        F.when(same & (s == "01-01") & (e == "12-31"), y)
        .when(same & (s == "01-01") & (e == "06-30"), F.concat(F.lit("H1 "), y))
        .when(same & (s == "07-01") & (e == "12-31"), F.concat(F.lit("H2 "), y))
        .otherwise(F.concat(F.date_format(start, "dd/MM/yyyy"), F.lit(" - "), F.date_format(end, "dd/MM/yyyy")))
    )


def score_text(score: Column) -> Column:
    """At most one decimal, with a comma."""
    short = F.regexp_replace(F.format_string("%.1f", score.cast("double")), r"\.0$", "")
    return F.when(score.isNotNull(), F.replace(short, F.lit("."), F.lit(",")))


def delta_text(delta: Column) -> Column:
    """A change with its sign, ±0 for none."""
    sign = F.when(delta > 0, F.lit("+")).when(delta < 0, F.lit("-"))
    return F.when(delta == 0, F.lit("±0")).otherwise(F.concat(sign, score_text(F.abs(delta))))


def citation_text(doc_id: Column, page: Column) -> Column:
    """``document, page n``; without a page the document alone."""
    return F.concat_ws(", ", doc_id, F.when(page.isNotNull(), F.concat(F.lit("page "), page.cast("string"))))
