"""Checks of a question before anything is retrieved: known field codes, covered years, existing periods, and where to route it."""

from __future__ import annotations

from collections.abc import Sequence
from difflib import SequenceMatcher
from functools import reduce
from operator import or_

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions.text import field_code, folded, plain_form, years
from folioscope.operators.scope import CAREER
from folioscope.operators.structured import code_order


def known_codes(scores: DataFrame, vocabulary: Sequence[str]) -> DataFrame:
    """The codes of the vocabulary and of all stored scores, of any subject."""
    fixed = scores.sparkSession.createDataFrame([(c,) for c in vocabulary], "field_code string")
    return scores.select("field_code").union(fixed).distinct()


def covered_years(evaluations: DataFrame) -> DataFrame:
    """(person_id, year) for every year that one of a subject's periods touches."""
    return evaluations.select("person_id", F.explode(F.sequence(F.year("period_start"), F.year("period_end"))).alias("year")).distinct()


def check_field_codes(questions: DataFrame, codes: DataFrame, prefixes: Sequence[str]) -> DataFrame:
    """questions with field_code (of the text) and unknown_code (whether it isn't one of ``codes``)."""
    asked = questions.withColumn("field_code", field_code(F.col("text"), prefixes))
    known = codes.select("field_code").distinct().withColumn("known", F.lit(True))
    return asked.join(known, "field_code", "left").withColumn("unknown_code", F.col("field_code").isNotNull() & F.col("known").isNull()).drop("known")


def code_list(codes: DataFrame) -> DataFrame:
    """The known codes in their natural order, as a refusal shows them."""
    return codes.orderBy(*code_order())


def check_years(questions: DataFrame, evaluations: DataFrame, prefixes: Sequence[str] = ()) -> DataFrame:
    """questions (person_id, period, text) with year_status and its details.

    out_of_range: bad_year is the first year that no period of the subject covers; first_start and last_end are the start of the earliest
    and the end of the latest-starting period. other_period: all years are covered, but bad_year lies outside the chosen
    period; candidates are the periods with it, in order. Otherwise, without years or without periods: ok.
    """
    span = evaluations.groupBy("person_id").agg(F.min("period_start").alias("first_start"), F.max_by("period_end", F.struct("period_start", "id")).alias("last_end"), F.sort_array(F.collect_list(F.struct("period_start", "period_end", "period"))).alias("all"))
    rows = questions.withColumn("years", years(F.col("text"), prefixes)).join(span, "person_id", "left")
    inside = lambda y: lambda p: y.between(F.year(p["period_start"]), F.year(p["period_end"]))
    uncovered = F.filter("years", lambda y: ~F.exists("all", inside(y)))
    own = F.filter("all", lambda p: p["period"] == F.col("period"))
    outside = F.filter("years", lambda y: ~F.exists(own, inside(y)))
    rows = rows.withColumn("uncovered", uncovered).withColumn("outside", outside).withColumn("own", own)
    any_ = (F.size("years") > 0) & F.col("all").isNotNull()
    status = F.when(any_ & (F.size("uncovered") > 0), "out_of_range").when(any_ & (F.col("period") != CAREER) & (F.size("own") > 0) & (F.size("outside") > 0), "other_period").otherwise("ok")
    rows = rows.withColumn("year_status", status)
    bad = F.when(F.col("year_status") == "out_of_range", F.get("uncovered", F.lit(0))).when(F.col("year_status") == "other_period", F.get("outside", F.lit(0)))
    rows = rows.withColumn("bad_year", bad)
    held = F.when(F.col("year_status") == "other_period", F.transform(F.filter("all", lambda p: inside(F.col("bad_year"))(p)), lambda p: p["period"]))
    return rows.withColumn("candidates", held).drop("all", "own", "uncovered", "outside")


def check_questions(questions: DataFrame, evaluations: DataFrame, codes: DataFrame, prefixes: Sequence[str]) -> DataFrame:
    """Both checks; refusal is the first that fails, the code's before the years'."""
    rows = check_years(check_field_codes(questions, codes, prefixes), evaluations, prefixes)
    year = F.when(F.col("year_status") != "ok", F.col("year_status"))
    return rows.withColumn("refusal", F.coalesce(F.when(F.col("unknown_code"), F.lit("unknown_field_code")), year))


def existing_periods(scopes: DataFrame, documents: DataFrame) -> DataFrame:
    """The scopes (person_id, period) that have a document."""
    return scopes.join(documents.select("person_id", "period"), ["person_id", "period"], "left_semi")


def route(question: Column, score_words: Sequence[str], section_titles: Sequence[str], career_words: Sequence[str], least: float = 0.75) -> Column:
    """Whether a question fits a structured lookup: it has a score word and names a section, or has a word of promotions or service.

    Words count as substrings of the folded question; a title also counts if a run of as many words is similar enough.
    """
    plain = folded(question)
    has = lambda words: reduce(or_, (plain.contains(plain_form(w)) for w in words), F.lit(False))

    def mentions(title: str) -> Column:
        form = plain_form(title)
        return plain.contains(form) | (_best_run(plain, form) >= least)

    named = reduce(or_, map(mentions, section_titles), F.lit(False))
    return (has(score_words) & named) | has(career_words)


def _best_run(plain: Column, form: str) -> Column:
    """The highest fuzzy ratio of a form and any run of as many words."""
    n = len(form.split())

    @F.arrow_udf("double")
    def best(column: pa.Array) -> pa.Array:
        def one(text: str) -> float:
            words = text.split()
            return max(SequenceMatcher(None, " ".join(words[i : i + n]), form).ratio() for i in range(max(1, len(words) - n + 1)))

        return pa.array([None if x is None else one(x) for x in column.to_pylist()], pa.float64())

    return best(plain)
