"""Evaluation of retrieval and answers: recall, precision, leaks, statuses and their summaries."""

from __future__ import annotations

import re
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions.text import is_mixed_script

STATUSES = ("pass", "fail", "weak", "known_gap", "needs_human", "error")


def case_metrics(cases: DataFrame, retrieved: DataFrame, truth: DataFrame, expected: DataFrame | None = None) -> DataFrame:
    """Per case (case_id, person_id, period): recall and precision of its retrieved documents, leaks and empty_ok.

    expected and retrieved have (case_id, doc_id), truth (doc_id, person_id, period); without ``expected``, cases have an array of that name. A
    retrieved document of another scope, or without truth, is a leak. With nothing expected, recall and precision are null, and empty_ok
    tells whether nothing was retrieved; else empty_ok is null. Documents stay rows: they are counted by case and document first, then by case.
    """
    wanted = expected if expected is not None else cases.select("case_id", F.explode("expected").alias("doc_id"))
    known = truth.groupBy("doc_id").agg(F.min("person_id").alias("t_person"), F.collect_set("period").alias("t_periods"))
    rows = retrieved.join(known, "doc_id", "left").join(cases.select("case_id", "person_id", "period"), "case_id")
    own = F.col("t_person").eqNullSafe(F.col("person_id")) & F.coalesce(F.array_contains("t_periods", F.col("period")), F.lit(False))
    each = rows.select("case_id", "doc_id", F.lit(0).alias("e"), F.lit(1).alias("r"), (~own).cast("int").alias("leak")).union(wanted.where("doc_id is not null").select("case_id", "doc_id", F.lit(1), F.lit(0), F.lit(0)))
    each = each.groupBy("case_id", "doc_id").agg(F.max("e").alias("e"), F.max("r").alias("r"), F.sum("leak").alias("leak"))
    found = each.groupBy("case_id").agg(F.sum("e").alias("e"), F.sum("r").alias("r"), F.sum(F.col("e") * F.col("r")).alias("hit"), F.sum("leak").alias("leaks"))
    out = cases.select("case_id").join(found, "case_id", "left").na.fill(0, ["e", "r", "hit", "leaks"])
    some = F.col("e") > 0
    return out.select(
        "case_id",
        F.when(some, F.col("hit") / F.col("e")).alias("recall"),
        F.when(some, F.when(F.col("r") > 0, F.col("hit") / F.col("r")).otherwise(0.0)).alias("precision"),
        F.col("leaks").cast("long").alias("leaks"),
        F.when(~some, F.col("r") == 0).alias("empty_ok"),
    )


def roll_up(metrics: DataFrame) -> DataFrame:
    """One row: mean recall and precision (NaN without any), all leaks, whether there are empty cases and all are right, and the gate."""
    out = metrics.agg(F.coalesce(F.avg("recall"), F.lit(float("nan"))).alias("recall"), F.coalesce(F.avg("precision"), F.lit(float("nan"))).alias("precision"), F.coalesce(F.sum("leaks"), F.lit(0)).alias("leaks"), (F.coalesce(F.every("empty_ok"), F.lit(False))).alias("empty_ok"))
    return out.withColumn("passed", (F.col("leaks") == 0) & F.col("empty_ok"))


def status_table(results: DataFrame) -> DataFrame:
    """Tier by status, with a total."""
    table = results.groupBy("tier").pivot("status", list(STATUSES)).count().na.fill(0)
    return table.withColumn("total", sum(F.col(s) for s in STATUSES)).orderBy("tier")


def repeated_ids(rows: DataFrame, key: str = "id") -> DataFrame:
    """Ids that occur more than once; each repeat is a problem."""
    return rows.groupBy(key).agg((F.count("*") - 1).alias("repeats")).where("repeats > 0")


def compared(kind: Column, value: Column, values: Column, answer: Column) -> Column:
    """Whether an answer has the one value (exact), or all values as substrings (set or contains)."""
    return F.when(kind == "exact", F.trim(answer) == F.trim(value)).when(kind.isin("set", "contains"), F.forall(values, lambda v: F.contains(answer, v)))


def forbidden(answer: Column, patterns: Sequence[str]) -> Column:
    return F.coalesce(*[F.when(answer.rlike(p), F.lit(True)) for p in patterns], F.lit(False)) if patterns else F.lit(False)


def status(tier: Column, ok: Column, known_gap: Column, error: Column, shortest: Column) -> Column:
    """An error first; a known gap is neither pass nor fail; tier C is always left to people; values of under three characters are weak."""
    return F.when(error, "error").when(known_gap, "known_gap").when(tier == "C", "needs_human").when(ok & (shortest < 3), "weak").when(ok, "pass").otherwise("fail")


def question_problems(questions: DataFrame, broken_lines: DataFrame | None = None) -> DataFrame:
    """(id, problem) for questions (id, tier, text, forbidden_patterns, notes): mixed scripts, repeated ids, bad patterns, tier C without notes.

    ``broken_lines`` (id, problem) are lines that could not be read as questions; they are problems too.
    """

    @F.arrow_udf("boolean")
    def broken(patterns: pa.Array) -> pa.Array:
        def bad(p: str) -> bool:
            try:
                re.compile(p)
            except re.error:
                return True
            return False

        return pa.array([any(map(bad, ps or [])) for ps in patterns.to_pylist()])

    mixed = F.exists(F.split("text", r"\s+"), is_mixed_script)
    found = F.array_compact(F.array(F.when(mixed, F.lit("mixed script")), F.when(broken("forbidden_patterns"), F.lit("bad pattern")), F.when((F.col("tier") == "C") & F.coalesce(F.trim("notes") == "", F.lit(True)), F.lit("no notes"))))
    own = questions.select("id", F.explode(found).alias("problem"))
    found = own.union(repeated_ids(questions).select("id", F.lit("repeated id")))
    return found if broken_lines is None else found.union(broken_lines.select("id", "problem"))
