"""Structured lookups: one subject's scores, comparisons, best and worst fields, promotions and service time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions.text import stored_value
from folioscope.operators.scope import Scope
from folioscope.operators.timeline import AmbiguousDocuments


def single_document(evaluations: DataFrame, documents: DataFrame, scope: Scope) -> str | None:
    """The scope's one document: several are an error even without an evaluation, none is one with an evaluation."""
    found = [r[0] for r in scope.rows(documents).select("doc_id").distinct().limit(2).collect()]
    if len(found) > 1:
        raise AmbiguousDocuments("several documents for a period")
    if not found and scope.rows(evaluations).limit(1).count():
        raise AmbiguousDocuments("an evaluation without a document")
    return found[0] if found else None


def field_lists(scores: DataFrame) -> DataFrame:
    """eval_id and fields, in the order of their codes."""
    item = F.struct("field_code", "value", F.col("id").alias("n"))
    return scores.groupBy("eval_id").agg(F.transform(F.sort_array(F.collect_list(item)), lambda x: F.struct(x["field_code"].alias("field_code"), x["value"].alias("value"), stored_value(x["value"]).alias("number"))).alias("fields"))


def score_records(evaluations: DataFrame, scores: DataFrame) -> DataFrame:
    """Evaluations as nested records: their fields, their duties (none: empty), and a second evaluator only if it has a name."""
    lists = field_lists(scores)
    out = evaluations.join(lists, evaluations["id"] == lists["eval_id"], "left").drop("eval_id")
    second = [c for c in out.columns if c.startswith("second_")]
    if second:
        named = F.col("second_name").isNotNull() & (F.col("second_name") != "")
        out = out.withColumn("second", F.when(named, F.struct(*[F.col(c).alias(c[7:]) for c in second]))).drop(*second)
    if "duties" in out.columns:
        out = out.withColumn("duties", F.coalesce("duties", F.array().cast(out.schema["duties"].dataType)))
    return out.withColumn("fields", F.coalesce("fields", F.array().cast(out.schema["fields"].dataType)))


def compare_periods(records: DataFrame, first: str, second: str) -> DataFrame:
    """Per subject the two periods' records side by side (null where there is none), and the sorted document ids of both."""
    side = lambda p, n: records.where(F.col("period") == p).select("person_id", F.struct(*[c for c in records.columns if c != "person_id"]).alias(n))
    both = side(first, "a").join(side(second, "b"), "person_id", "full_outer")
    ids = F.array_compact(F.array("a.doc_id", "b.doc_id"))
    return both.withColumn("citations", ids).withColumn("doc_ids", F.array_sort(F.array_distinct(ids)))


def top_bottom(scores: DataFrame, key: str = "eval_id", n: int = 3, left_out: str = "141") -> DataFrame:
    """Per key the n highest and n lowest numeric fields: side (top or bottom), place (from 1), field_code and number.

    Words and the code ``left_out`` have no part. Of equal values the smaller code is higher, and the larger one lower, as the bottom
    is the end of the top's order backwards; with fewer than 2n fields the two overlap.
    """
    if n < 1:
        raise ValueError("n is 1 at least")
    rows = scores.withColumn("number", stored_value(F.col("value"))).where(F.col("number").isNotNull() & (F.col("field_code") != left_out))
    best = Window.partitionBy(key).orderBy(F.desc("number"), "field_code")
    worst = Window.partitionBy(key).orderBy("number", F.desc("field_code"))
    sides = [rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n).select(key, F.lit(s).alias("side"), "place", "field_code", "number") for s, w in (("top", best), ("bottom", worst))]
    return sides[0].unionByName(sides[1])


def overall(scores: DataFrame, key: str = "eval_id", code: str = "141") -> DataFrame:
    return scores.where(F.col("field_code") == code).groupBy(key).agg(F.max(stored_value(F.col("value"))).alias("overall"))


def judged_for(promotions: DataFrame) -> DataFrame:
    """Promotions with the rank of the row whose index is one less, by value (of repeated indexes the last row's)."""
    prior = promotions.groupBy("person_id", (F.col("row_index") + 1).alias("row_index")).agg(F.max_by("rank", "id").alias("judged_for"))
    return promotions.join(prior, ["person_id", "row_index"], "left")


def service_time(rows: DataFrame) -> DataFrame:
    """Rows in the order of their index, with rank and unit as they are stored."""
    return rows.orderBy("person_id", "row_index")


def renumbered(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """row_index from 0 in the given order."""
    return rows.withColumn("row_index", F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1)


def code_order(code: str = "field_code") -> list:
    """The natural order of codes: their number, then their suffix; a code without digits comes last."""
    digits = F.regexp_extract(code, r"^(\d+)", 1)
    return [F.when(digits != "", digits.cast("int")).asc_nulls_last(), F.regexp_extract(code, r"^\d*(.*)$", 1)]
