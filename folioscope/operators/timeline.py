"""Timelines: one row for each evaluation of a subject, in order, for one subject or all at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ORDER = ("period_start", "id")


class AmbiguousDocuments(ValueError):
    """A subject has several documents, or none, for a period."""


def violations(evaluations: DataFrame, documents: DataFrame) -> DataFrame:
    """person_id, period and documents, where a period has several documents or an evaluation has none."""
    many = documents.groupBy("person_id", "period").agg(F.countDistinct("doc_id").alias("documents")).where("documents > 1")
    none = evaluations.select("person_id", "period").distinct().join(documents, ["person_id", "period"], "left_anti").withColumn("documents", F.lit(0).cast("long"))
    return many.unionByName(none)


def points(evaluations: DataFrame, documents: DataFrame) -> DataFrame:
    """Evaluations with their documents. Run ``checked`` first where a wrong document must never be shown."""
    one = documents.groupBy("person_id", "period").agg(F.min("doc_id").alias("doc_id"), F.countDistinct("doc_id").alias("documents"))
    return evaluations.join(one, ["person_id", "period"], "left")


def checked(evaluations: DataFrame, documents: DataFrame) -> DataFrame:
    """``points``, after an action that makes sure that each evaluation has one document; else AmbiguousDocuments."""
    if bad := violations(evaluations, documents).limit(1).count():
        raise AmbiguousDocuments(f"{bad} or more periods without exactly one document")
    return points(evaluations, documents).drop("documents")


def with_delta(rows: DataFrame) -> DataFrame:
    """delta from the last period that has a score; null where this one has none, or none came before."""
    w = Window.partitionBy("person_id").orderBy(*ORDER)
    return rows.withColumn("delta", F.col("score") - F.last("score", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))


def with_runs(rows: DataFrame) -> DataFrame:
    """run: the number of the stretch of scored periods a row belongs to (a period without score ends one), null without score."""
    w = Window.partitionBy("person_id").orderBy(*ORDER)
    gaps = F.sum(F.when(F.col("score").isNull(), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("run", F.when(F.col("score").isNotNull(), gaps))


def stats(rows: DataFrame) -> DataFrame:
    """Per subject: periods (all), scored, mean, low and last (in order) of the scores, the first row at the lowest, and gaps."""
    key = F.struct(*ORDER)
    scored = F.col("score").isNotNull()
    return rows.groupBy("person_id").agg(
        F.count("*").alias("periods"),
        F.count("score").alias("scored"),
        F.avg("score").alias("mean"),
        F.min("score").alias("low"),
        F.max_by(F.when(scored, F.col("score")), F.when(scored, key)).alias("last"),
        F.min_by(F.when(scored, F.col("id")), F.when(scored, F.struct("score", *ORDER))).alias("low_id"),
        F.count_if(~scored).alias("gaps"),
    )


def axis(low: Column, mode: str) -> Column:
    """The lower end of a score axis up to 100: whole, fixed (80, or lower) or zoomed to just below the lowest score."""
    floor = F.floor(F.coalesce(low, F.lit(100.0)))
    return {"full": F.lit(0).cast("long"), "fixed": F.least(F.lit(80), floor), "zoom": F.greatest(F.lit(0), F.least(F.lit(99), floor - 1))}[mode]


def first_seen_documents(rows: DataFrame) -> DataFrame:
    """(person_id, doc_ids): the documents of ``points``, each once, in the order in which a subject's timeline first comes to them; null ones are none."""
    ordered = F.array_sort(F.collect_list(F.struct(*ORDER, "doc_id")))
    return rows.groupBy("person_id").agg(F.array_compact(F.array_distinct(F.transform(ordered, lambda x: x["doc_id"]))).alias("doc_ids"))
