"""A run of many questions at once: a table of questions in; answers, verdicts and citations out, in one plan, and the reports of the run."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions.text import stems
from folioscope.operators import evals, gate, retrieval
from folioscope.operators.scope import CAREER
from folioscope.sources.csv_file import write_csv

#: What a question must have; text is asked within (person_id, period), the rest is about the answer.
QUESTIONS = "id string, tier string, person_id string, period string, text string, kind string, value string, values array<string>, forbidden array<string>, must_refuse string, known_gap boolean"


@dataclass
class Run:
    """answers (id, refusal, answer, context, doc_ids), results (id, tier, status, refusal) and citations (id, rank, doc_id, page, section, score, rerank_score)."""

    answers: DataFrame
    results: DataFrame
    citations: DataFrame


def refusals(questions: DataFrame, tables: Mapping[str, DataFrame], codes: Sequence[str], prefixes: Sequence[str]) -> DataFrame:
    """questions with refusal: unknown_period, then the gate's reason, or null."""
    held = tables["documents"].select("person_id", "period").distinct().withColumn("held", F.lit(True))
    asked = gate.check_questions(questions, tables["evaluations"], gate.known_codes(tables["field_scores"], codes), prefixes).select(*questions.columns, F.col("refusal").alias("gated"))
    out = asked.join(held, ["person_id", "period"], "left")
    return out.withColumn("refusal", F.when((F.col("period") != CAREER) & F.col("held").isNull(), "unknown_period").otherwise(F.col("gated"))).drop("held", "gated")


def verdict(answer: Column, refusal: Column) -> Column:
    """The status of a question (see ``evals.status``) from its answer and what it asks of it.

    A question that must be refused passes by that refusal alone. Any other fails if it was refused, if the answer lacks what it must
    have, or if it has what is forbidden; without ``kind`` there is nothing that it must have.
    """
    wanted = F.coalesce(evals.compared(F.col("kind"), F.col("value"), F.col("values"), answer), F.col("kind").isNull())
    bad = F.exists(F.coalesce("forbidden", F.array().cast("array<string>")), lambda p: F.coalesce(F.rlike(answer, p), F.lit(False)))
    ok = F.when(F.col("must_refuse").isNotNull(), refusal.eqNullSafe(F.col("must_refuse"))).otherwise(refusal.isNull() & wanted & ~bad)
    said = F.when(F.col("must_refuse").isNull() & F.col("kind").isin("set", "contains"), F.array_min(F.transform("values", lambda v: F.length(v))))
    return evals.status(F.col("tier"), F.coalesce(ok, F.lit(False)), F.coalesce("known_gap", F.lit(False)), answer.isNull() & refusal.isNull(), F.coalesce(said, F.lit(3)))


def run_questions(questions: DataFrame, tables: Mapping[str, DataFrame], codes: Sequence[str] = (), prefixes: Sequence[str] = ("code",), model: Callable[[str], str] | None = None) -> Run:
    """Asks all ``questions`` (see QUESTIONS) as ``Service.ask`` does one, without its audit rows, and judges the answers.

    Refused questions meet no chunk. The others' chunks are searched by scope, ranked again by shared stems, and put into prompts by joins and windows per question, so
    a thousand questions are one plan; the model, if there is one, is called once for each prompt in the tasks, and without one the prompt is the answer.
    """
    asked = refusals(questions, tables, codes, prefixes)
    open_ = asked.where("refusal is null").select(F.col("id").alias("question_id"), "person_id", "period", stems(F.col("text")).alias("asked"))
    vectors = open_.select("question_id", "person_id", "period", retrieval.bag_of_stems(F.col("asked")).alias("question_embedding"))
    # A subject without chunks has no row here, and so no prompt below.
    found = retrieval.search_many(tables["chunks"], vectors).join(open_.select("question_id", "asked"), "question_id")
    best = retrieval.rerank(found, retrieval.overlap(stems(F.col("text")), F.col("asked")))
    prompts = retrieval.prompts(best)
    said = retrieval.answer(prompts, model) if model else prompts.withColumn("answer", F.col("context"))
    said = said.select(F.col("question_id").alias("id"), "context", "doc_ids", "answer")
    whole = asked.join(said, "id", "left").withColumn("refusal", F.coalesce("refusal", F.when(F.col("context").isNull(), "nothing_found")))
    citations = best.select(F.col("question_id").alias("id"), F.col("rerank_rank").alias("rank"), "doc_id", "page", "section", "score", "rerank_score")
    return Run(
        whole.select("id", "refusal", "answer", "context", F.coalesce("doc_ids", F.array().cast("array<string>")).alias("doc_ids")),
        whole.select("id", "tier", verdict(F.col("answer"), F.col("refusal")).alias("status"), "refusal"),
        citations,
    )


def summary(results: DataFrame) -> list[str]:
    """The table of tiers by status as lines of Markdown; one line for each tier reaches the driver."""
    names = [*evals.STATUSES, "total"]
    lines = [f"| tier | {' | '.join(names)} |", f"| --- |{' ---: |' * len(names)}"]
    return lines + [f"| {r['tier']} | {' | '.join(str(r[n]) for n in names)} |" for r in evals.status_table(results).collect()]


def write_reports(run: Run, folder: str) -> None:
    """results (JSON lines with the answers), citations.csv (in the order of questions and ranks) and summary (Markdown) in a new folder."""
    run.results.join(run.answers.drop("refusal"), "id").write.mode("errorifexists").json(f"{folder}/results")
    spark = run.results.sparkSession
    spark.createDataFrame([(i, x) for i, x in enumerate(summary(run.results))], "i int, value string").coalesce(1).sortWithinPartitions("i").select("value").write.mode("errorifexists").text(f"{folder}/summary")
    write_csv(run.citations, f"{folder}/citations.csv", ["id", "rank"])
