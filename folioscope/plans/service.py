"""A request's way: check it, bind its scope, run it, write the audit row, and only then hand out rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from folioscope.functions.text import stems
from folioscope.operators import gate, retrieval, structured, timeline
from folioscope.operators.scope import CAREER, Scope
from folioscope.sources.store import AppendOnlyLog

#: Operations and what each needs beside the person.
NEEDS = {"scores": {"period"}, "compare": {"period", "other_period"}, "top_bottom": {"period"}, "promotions": set(), "service_time": set(), "timeline": set()}
OPTIONAL = {"top_bottom": {"n"}}


class InvalidRequest(ValueError):
    """A request with missing or superfluous parameters."""


class UnknownPeriod(ValueError):
    """A scope that no document exists for."""


@dataclass(frozen=True)
class Request:
    operation: str
    person_id: str
    period: str | None = None
    other_period: str | None = None
    n: int | None = None

    def __post_init__(self):
        if self.operation not in NEEDS:
            raise InvalidRequest(f"no such operation: {self.operation}")
        given = {k for k in ("period", "other_period", "n") if getattr(self, k) is not None}
        if not self.person_id or not NEEDS[self.operation] <= given or given - NEEDS[self.operation] - OPTIONAL.get(self.operation, set()):
            raise InvalidRequest(f"{self.operation} takes {sorted(NEEDS[self.operation])}")
        if self.n is not None and self.n < 1:
            raise InvalidRequest("n is 1 at least")


@dataclass
class Answer:
    rows: list[Row]
    doc_ids: list[str] = field(default_factory=list)
    refusal: str | None = None


class Service:
    """Operations on tables of dossiers. A failed audit write fails the request: no rows leave without one."""

    def __init__(self, tables: dict[str, DataFrame], audit: AppendOnlyLog, embed: Callable[[str], Sequence[float]] | None = None, model: Callable[[str], str] | None = None, codes: Sequence[str] = (), prefixes: Sequence[str] = ("code",)):
        self.tables, self.audit, self.embed, self.model, self.codes, self.prefixes = tables, audit, embed, model, codes, prefixes

    def plan(self, r: Request) -> DataFrame:
        """The request's DataFrame; the person is part of every read."""
        scope = Scope(r.person_id, r.period or CAREER)
        mine = lambda name: self.tables[name].where(F.col("person_id") == r.person_id)
        if r.operation in ("scores", "compare", "top_bottom"):
            for p in filter(None, (r.period, r.other_period)):
                if not Scope(r.person_id, p).rows(self.tables["documents"]).limit(1).count():
                    raise UnknownPeriod(p)
                structured.single_document(self.tables["evaluations"], self.tables["documents"], Scope(r.person_id, p))
        if r.operation == "timeline":
            return timeline.with_delta(timeline.checked(mine("evaluations"), mine("documents"))).orderBy(*timeline.ORDER)
        if r.operation in ("promotions", "service_time"):
            rows = mine(r.operation)
            return (structured.judged_for(rows) if r.operation == "promotions" else rows).orderBy("row_index")
        if r.operation == "compare":
            both = timeline.points(mine("evaluations").where(F.col("period").isin(r.period, r.other_period)), mine("documents"))
            return structured.compare_periods(structured.score_records(both, self.tables["field_scores"]), r.period, r.other_period)
        own = timeline.points(scope.rows(self.tables["evaluations"]), scope.rows(self.tables["documents"]))
        if r.operation == "scores":
            return structured.score_records(own, self.tables["field_scores"])
        scores = self.tables["field_scores"].join(own.select(F.col("id").alias("eval_id"), "doc_id"), "eval_id")
        best = structured.top_bottom(scores, n=r.n or 3).join(scores.select("eval_id", "doc_id").distinct(), "eval_id")
        return best.orderBy("side", "place")

    def run(self, r: Request, user: str) -> Answer:
        try:
            rows = self.plan(r).collect()
        except Exception as e:
            self._log(r, user, [], type(e).__name__)
            raise
        ids = sorted({i for row in rows for i in ([row["doc_id"]] if "doc_id" in row else row["doc_ids"] if "doc_ids" in row else []) if i})
        self._log(r, user, ids, None)
        return Answer(rows, ids)

    def ask(self, question: str, person_id: str, period: str, user: str, canonical: dict[str, str] | None = None) -> Answer:
        """A question in free words: refused, or answered from the scope's chunks with the documents that it rests on."""
        r, spark, scope = Request("scores", person_id, period), self.audit.spark, Scope(person_id, period)
        if period != CAREER and not scope.rows(self.tables["documents"]).limit(1).count():
            self._log(r, user, [], "UnknownPeriod", question)
            raise UnknownPeriod(period)
        asked = spark.createDataFrame([(person_id, period, question)], "person_id string, period string, text string")
        mine = self.tables["evaluations"].where(F.col("person_id") == person_id)
        refusal = gate.check_questions(asked, mine, gate.known_codes(self.tables["field_scores"], self.codes), self.prefixes).first()["refusal"]
        if refusal:
            self._log(r, user, [], refusal, question)
            return Answer([], [], refusal)
        vector = self.embed(question) if self.embed else spark.range(1).select(retrieval.bag_of_stems(stems(F.lit(question)))).first()[0]
        found = retrieval.search(self.tables["chunks"], scope, vector)
        found = found.withColumn("question_id", F.lit(1)).withColumn("retrieval_rank", F.expr("row_number() over (order by score desc, id)"))  # at most RETRIEVED rows
        best = retrieval.rerank(found, retrieval.overlap(stems(F.col("text")), stems(F.lit(question))))
        prompt = retrieval.prompts(best).first()
        if prompt is None:
            self._log(r, user, [], "nothing_found", question)
            return Answer([], [], "nothing_found")
        text = self.model(prompt["context"]) if self.model else prompt["context"]
        odd = None
        if canonical:
            odd = spark.range(1).select(retrieval.unsupported_ranks(F.lit(text), F.lit(prompt["context"]), canonical)).first()[0]
        self._log(r, user, prompt["doc_ids"], None, question, text, odd)
        return Answer([Row(answer=text, context=prompt["context"])], prompt["doc_ids"])

    def _log(self, r: Request, user: str, ids: list[str], refusal: str | None, query: str | None = None, answer: str | None = None, odd: list[str] | None = None) -> None:
        row = (user, query or r.operation, ids, "semantic" if query else "structured", refusal, r.person_id, r.period, r.other_period, answer, odd)
        schema = "user string, query string, retrieved_doc_ids array<string>, mode string, refusal_reason string, person_id string, period string, other_period string, answer_text string, unsupported_ranks array<string>"
        self.audit.append(self.audit.spark.createDataFrame([row], schema))
