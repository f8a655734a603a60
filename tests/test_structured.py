import datetime as dt

import pytest
from pyspark.sql import functions as F

from folioscope.operators import gate, structured, timeline
from folioscope.operators.scope import Scope, ScopedStore
from folioscope.plans.service import InvalidRequest, Request, Service, UnknownPeriod
from folioscope.sources.store import AUDIT, AppendOnlyLog

D = dt.date


@pytest.fixture(scope="module")
def tables(spark):
    ev = [(1, "p", "2019-01-01..2019-12-31", D(2019, 1, 1), D(2019, 12, 31), 90), (2, "p", "2020-01-01..2020-06-30", D(2020, 1, 1), D(2020, 6, 30), None), (3, "p", "2022-01-01..2022-12-31", D(2022, 1, 1), D(2022, 12, 31), 95), (4, "q", "2019-01-01..2019-12-31", D(2019, 1, 1), D(2019, 12, 31), 70)]
    fs = [(1, 1, "51", "90"), (2, 1, "52", "90"), (3, 1, "53", "80"), (4, 1, "54", "ναι"), (5, 1, "141", "99"), (6, 1, "55", "70"), (7, 4, "51", "60")]
    docs = [("d1", "p", ev[0][2]), ("d2", "p", ev[1][2]), ("d3", "p", ev[2][2]), ("d4", "q", ev[3][2])]
    chunks = [("d1:0", "the unit was praised for order", "p", ev[0][2], "d1", 1, "Evaluations"), ("d1:1", "career of promotions", "p", "career", "d1", 2, "Promotions"), ("d4:0", "the unit was praised for order", "q", ev[3][2], "d4", 1, "Evaluations")]
    from folioscope.operators.retrieval import bag_vectors

    made = spark.createDataFrame(chunks, "id string, text string, person_id string, period string, doc_id string, page int, section string")
    return {
        "evaluations": spark.createDataFrame(ev, "id long, person_id string, period string, period_start date, period_end date, score int"),
        "field_scores": spark.createDataFrame(fs, "id long, eval_id long, field_code string, value string"),
        "documents": spark.createDataFrame(docs, "doc_id string, person_id string, period string"),
        "promotions": spark.createDataFrame([(1, "p", 0, "A"), (2, "p", 1, "B"), (3, "p", 1, "C"), (4, "p", 2, "D"), (5, "p", 5, "E")], "id long, person_id string, row_index int, rank string"),
        "service_time": spark.createDataFrame([("p", 1, "x"), ("p", 0, "y")], "person_id string, row_index int, label string"),
        "chunks": made.join(bag_vectors(made, "id"), "id"),
    }


def test_scope_holds_the_person(spark, tables):
    store = ScopedStore(tables)
    scope = Scope("p", "2019-01-01..2019-12-31", doc_id="d1")
    assert [r.id for r in store.table("evaluations", scope).collect()] == [1]
    assert sorted(r.id for r in store.chunks(scope).collect()) == ["d1:0", "d1:1"]
    assert "person_id" in store.chunks(scope)._jdf.queryExecution().optimizedPlan().toString()
    with pytest.raises(ValueError):
        Scope("", "x")


def test_delta_runs_and_stats(tables):
    ev = tables["evaluations"]
    assert {r.id: r.delta for r in timeline.with_delta(ev).collect()} == {1: None, 2: None, 3: 5, 4: None}
    assert {r.id: r.run for r in timeline.with_runs(ev).collect()} == {1: 0, 2: None, 3: 1, 4: 0}
    s = {r.person_id: r for r in timeline.stats(ev).collect()}
    assert (s["p"].periods, s["p"].scored, s["p"].mean, s["p"].low, s["p"].last, s["p"].low_id, s["p"].gaps) == (3, 2, 92.5, 90, 95, 1, 1)


def test_timeline_needs_one_document_each(spark, tables):
    assert timeline.checked(tables["evaluations"], tables["documents"]).count() == 4
    again = tables["documents"].union(spark.createDataFrame([("d9", "p", "career"), ("d8", "p", "career")], "a string, b string, c string"))
    with pytest.raises(timeline.AmbiguousDocuments):
        timeline.checked(tables["evaluations"], again)
    with pytest.raises(timeline.AmbiguousDocuments):
        timeline.checked(tables["evaluations"], tables["documents"].where("doc_id <> 'd3'"))


def test_single_document(spark, tables):
    ev, docs = tables["evaluations"], tables["documents"]
    assert structured.single_document(ev, docs, Scope("p", "2019-01-01..2019-12-31")) == "d1"
    assert structured.single_document(ev, docs, Scope("p", "1990-01-01..1990-12-31")) is None
    two = spark.createDataFrame([("a", "p", "x"), ("b", "p", "x")], "doc_id string, person_id string, period string")
    for d, p in ((two, "x"), (two, "2019-01-01..2019-12-31")):
        with pytest.raises(timeline.AmbiguousDocuments):
            structured.single_document(ev, d, Scope("p", p))


def test_top_bottom_ties_and_words(tables):
    rows = structured.top_bottom(tables["field_scores"].where("eval_id = 1"), n=3).collect()
    assert [r.field_code for r in sorted(rows, key=lambda r: r.place) if r.side == "top"] == ["51", "52", "53"]
    assert [r.field_code for r in sorted(rows, key=lambda r: r.place) if r.side == "bottom"] == ["55", "53", "52"]
    assert structured.overall(tables["field_scores"]).collect()[0].overall == 99


def test_judged_for_by_value(tables):
    got = {r.id: r.judged_for for r in structured.judged_for(tables["promotions"]).collect()}
    assert got == {1: None, 2: "A", 3: "A", 4: "C", 5: None}


def test_gate(spark, tables):
    ev = tables["evaluations"]
    codes = gate.known_codes(tables["field_scores"], ["142α"])
    p = "2019-01-01..2019-12-31"
    qs = [("p", p, "score in 2019"), ("p", p, "score in 2021 or 2020"), ("p", p, "score in 2022"), ("p", "career", "score in 2022"), ("p", p, "code 999 in 1900"), ("p", p, "code 142a"), ("nobody", p, "in 1950"), ("p", p, "no year")]
    df = spark.createDataFrame([(i, *q) for i, q in enumerate(qs)], "n int, person_id string, period string, text string")
    got = {r.n: (r.refusal, r.bad_year, r.candidates) for r in gate.check_questions(df, ev, codes, ["code"]).collect()}
    assert got[0] == (None, None, None) and got[1][:2] == ("out_of_range", 2021) and got[2] == ("other_period", 2022, ["2022-01-01..2022-12-31"])
    assert [got[i][0] for i in (3, 4, 5, 6, 7)] == [None, "unknown_field_code", None, None, None]
    assert sorted(r.year for r in gate.covered_years(ev.where("person_id = 'p'")).collect()) == [2019, 2020, 2022]


def test_service_audits_before_it_answers(spark, tables, tmp_path):
    service = Service(tables, AppendOnlyLog(spark, str(tmp_path / "audit"), AUDIT))
    a = service.run(Request("scores", "p", "2019-01-01..2019-12-31"), "u")
    assert a.doc_ids == ["d1"] and [f.field_code for f in a.rows[0].fields] == ["141", "51", "52", "53", "54", "55"]
    both = service.run(Request("compare", "p", "2019-01-01..2019-12-31", "2022-01-01..2022-12-31"), "u")
    assert both.doc_ids == ["d1", "d3"] and both.rows[0].a.score == 90 and both.rows[0].b.score == 95
    assert [r.delta for r in service.run(Request("timeline", "p"), "u").rows] == [None, None, 5]
    assert [r.rank for r in service.run(Request("promotions", "p"), "u").rows][0] == "A"
    assert [r.label for r in service.run(Request("service_time", "p"), "u").rows] == ["y", "x"]
    assert len(service.run(Request("top_bottom", "p", "2019-01-01..2019-12-31", n=1), "u").rows) == 2
    with pytest.raises(UnknownPeriod):
        service.run(Request("scores", "p", "1990-01-01..1990-12-31"), "u")
    answer = service.ask("was the unit praised in 2019", "p", "2019-01-01..2019-12-31", "u")
    assert answer.doc_ids == ["d1"] and "praised" in answer.rows[0].answer
    assert service.ask("what happened in 1980", "p", "2019-01-01..2019-12-31", "u").refusal == "out_of_range"
    log = service.audit.read()
    assert log.count() == 9 and log.where("refusal_reason is null").count() == 7 and log.select("id").distinct().count() == 9


@pytest.mark.parametrize("bad", [("nothing", "p"), ("scores", "p"), ("scores", "", "x"), ("timeline", "p", "x"), ("compare", "p", "x"), ("top_bottom", "p", "x", None, 0)])
def test_requests_are_checked(bad):
    with pytest.raises(InvalidRequest):
        Request(*bad)


def test_failed_audit_gives_no_rows(spark, tables):
    class Broken(AppendOnlyLog):
        def append(self, rows):
            raise OSError("no space")

    with pytest.raises(OSError):
        Service(tables, Broken(spark, "/nowhere", AUDIT)).run(Request("timeline", "p"), "u")


def test_order_of_rows_changes_nothing(tables):
    ev = tables["evaluations"]
    a, b = (sorted(map(tuple, timeline.with_delta(x).collect()), key=str) for x in (ev, ev.repartition(4, F.rand(1))))
    assert a == b
