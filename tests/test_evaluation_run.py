import json
import os

from folioscope.plans import evaluation
from folioscope.plans.service import Service, UnknownPeriod
from folioscope.sources.store import AUDIT, AppendOnlyLog
from tests.test_structured import tables  # noqa: F401  the dossiers of two subjects

Y19, Y22 = "2019-01-01..2019-12-31", "2022-01-01..2022-12-31"


def asked(spark, rows):
    full = [{"tier": "A", "person_id": "p", "period": Y19, "text": "was the unit praised in 2019"} | r for r in rows]
    names = evaluation.QUESTIONS.replace(", ", " ").split()[::2]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in full], evaluation.QUESTIONS)


def test_statuses_and_citations(spark, tables):  # noqa: F811
    questions = asked(spark, [
        {"id": "right", "kind": "contains", "values": ["praised", "order"]}, {"id": "wrong", "kind": "contains", "values": ["blamed"]}, {"id": "short", "kind": "set", "values": ["or"]},
        {"id": "forbidden", "forbidden": ["prai.ed"]}, {"id": "gap", "kind": "contains", "values": ["blamed"], "known_gap": True}, {"id": "people", "tier": "C"}, {"id": "free"},
        {"id": "refused", "text": "what happened in 1980", "must_refuse": "out_of_range"}, {"id": "not refused", "must_refuse": "out_of_range"}, {"id": "no such period", "period": "1990-01-01..1990-12-31"},
        {"id": "nothing", "person_id": "q", "period": "career", "text": "anything", "must_refuse": "nothing_found"},
    ])
    run = evaluation.run_questions(questions, tables)
    assert {r.id: r.status for r in run.results.collect()} == {
        "right": "pass", "wrong": "fail", "short": "weak", "forbidden": "fail", "gap": "known_gap", "people": "needs_human", "free": "pass", "refused": "pass", "not refused": "fail", "no such period": "fail", "nothing": "pass",
    }
    assert {r.id: r.refusal for r in run.results.where("refusal is not null").collect()} == {"refused": "out_of_range", "no such period": "unknown_period", "nothing": "nothing_found"}
    cited = [(r.rank, r.doc_id) for r in run.citations.where("id = 'right'").orderBy("rank").collect()]
    assert cited[0] == (1, "d1") and not run.citations.where("doc_id = 'd4'").count()


def test_a_thousand_questions_equal_one_at_a_time(spark, tables, tmp_path):  # noqa: F811
    texts = ["was the unit praised in 2019", "what of promotions", "what happened in 1980", "see code 77", "order of the unit 2022", "zzz"]
    rows = [{"id": f"q{i:04d}", "text": texts[i % 6], "period": (Y19, Y22, "career", "1990-01-01..1990-12-31")[i // 6 % 4], "person_id": "pq"[i // 24 % 2]} for i in range(1000)]
    run = evaluation.run_questions(asked(spark, rows).repartition(7), tables)
    got = {r.id: (r.refusal, r.answer, r.doc_ids) for r in run.answers.collect()}
    assert len(got) == 1000
    service = Service(tables, AppendOnlyLog(spark, str(tmp_path / "audit"), AUDIT))
    kinds = {(r["text"], r["period"], r["person_id"]): [] for r in rows}
    for r in rows:
        kinds[r["text"], r["period"], r["person_id"]].append(got[r["id"]])
    assert all(len({str(x) for x in same}) == 1 for same in kinds.values())
    for (text, period, person), same in list(kinds.items())[::24]:
        try:
            one = service.ask(text, person, period, "u")
            want = (one.refusal, one.rows[0].answer if one.rows else None, one.doc_ids)
        except UnknownPeriod:
            want = ("unknown_period", None, [])
        assert same[0] == want, (text, period, person)


def test_reports(spark, tables, tmp_path):  # noqa: F811
    run = evaluation.run_questions(asked(spark, [{"id": "a"}, {"id": "b", "kind": "contains", "values": ["blamed"]}, {"id": "c", "tier": "C"}]), tables, model=lambda prompt: prompt.upper())
    folder = str(tmp_path / "reports")
    evaluation.write_reports(run, folder)
    lines = [json.loads(x) for f in sorted(os.listdir(f"{folder}/results")) if f.startswith("part") for x in open(f"{folder}/results/{f}")]
    assert sorted((x["id"], x["status"]) for x in lines) == [("a", "pass"), ("b", "fail"), ("c", "needs_human")] and "PRAISED" in lines[0]["answer"]
    md = [x for f in os.listdir(f"{folder}/summary") if f.startswith("part") for x in open(f"{folder}/summary/{f}").read().splitlines()]
    assert md[0].startswith("| tier | pass | fail") and md[2] == "| A | 1 | 1 | 0 | 0 | 0 | 0 | 2 |" and len(md) == 4
    csv = open(f"{folder}/citations.csv", "rb").read()
    assert csv.startswith(b"\xef\xbb\xbfid;rank;doc_id;page;section;score;rerank_score\r\na;1;d1;")
