import dataclasses

import pytest

from folioscope.operators import extract, structured, timeline
from folioscope.plans.ingest import Form, attach_duties, coverage, ingest

FORM = Form(
    titles=["Person", "Evaluations", "Promotions", "Service"], person_section="Person", person_label="Number", name_label="Name", evaluation_section="Evaluations", evaluation_anchor="From:",
    evaluation_labels={"period_start": "From", "period_end": "To", "kind": "Kind", "characterization": "Rating", "unit": "Unit", "evaluator": "Evaluator", "defects": "Defects"},
    characterizations=["GOOD"], kinds=["REGULAR", "NOTE"], promotion_section="Promotions", promotion_header=["Rank", "Date"], service_section="Service", service_units=["years", "months", "days"],
)
BLOCK = "From: 01/01/{0}\nTo: 31/12/{0}\nRating: {1}\nEvaluator: Col, Ann\nDefects: none\n51 Skill: {2}\n141 Overall: 99\n"


def pages(spark, repeat=1):
    promotions = "Rank\nDate\n" + "".join(f"\nMajor {i}\n01/01/2000\norder of the day\n02/02/2000\n" for i in range(60 * repeat))
    data = [
        ("d", 1, "cover\n1. Person\nNumber: p7\nName: Ann Lee"), ("d", 2, "Evaluations\n" + BLOCK.format(2019, "GOOD (90)", 95)), ("d", 3, BLOCK.format(2020, "GOOD (93)", 96) + BLOCK.format(2021, "ODD (1)", 1)),
        ("d", 4, "Promotions\n" + promotions), ("d", 5, "Service\nTotal\n12\nyears\n13\nmonths\n5\ndays"), ("e", 1, "Person\nName: nobody"),
    ]
    return spark.createDataFrame(data, "doc_id string, page int, text string")


def test_pages_become_tables(spark):
    t = ingest(pages(spark).repartition(4), FORM)
    assert [tuple(r) for r in t["persons"].collect()] == [("p7", "Ann Lee")]
    assert [(r.period, r.score) for r in t["evaluations"].orderBy("period").collect()] == [("2019-01-01..2019-12-31", 90), ("2020-01-01..2020-12-31", 93)]
    assert sorted((r.doc_id, r.reason) for r in t["rejects"].collect()) == [("d", "evaluation: characterization"), ("e", "no person")]
    assert sorted(r.period for r in t["documents"].collect()) == ["2019-01-01..2019-12-31", "2020-01-01..2020-12-31", "career"]
    assert t["promotions"].count() == 60 and t["service_time"].first().months == 13  # the table is longer than a piece
    assert sorted(r.number for r in structured.top_bottom(t["field_scores"], n=1).where("side = 'top'").collect()) == [95, 96]
    assert [r.delta for r in timeline.with_delta(timeline.checked(t["evaluations"].drop("doc_id"), t["documents"])).orderBy("period").collect()] == [None, 3]
    chunks = t["chunks"].collect()
    assert len({c.id for c in chunks}) == len(chunks) and all(c.person_id == "p7" and len(c.embedding) == 256 for c in chunks)
    assert {c.period for c in chunks if c.section == "Evaluations"} == {"2019-01-01..2019-12-31", "2020-01-01..2020-12-31"} and all(c.text.startswith("[section: ") for c in chunks)
    assert tuple(coverage(t).first()) == ("p7", 2, 2, 2019, 2020, True)


def test_a_repeated_load_gives_the_same_ids(spark):
    a, b = (ingest(pages(spark).repartition(n), FORM) for n in (1, 7))
    for name in ("evaluations", "field_scores", "promotions", "chunks"):
        assert sorted(str(r.id) for r in a[name].collect()) == sorted(str(r.id) for r in b[name].collect())


def test_duties_need_their_evaluation(spark):
    e = spark.createDataFrame([("d", "x"), ("d", "y")], "doc_id string, period string")
    duties = spark.createDataFrame([("d", "x", 1, "b", 2), ("d", "x", 0, "a", None)], "doc_id string, period string, seq int, label string, days int")
    got = {r.period: r.duties for r in attach_duties(e, duties).collect()}
    assert [tuple(d) for d in got["x"]] == [("a", None), ("b", 2)] and got["y"] is None
    with pytest.raises(ValueError):
        attach_duties(e.where("period = 'y'"), duties)


PLACED = """
REGULAR
01/01/{0}
-
31/12/{0}
{1}
-
3
Harbour office
deck duties
Rated by: {2}
Remarks of the reviewer: keen
and quick
Reviewer:
CPT (NAV) Kim Roe - head
51
Skill at
sea
{3}
99
Odd code
yes
52
unfinished
"""


def test_blocks_without_labels_go_by_their_lines(spark):
    form = dataclasses.replace(FORM, positional_labels={"evaluator": "Rated by", "reviewer": "Reviewer", "reviewer_notes": "Remarks of the reviewer"}, field_codes=["51", "52", "141"])
    bare = PLACED.format(2019, "GOOD (90)", "LT Ann Lee - chief of staff", 95) + PLACED.format(2020, "ODD (7)", "x", 1) + "NOTE\n01/03/2021\n-\n05/03/2021\nSchool\nRated by:\nMAJ Jo Poe\n" + "NOTE\n01/03\n-\n05/03/2021\nSchool\n"
    data = [("d", 1, "Person\nNumber: p7\nName: Ann Lee"), ("d", 2, "Evaluations\n" + bare), ("e", 1, "Person\nNumber: p8\nName: Bo"), ("e", 2, "Evaluations\n" + BLOCK.format(2019, "GOOD (91)", 94))]
    t = ingest(spark.createDataFrame(data, "doc_id string, page int, text string"), form)
    e = {(r.person_id, r.period): r for r in t["evaluations"].collect()}
    assert set(e) == {("p7", "2019-01-01..2019-12-31"), ("p7", "2021-03-01..2021-03-05"), ("p8", "2019-01-01..2019-12-31")}
    first, note = e["p7", "2019-01-01..2019-12-31"], e["p7", "2021-03-01..2021-03-05"]
    assert (first.kind, first.characterization, first.score, first.unit, first.reviewer_notes) == ("REGULAR", "GOOD", 90, "Harbour office", "keen and quick")
    assert tuple(first.evaluator) == ("LT", "Ann Lee", "chief of staff") and tuple(first.reviewer) == ("CPT (NAV)", "Kim Roe", "head")
    assert (note.kind, note.characterization, note.score, note.unit, tuple(note.evaluator), note.reviewer) == ("NOTE", None, None, "School", ("MAJ", "Jo Poe", None), None)
    assert sorted((r.doc_id, r.reason) for r in t["rejects"].collect()) == [("d", "evaluation: characterization"), ("d", "evaluation: period")]
    scores = {(r.person_id, r.field_code): r.value for r in t["field_scores"].join(t["evaluations"].selectExpr("id AS eval_id", "person_id"), "eval_id").collect()}
    assert scores == {("p7", "51"): "95", ("p8", "51"): "94", ("p8", "141"): "99"}
    assert {c.period for c in t["chunks"].where("section = 'Evaluations' and person_id = 'p7'").collect()} == {"2019-01-01..2019-12-31", "2021-03-01..2021-03-05"}


def test_lookalike_letters_and_a_bare_word(spark):
    text = "R\n01/01/2019\n-\n02/01/2019\nKAΛOΣ\nBase"
    row = extract.positional_evaluations(spark.createDataFrame([("d", 0, text)], "doc_id string, block int, text string"), {"evaluator": "E", "reviewer": "R", "reviewer_notes": "N"}, ["ΚΑΛΟΣ"], ["R", "N"], [], ["yes"]).first()
    assert (row.characterization, row.score, row.unit, row.evaluator, row.reject_reason) == ("ΚΑΛΟΣ", None, "Base", None, None)
