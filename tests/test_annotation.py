import random

import pytest
from pyspark.sql import functions as F

from folioscope.functions import text
from folioscope.operators import evals, extract, promotions
from folioscope.plans import carriers
from folioscope.sources import documents

HEADER = ("RANK", "DECIDED", "DECISION", "PROMOTED")


def plain(text):
    """The rewriting once more, line by line."""
    lines = text.split("\n")
    at = next((i for i in range(len(lines) - 3) if tuple(x.strip() for x in lines[i : i + 4]) == HEADER), None)
    if at is None:
        return text
    out, run = lines[: at + 4], []
    for line in [*lines[at + 4 :], None]:
        if line is not None and line.strip():
            run.append(line)
            continue
        if len(run) >= 4 and not any(x.strip().startswith("RANK: ") for x in run):
            said = run[2].strip()
            for x in run[3:-1]:
                said += ("" if said.endswith("-") else " ") + x.strip()
            run = [f"RANK: {run[0].strip()} | DECIDED: {run[1].strip()} | DECISION: {said if len(run) > 3 else ''} | PROMOTED: {run[-1].strip()}"]
        out += run + ([] if line is None else [line])
        run = []
    return "\n".join(out)


def texts():
    rng = random.Random(7)
    for _ in range(150):
        body = [rng.choice(["", " ", "a-", "b", " c ", "01/02/2003", "RANK: x | y", "RANK", "-"]) for _ in range(rng.randint(0, 25))]
        head = rng.choice([[], ["intro", *HEADER], [" RANK ", "DECIDED", "DECISION\t", "PROMOTED"], ["RANK", "DECIDED", "RANK", "DECIDED", "DECISION", "PROMOTED"], list(HEADER[:3])])
        yield "\n".join(head + body)


def test_rows_are_rewritten_in_place_and_only_once(spark):
    rows = [(i, t) for i, t in enumerate(texts())] + [(900, None), (901, "")]
    df = spark.createDataFrame(rows, "doc_id int, text string").repartition(3)
    once = df.withColumn("text", promotions.annotated(F.col("text"), HEADER))
    assert {r.doc_id: r.text for r in once.collect()} == {i: t if t is None else plain(t) for i, t in rows}
    twice = once.withColumn("again", promotions.annotated(F.col("text"), HEADER))
    assert twice.where("not (text <=> again)").count() == 0


def test_groups_are_rows_or_visible_rejects(spark):
    text = "\n".join(["x", *HEADER, "", "A", "1/1", "said-", "so", "2/2", "", "short", "one", " ", "RANK: done | DECIDED: y", "", "B", "3/3", "z", "4/4"])
    got = promotions.promotion_groups(spark.createDataFrame([(1, text), (2, "no header\n\na\nb\nc\nd"), (3, None)], "doc_id int, text string"), HEADER).orderBy("place").collect()
    assert [(r.doc_id, r.place, r.kind, r.rank, r.decision, r.promotion_date) for r in got] == [(1, 0, "row", "A", "said-so", "2/2"), (1, 1, "short", None, None, None), (1, 2, "labelled", None, None, None), (1, 3, "row", "B", "z", "4/4")]
    assert got[1].lines == ["short", "one"]


def marked(spark, said, *args, **more):
    return spark.createDataFrame([(said,)], "t string").select(extract.empty_zones(F.col("t"), *args, **more)).first()[0]


LABELS = ["a. One", "b. All", "(1) first", "(2) in-side", "(3) last", "c. End"]


@pytest.mark.parametrize(("said", "want"), [
    ("a. One\n\nb. All\n(1) first\n\n(2) in - side\n(3) last\n\nc. End", "a. One: -\n\nb. All: -\n(1) first: -\n\n(2) in - side: -\n(3) last: -\n\nc. End"),
    ("a. One\nx\nb. All\n(1) first\n(2) in-side\nsome\n(3) last", "a. One\nx\nb. All\n(1) first: -\n(2) in-side\nsome\n(3) last: -"),
    # Its own text, or a child that is missing, keeps a container.
    ("b. All\nown\n(1) first\n(2) in-side\n(3) last", "b. All\nown\n(1) first: -\n(2) in-side: -\n(3) last: -"),
    ("b. All\n(1) first\n(3) last", "b. All\n(1) first: -\n(3) last: -"),
    ("see a. One\nno label", "see a. One\nno label"), ("", ""), (None, None), ("😀 text\n  a.   One \n", "😀 text\n  a.   One: - \n"),
])
def test_empty_zones(spark, said, want):
    args = (LABELS, {"b. All": LABELS[2:5]}, ["c. End"])
    got = marked(spark, said, *args, mark="-")
    assert got == want and marked(spark, got, *args, mark="-") == want


def test_containers_in_containers(spark):
    tree = {"A": ["B", "E"], "B": ["C", "D"]}
    assert marked(spark, "A\nB\nC\nD\nE", list("ABCDE"), tree) == "\n".join(f"{x}: (empty)" for x in "ABCDE")
    assert marked(spark, "A\nB\nC\nD\nhere\nE", list("ABCDE"), tree) == "A\nB\nC: (empty)\nD\nhere\nE: (empty)"
    with pytest.raises(ValueError, match="child of its own"):
        marked(spark, "A", ["A", "B"], {"A": ["B"], "B": ["A"]})
    with pytest.raises(ValueError, match="no such"):
        marked(spark, "A", ["A"], {"A": ["B"]})


def test_labelled_scores_keep_raw_values_and_reject_visibly(spark):
    text = "FIELD: 12 | DESCRIPTION: a b | SCORE: 90\nFIELD: 13γ|DESCRIPTION:|SCORE: excellent work \n FIELD: 9 | DESCRIPTION:  | SCORE: yes\nFIELD: 4 | SCORE: 5\nFIELD: 5 | DESCRIPTION: x | SCORE:\nnot FIELD: 6 | DESCRIPTION: x | SCORE: 1"
    labels = ("FIELD", "DESCRIPTION", "SCORE")
    row = spark.createDataFrame([(text,)], "t string").select(extract.labelled_scores(F.col("t"), labels, ["yes"], {"9": "known"}).alias("s"), extract.rejected_scores(F.col("t"), labels).alias("r")).first()
    assert [tuple(x) for x in row.s] == [("12", "a b", "90"), ("13γ", None, "excellent work"), ("9", "known", "yes")]
    assert row.r == ["FIELD: 4 | SCORE: 5", "FIELD: 5 | DESCRIPTION: x | SCORE:"]
    plain_lines = spark.createDataFrame([("13 c: excellent\n14 d e: 7 of 9\n15: yes",)], "t string").select(extract.field_scores(F.col("t"), ["yes"]).alias("s")).first()
    assert [tuple(x) for x in plain_lines.s] == [("13", "c", "excellent"), ("14", "d e", "7"), ("15", None, "yes")]
    none = spark.createDataFrame([(None,)], "t string").select(extract.labelled_scores(F.col("t"), labels, ["yes"]).alias("s"), extract.rejected_scores(F.col("t"), labels).alias("r")).first()
    assert none.s == [] and none.r == []


def test_evaluations_read_labelled_scores(spark):
    text = "From: 01/01/2020\nTo: 31/12/2020\nKind: REGULAR\nRating: GOOD (93)\nFIELD: 7 | DESCRIPTION: sense | SCORE: 88\n51 Skill: 95\n"
    labels = {"period_start": "From", "period_end": "To", "kind": "Kind", "characterization": "Rating", "unit": "Unit", "evaluator": "Evaluator", "defects": "Defects", "field": "FIELD", "field_description": "DESCRIPTION", "field_score": "SCORE"}
    got = extract.evaluations(spark.createDataFrame([("d", 0, text)], "doc_id string, block int, text string"), labels, ["GOOD"], ["REGULAR", "NOTE"], ["yes"], "none").first()
    assert got.reject_reason is None and [tuple(x) for x in got.field_scores] == [("7", "sense", "88"), ("51", "Skill", "95")]


def test_broken_lines_are_problem_rows(spark, tmp_path):
    lines = ['{"id": "a", "tier": "C", "text": "x", "forbidden_patterns": ["("], "notes": ""}', "", '{"id": "b", "tier": "A", "te', "  ", "not json", '{"id": "c", "tier": "A", "text": "y", "forbidden_patterns": "no list"}', '{"id": "d", "tier": "A"}']
    (tmp_path / "questions.jsonl").write_text("\n".join(lines))
    schema = "id string, tier string, text string, forbidden_patterns array<string>, notes string"
    good, bad = documents.json_lines_or_problems(spark, str(tmp_path / "questions.jsonl"), schema)
    assert sorted(r.id for r in good.collect()) == ["a", "d"] and good.columns == ["id", "tier", "text", "forbidden_patterns", "notes"]
    assert {(r.id, r.line) for r in bad.collect()} == {("b", lines[2]), (None, "not json"), ("c", lines[5])}
    problems = sorted(map(tuple, evals.question_problems(good, bad).collect()), key=str)
    assert problems == sorted([("a", "bad pattern"), ("a", "no notes"), ("b", "bad json"), (None, "bad json"), ("c", "bad json")], key=str)


def test_persons_are_found_in_the_jvm(spark):
    rows = [("Ελένη\u00a0 Παπαδοπούλου", "p1"), ("José ÅNGSTRÖM", "p2"), ("Μάριος", "p3"), (None, "p4"), ("a%b_c", "p5")]
    df = spark.createDataFrame(rows, "name string, id string")
    found = lambda q: [r.id for r in df.where(text.matches_person(F.col("name"), F.col("id"), q)).orderBy("id").collect()]
    assert found("ΕΛΕΝΗ παπα") == ["p1"] and found("ÅNGSTROM P2") == ["p2"] and found("mάρ") == ["p3"] and found("μαριοσ") == ["p3"]
    assert found(" ") == ["p1", "p2", "p3", "p4", "p5"] and found("P4") == ["p4"] and found("%") == ["p5"] and found("zz") == []
    plan = df.where(text.matches_person(F.col("name"), F.col("id"), "q"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_groups_of_any_length_and_any_characters(spark):
    """A group is a run of the text rather than a fold of lines, so neither its length nor a separator among its characters breaks it."""
    header = ["RANK", "DATE OF DECISION", "DECISION", "DATE OF PROMOTION"]
    long = "A\n01/01/2000\n" + "x y\n" * 30_000 + "02/02/2001"
    text = "above\n \t" + "\n".join(header) + " \n\n" + long + "\n\t \nB\x1eC\n03/03/2002\nby-\nright\n-\n"
    df = spark.createDataFrame([(1, text), (2, "\n".join(header)), (3, "RANK\n" + "\n".join(header) + "\nB\nC"), (4, " ".join(header))], "doc_id long, text string")
    got = {(r.doc_id, r.place): (r.kind, r.rank, r.decision, r.promotion_date, len(r.lines)) for r in promotions.promotion_groups(df, header).collect()}
    want = " ".join(["x y"] * 30_000)
    assert got == {(1, 0): ("row", "A", want, "02/02/2001", 30_003), (1, 1): ("row", "B\x1eC", "by-right", "-", 5), (3, 0): ("short", None, None, None, 2)}
    marked = {r.doc_id: r.t for r in df.select("doc_id", promotions.annotated(F.col("text"), header).alias("t")).collect()}
    assert marked[1].endswith("\n\t \nRANK: B\x1eC | DATE OF DECISION: 03/03/2002 | DECISION: by-right | DATE OF PROMOTION: -\n") and marked[1].count("\n") == 9
    assert {i: marked[i] for i in (2, 3, 4)} == {r.doc_id: r.text for r in df.where("doc_id > 1").collect()}


def test_small_files_are_dealt_over_all_cores(spark):
    rows = carriers.spread(spark.range(1000).coalesce(1), "id")
    assert rows.rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism and rows.count() == 1000
