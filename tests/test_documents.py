import math
import random

import pytest
from pyspark.sql import functions as F

from folioscope.operators import evals, extract, layout, retrieval, sections, splitter
from folioscope.sources import documents as src


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_sections_carry_forward(spark):
    pages = [("d", 1, "lost text\n1. Personal Details\nname x\nmore"), ("d", 2, "still personal\nEvaluations\nscore 1"), ("d", 3, "score 2"), ("e", 1, "no heading here\n\nsecond part"), ("e", 2, "third")]
    got = sections.section_chunks(spark.createDataFrame(pages, "doc_id string, page int, text string").repartition(3), ["Personal Details", "Evaluations"])
    assert rows(got, "doc_id", "seq", "page", "section", "text", "fallback") == sorted([
        ("d", 0, 1, "Personal Details", "name x\nmore", False), ("d", 1, 2, "Personal Details", "still personal", False), ("d", 2, 2, "Evaluations", "score 1", False), ("d", 3, 3, "Evaluations", "score 2", False),
        ("e", 0, 1, None, "no heading here", True), ("e", 1, 1, None, "second part", True), ("e", 2, 2, None, "third", True),
    ], key=str)
    assert rows(sections.sections_joined(got.where("doc_id = 'd'")), "section", "text") == [("Evaluations", "score 1\nscore 2"), ("Personal Details", "name x\nmore\nstill personal")]


def test_subsections_restart_with_each_stretch(spark):
    data = [(0, "S", "A\nx"), (1, "S", "y"), (2, "S", "z\nB\nw"), (3, "S", "v"), (4, "T", "t"), (5, "S", "back")]
    df = spark.createDataFrame([("d", *r) for r in data], "doc_id string, seq int, section string, text string")
    headers = F.filter(F.split("text", "\n"), lambda line: line.isin("A", "B"))
    got = sections.carry_subsections(df, headers)
    assert [r.subsection for r in got.orderBy("seq").collect()] == ["A", "A", "A", "B", None, None]
    marked = {r.seq: r.text for r in sections.with_markers(got).collect()}
    assert marked[0] == "[section: S]\nA\nx" and marked[1] == "[section: S]\n[continued: A]\ny" and marked[4] == "[section: T]\nt"
    again = {r.seq: r.text for r in sections.with_markers(got.drop("text").join(spark.createDataFrame(list(marked.items()), "seq int, text string"), "seq")).collect()}
    assert again[4] == marked[4]


def test_long_texts_are_cut_at_words(spark):
    rng = random.Random(4)
    long = " ".join("w" * rng.randint(1, 12) for _ in range(900))
    df = spark.createDataFrame([("a", "short"), ("b", long), ("c", "x" * 4000), ("d", None)], "doc_id string, text string")
    got = {}
    for r in splitter.split_long(df).orderBy("doc_id", "piece").collect():
        got.setdefault(r.doc_id, []).append(r.text)
    assert got["a"] == ["short"] and "d" not in got and all(len(x) <= 1000 for x in got["b"] + got["c"])
    assert all(set(p.split()) <= set(long.split()) for p in got["b"]) and len("".join(got["c"])) >= 4000
    assert all(b.split(" ")[0] in a for a, b in zip(got["b"], got["b"][1:], strict=False))


def test_page_of_offset(spark):
    pages = spark.createDataFrame([("d", 1, "abc"), ("d", 2, ""), ("d", 3, "xy")], "doc_id string, page int, text string")
    offsets = spark.createDataFrame([("d", i) for i in (-5, 0, 3, 4, 5, 6, 99)], "doc_id string, offset int")
    assert {r.offset: r.page for r in sections.page_of_offset(offsets, pages).collect()} == {-5: 1, 0: 1, 3: 1, 4: 2, 5: 3, 6: 3, 99: 3}


def test_groups_and_blocks(spark):
    df = spark.createDataFrame([("d", i, t) for i, t in enumerate(["", "a", "b", " ", "", "c", "ANCHOR", "e"])], "doc_id string, line int, text string")
    assert rows(sections.line_groups(df), "line", "group") == [(1, 0), (2, 0), (5, 1), (6, 1), (7, 1)]
    assert rows(sections.blocks(df, F.col("text") == "ANCHOR"), "line", "block") == [(6, 0), (7, 0)]


def brute_rows(words, tolerance):
    out, top, row = [], None, -1
    for w in sorted(words):
        if top is None or w[0] - top > tolerance:
            top, row = w[0], row + 1
        out.append((row, *w))
    return out


def test_rows_by_the_first_word(spark):
    rng = random.Random(8)
    words = [(round(rng.uniform(0, 60), 1), round(rng.uniform(0, 400), 1), 0.0, 0.0, f"t{i}") for i in range(80)]
    df = spark.createDataFrame([("d", 1, x, y, a, b, t) for y, x, a, b, t in words], "doc_id string, page int, x0 double, y0 double, x1 double, y1 double, text string")
    assert rows(layout.clustered_rows(df), "row", "y0", "x0", "x1", "y1", "text") == sorted(brute_rows(words, 3.0), key=str)


def test_cells_and_durations(spark):
    words = [(10.0, 100.0, "Staff"), (40.0, 101.0, "duty"), (210.0, 102.5, "2"), (260.0, 100.0, "x"), (270.0, 100.0, "11"), (320.0, 100.0, "30"), (330.0, 900.0, "9"), (10.0, 120.0, "No"), (10.0, 119.0, "numbers")]
    df = spark.createDataFrame([("d", 1, x, y, x + 5, y + 5, t) for x, y, t in words], "doc_id string, page int, x0 double, y0 double, x1 double, y1 double, text string")
    cells = layout.cells(layout.clustered_rows(df), {"label": (0.0, 200.0), "y": (200.0, 250.0), "m": (250.0, 300.0), "d": (300.0, 400.0)})
    assert rows(layout.duration_rows(cells, "label", "y", "m", "d"), "label", "years", "months", "days") == [("Staff duty", 2, 11, 30)]


def test_nearest_number_and_bounds(spark):
    schema = "doc_id string, page int, x0 double, y0 double, x1 double, y1 double, text string"
    words = spark.createDataFrame([("d", 1, 100.0, 47.0, 110.0, 52.0, "7"), ("d", 1, 101.0, 47.5, 111.0, 52.0, "8"), ("d", 1, 300.0, 47.6, 310.0, 52.0, "9"), ("d", 1, 120.0, 50.0, 140.0, 55.0, "rest"), ("d", 1, 150.0, 52.0, 160.0, 55.0, "too")], schema)
    labels = spark.createDataFrame([("d", 1, 1, 100.0, 110.0, 50.0), ("d", 1, 2, 500.0, 510.0, 50.0)], "doc_id string, page int, label_id int, x0 double, x1 double, y0 double")
    assert rows(layout.nearest_number(labels, words), "label_id", "number") == [(1, 8), (2, None)]
    assert rows(layout.continued(labels.withColumnRenamed("label_id", "anchor_id"), words), "anchor_id", "rest") == [(1, "rest too 9"), (2, None)]
    ys = lambda v: spark.createDataFrame([("d", 1, float(y)) for y in v], "doc_id string, page int, y double")
    assert rows(layout.block_bounds(ys([10, 50, 90]), ys([60, 70, 5])), "y", "top", "bottom") == [(10.0, 7.0, 50.0), (50.0, 47.0, 60.0), (90.0, 87.0, math.inf)]
    # An anchor without a place comes last, as in the SQL, and bounds no block.
    open_ends = ys([10, 50]).union(ys([1]).withColumn("y", F.lit(None).cast("double")))
    assert {(r.y, r.top, r.bottom) for r in layout.block_bounds(open_ends, ys([5])).collect()} == {(10.0, 7.0, 50.0), (50.0, 47.0, math.inf), (None, None, math.inf)}
    wrapped = layout.wrapped(ys([10, 19, 28.5, 60]).withColumn("text", F.lit("t")))
    assert rows(wrapped, "y", "group") == [(10.0, 0), (19.0, 0), (28.5, 0), (60.0, 1)]


def test_records_and_rejects(spark):
    text = "Rank: A | Date: 29/02/2020\nRank: B\nDate: 31/02/2020\nDays: 12"
    df = spark.createDataFrame([("d", text)], "doc_id string, text string")
    got = extract.records(extract.pipe_records(df, "Rank"), {"rank": "Rank", "date": "Date", "days": "Days"}, dates=["date"], numbers=["days"])
    assert [(r.rank, str(r.date), r.days, r.rejected) for r in got.orderBy("row").collect()] == [("A", "2020-02-29", None, []), ("B", "None", 12, ["date"])]
    health = extract.block_values(spark.createDataFrame([("Opinion\n: 7/2020\nLeave: 10\nNote: a\nb\n\nrest",)], "text string"), ["Opinion", "Leave", "Note", "Other"]).first()
    assert (health.Opinion, health.Leave, health.Note, health.Other) == ("7/2020", "10", "a b", None)


def test_records_over_several_lines(spark):
    text = "before: x\nRank / Arm : A | Note: one: two\n and three | Rank / Arm: B\nRank/Arm: C\n9: no key\nNote: first\nNote:  last \nplain"
    rows = extract.pipe_records(spark.createDataFrame([("d", text), ("e", None), ("f", "none: 1")], "doc_id string, text string"), "Rank / Arm").orderBy("row").collect()
    assert [(r.doc_id, r.row, r["values"]) for r in rows] == [("d", 0, {"Rank / Arm": "B", "Note": "one: two  and three"}), ("d", 1, {"Rank/Arm": "C", "Note": "last"})]


def test_evaluations(spark):
    block = "From: {}\nTo: 31/12/2020\nKind: {}\nRating: {}\nEvaluator: Col, Ann Lee, head\nDefects: none\n51 Skill: 95 points\n52 Tact: yes\n"
    texts = [block.format("01/01/2020", "REGULAR", "GOOD (93)"), block.format("01/01/2020", "REGULAR", "ODD (5)"), block.format("01/01/2020", "NOTE", "2nd UNIT"), block.format("31/02/2020", "NOTE", "X")]
    df = spark.createDataFrame([("d", i, t) for i, t in enumerate(texts)], "doc_id string, block int, text string")
    labels = {"period_start": "From", "period_end": "To", "kind": "Kind", "characterization": "Rating", "unit": "Unit", "evaluator": "Evaluator", "defects": "Defects"}
    got = extract.evaluations(df, labels, ["GOOD"], ["REGULAR", "NOTE"], ["yes", "no"], "none").orderBy("block").collect()
    assert [r.reject_reason for r in got] == [None, "characterization", None, "period"]
    assert (got[0].characterization, got[0].score, got[0].evaluator.name, got[0].defects) == ("GOOD", 93, "Ann Lee", None) and got[2].unit == "2nd UNIT"
    assert [tuple(f) for f in got[0].field_scores] == [("51", "Skill", "95"), ("52", "Tact", "yes")]


def test_line_tables(spark):
    text = "x\nRank\nDate\nDecision\nPromoted\n\nMajor\n01/01/2000\nOrder 5-\n7 of\nyear\n02/02/2000\n\nshort\nrow\n\nColonel\n1\n2\n3"
    got = extract.promotion_rows(spark.createDataFrame([("d", text), ("e", "nothing")], "doc_id string, text string"), ["Rank", "Date", "Decision", "Promoted"])
    assert rows(got, "row_index", "rank", "decision_date", "decision", "promotion_date") == [(0, "Major", "01/01/2000", "Order 5-7 of year", "02/02/2000"), (1, "Colonel", "1", "2", "3")]
    service = "Total\n12\nyears\n13\nmonths\n5\ndays\nCombat\n1\nyears\n2\nmonths\nStaff\n3\nyears\n4\nmonths\n5\ndays\nSTOP\nLate\n1\nyears\n1\nmonths\n1\ndays"
    got = extract.service_rows(spark.createDataFrame([("d", service)], "doc_id string, text string"), ["years", "months", "days"], "STOP")
    assert rows(got, "row_index", "label", "years", "months", "days") == [(0, "Total", 12, 13, 5), (1, "Staff", 3, 4, 5)]


def test_labels_are_all_or_nothing(spark):
    df = spark.createDataFrame([("a 1 b 2", ["a 1", "b 2"]), ("a 1 a 1", ["a 1"]), ("A: a 1", ["a 1"])], "t string, s array<string>")
    got = [r.x for r in df.select(extract.labelled_spans(F.col("t"), F.col("s"), F.slice(F.array(F.lit("A"), F.lit("B")), 1, F.size("s"))).alias("x")).collect()]
    assert got == ["A: a 1 B: b 2", "a 1 a 1", "A: a 1"]
    empty = spark.createDataFrame([("One:\n\nTwo: x\nThree:",)], "t string").select(extract.empty_fields(F.col("t"), ["One", "Two", "Three"]).alias("x")).first().x
    assert empty == "One: (empty)\n\nTwo: x\nThree: (empty)"


def test_vectors_and_ranks(spark):
    df = spark.createDataFrame([(1, "unit unit praise"), (2, ""), (3, None)], "id int, text string")
    got = {r.id: r.embedding for r in retrieval.bag_vectors(df, "id").collect()}
    assert sum(x * x for x in got[1]) == pytest.approx(1) and set(got[2]) == set(got[3]) == {0.0}
    one = spark.range(1).select(retrieval.bag_of_stems(F.split(F.lit("unit unit praise"), " "))).first()[0]
    assert one == pytest.approx(got[1])
    names = {"ΤΑΓΜΑΤΑΡΧ": "Major", "ΤΑΓΜ": "Bat"}
    text = spark.createDataFrame([("Ο Ταγματάρχης και ο ταγμ. ήρθαν", "ο ταγμ ήρθε")], "a string, c string")
    row = text.select(retrieval.ranks_in(F.col("a"), names, ["ΗΣ", "Η", ""]), retrieval.unsupported_ranks(F.col("a"), F.col("c"), names, ["ΗΣ", "Η", ""])).first()
    assert list(row) == [["Bat", "Major"], ["Major"]]


def test_rerank_keeps_retrieval_order_on_ties(spark):
    found = spark.createDataFrame([(1, i, s) for i, s in enumerate([1, 3, 3, 0, 1, 1, 2])], "question_id int, retrieval_rank int, s int")
    got = retrieval.rerank(found, F.col("s"), k=5).orderBy("rerank_rank").collect()
    assert [r.retrieval_rank for r in got] == [1, 2, 6, 0, 4]


def test_metrics(spark):
    cases = spark.createDataFrame([(1, "p", "x", ["a", "b"]), (2, "p", "x", []), (3, "q", "x", ["c"])], "case_id int, person_id string, period string, expected array<string>")
    truth = spark.createDataFrame([("a", "p", "x"), ("c", "q", "x"), ("z", "q", "x")], "doc_id string, person_id string, period string")
    found = spark.createDataFrame([(1, "a"), (1, "z"), (1, "unknown")], "case_id int, doc_id string")
    m = {r.case_id: r for r in evals.case_metrics(cases, found, truth).collect()}
    assert (m[1].recall, round(m[1].precision, 4), m[1].leaks, m[1].empty_ok) == (0.5, 0.3333, 2, None)
    assert (m[2].recall, m[2].precision, m[2].empty_ok) == (None, None, True) and (m[3].recall, m[3].precision) == (0.0, 0.0)
    total = evals.roll_up(evals.case_metrics(cases, found, truth)).first()
    assert total.recall == 0.25 and total.leaks == 2 and total.empty_ok and not total.passed
    none = evals.roll_up(evals.case_metrics(cases.where("false"), found, truth)).first()
    assert math.isnan(none.recall) and none.leaks == 0 and not none.empty_ok


def test_question_problems(spark):
    data = [(1, "A", "plain", ["("], None), (2, "C", "ΑΞΙOΛΟΓΗΣΗ", None, ""), (2, "A", "fine", [], "n")]
    df = spark.createDataFrame(data, "id int, tier string, text string, forbidden_patterns array<string>, notes string")
    assert rows(evals.question_problems(df), "id", "problem") == [(1, "bad pattern"), (2, "mixed script"), (2, "no notes"), (2, "repeated id")]
    df = spark.createDataFrame([("exact", " 93 ", None, "93"), ("set", None, ["a", "b"], "b and a"), ("contains", None, ["zz"], "b")], "k string, v string, vs array<string>, a string")
    assert [r[0] for r in df.select(evals.compared(F.col("k"), F.col("v"), F.col("vs"), F.col("a"))).collect()] == [True, True, False]


def test_sources(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"hello")
    f = src.files(spark, str(tmp_path)).first()
    assert f.doc_id == "2cf24dba5fb0a30e" and f.length == 5
    blocks = spark.createDataFrame([("d", 1, 0, 9.0, 20.0, " low "), ("d", 1, 0, 5.0, 10.0, "left"), ("d", 1, 0, 8.0, 10.0, "right"), ("d", 1, 1, 0.0, 0.0, "image"), ("d", 1, 0, 0.0, 0.0, " ")], "doc_id string, page int, kind int, x0 double, y0 double, text string")
    assert src.page_text(blocks).first().text == "left\n\nright\n\nlow"
    pages = spark.createDataFrame([("short", "from the image"), ("short", ""), ("a long enough page text", "x")], "text string, seen string")
    assert [r.text for r in src.with_image_text(pages, F.col("seen")).collect()] == ["from the image", "short", "a long enough page text"]
    html = "<html><head><title>t</title></head><nav>n</nav><p>One &amp; <b>two</b></p><script>x<y</script><!-- c --><p>three</p></html>"
    assert spark.range(1).select(src.html_text(F.lit(html))).first()[0] == "One & two\nthree"
    (tmp_path / "q.jsonl").write_text('{"id": 1}\n\n{"id": 2}\n')
    assert src.json_lines(spark, str(tmp_path / "q.jsonl"), "id int").where("id is not null").count() == 2
    (tmp_path / "bad.jsonl").write_text('{"id": 1}\n{oops\n')
    with pytest.raises(Exception, match="(?i)malformed"):
        src.json_lines(spark, str(tmp_path / "bad.jsonl"), "id int").collect()
    (tmp_path / "all.json").write_text('[{"id": 1},\n {"id": 2}]')
    assert src.json_document(spark, str(tmp_path / "all.json"), "id int").count() == 2
    listing = spark.createDataFrame([("p/a/v9.txt",), ("p/a/v10.txt",), ("p/b/v11.txt",)], "path string")
    assert src.latest_version(listing, "a").first().version == 10 and src.latest_version(listing, "a", "v9").count() == 1 and src.latest_version(listing, "c").count() == 0
    with pytest.raises(ValueError):
        src.latest_version(listing, "a", "9")


def test_stored_files_are_guarded(spark):
    good = "2cf24dba5fb0a30e"
    docs = spark.createDataFrame([(good, "p", "x", "/r/a.pdf"), ("e", "p", "x", "/r/../b.pdf"), ("f", "p", "x", "/r/c.txt"), ("g", "p", "x", "/r/none.pdf"), ("h", "p", "x", "/r/a2.pdf"), ("i", "p", "x", "/r/big.pdf")], "doc_id string, person_id string, period string, path string")
    files = spark.createDataFrame([("/r/a.pdf", 5, b"hello"), ("/r/../b.pdf", 5, b"hello"), ("/r/c.txt", 5, b"hello"), ("/r/a2.pdf", 5, b"hello"), ("/r/big.pdf", 60 << 20, None)], "path string, length long, content binary")
    asked = docs.select("doc_id", "person_id", "period").union(spark.createDataFrame([(good, "q", "x")], "a string, b string, c string"))
    got = {(r.doc_id, r.person_id): r.refusal for r in src.access(asked, docs, files, "/r").collect()}
    assert got == {(good, "p"): None, ("e", "p"): "outside_root", ("f", "p"): "not_pdf", ("g", "p"): "missing", ("h", "p"): "changed", ("i", "p"): "too_large", (good, "q"): "no_such_document"}
    assert {r.refusal for r in src.access(asked, docs, files, "/r", enabled=False).collect()} == {"disabled"}
