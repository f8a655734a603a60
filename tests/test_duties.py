import datetime as dt
import random

import pytest

from folioscope.operators import layout

SCHEMA = "doc_id string, page int, x0 double, y0 double, x1 double, y1 double, text string"


def w(x, y, text, page=1, doc="d", width=8.0):
    return (doc, page, float(x), float(y), float(x) + width, float(y) + 8, text)


def block(y, start="01/02/2020", end="03/04/2021", page=1, doc="d", labels=(), marker=None, dates=2):
    out = [w(50, y, "A.E.", page, doc)] + [w(x, y - 2.39, t, page, doc) for x, t in ((100, start), (170, end))][:dates]
    for at, words, days in labels:
        out += [w(418.56 + 30 * i, at + (0.5 if i else 0), t, page, doc) for i, t in enumerate(words)]
        if days is not None:
            out.append(w(526.8, at - 2.39, days, page, doc))
    return out + ([w(50, marker, "Reviewed:", page, doc)] if marker else [])


def found(spark, words):
    random.Random(1).shuffle(words)
    got = layout.positional_duties(spark.createDataFrame(words, SCHEMA).repartition(3), ["A.E.", "B.E."], ["Reviewed:"])
    return sorted((r.doc_id, r.page, str(r.period_start), str(r.period_end), [(d.label, d.days) for d in r.duties]) for r in got.collect())


def test_blocks_labels_and_days(spark):
    words = [
        *block(100, labels=[(110, ["HEAD", "OF", "UNIT"], "120"), (119, ["NORTH"], None), (128, ["WING"], None), (150, ["NO", "DAYS"], None)], marker=300),
        w(418.56, 320, "BELOW-THE-MARKER"), w(418.56, 60, "ABOVE-THE-ANCHOR"), w(526.8, 147.61, "12a"), w(519.9, 150, "last"), w(520.0, 150, "beyond"),
        *block(400, "05/05/2022", "06/06/2022", labels=[(410, ["SECOND"], "7")]), w(526.8, 407.0, "99"), w(418.56, 498.5, "SHARED"),
        # The next block begins a little above its anchor, and a word there belongs to both.
        *block(500, "07/07/2022", "08/08/2022"),
        *block(100, page=2), *block(100, doc="e", labels=[(110, ["OTHER"], "1")]), w(50, 50, "  ", doc="f"),
    ]
    assert found(spark, words) == [
        ("d", 1, "2020-02-01", "2021-04-03", [("HEAD OF UNIT NORTH WING", 120), ("NO DAYS last", None)]),
        ("d", 1, "2022-05-05", "2022-06-06", [("SECOND", 7), ("SHARED", None)]),
        ("d", 1, "2022-07-07", "2022-08-08", [("SHARED", None)]),
        ("d", 2, "2020-02-01", "2021-04-03", []),
        ("e", 1, "2020-02-01", "2021-04-03", [("OTHER", 1)]),
    ]


def test_blocks_without_a_period_are_rejected(spark):
    words = [*block(100, dates=1, labels=[(110, ["X"], "1")], marker=150), *block(200, end="31/02/2021", marker=250), *block(300)]
    assert len(found(spark, list(words))) == 1
    got = layout.duty_blocks(spark.createDataFrame(words, SCHEMA), ["A.E."], ["Reviewed:"])
    assert sorted((r.block, r.reject_reason) for r in got.collect()) == [(0, "dates"), (1, "date"), (2, None)]
    assert got.where("block = 2").first().bottom == float("inf")


def test_two_blocks_with_one_period_end_the_query(spark):
    with pytest.raises(Exception, match="two blocks with the period 2020-02-01..2021-04-03 on page 1 of d"):
        found(spark, [*block(100), *block(300)])
    assert len(found(spark, [*block(100), *block(300, page=2), *block(300, doc="e")])) == 3


def test_no_words(spark):
    assert layout.positional_duties(spark.createDataFrame([], SCHEMA), ["A.E."], ["Reviewed:"]).collect() == []
    assert found(spark, block(100, labels=[(110, ["A"], "5")]))[0][2:] == (str(dt.date(2020, 2, 1)), str(dt.date(2021, 4, 3)), [("A", 5)])


def test_words_that_lie_by_page_do_not_move(spark):
    words = [x for page in range(40) for x in block(100, page=page, labels=[(110, ["A"], "5")])]
    dealt = spark.createDataFrame(words, SCHEMA).repartition(3, "page")
    got = layout.positional_duties(dealt, ["A.E."], ["Reviewed:"])
    assert got.count() == 40
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_pages_across_batches_stay_whole(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        words = [x for page in range(9) for x in [*block(100, page=page, labels=[(110, ["A", "B"], "5"), (150, ["C"], None)], marker=200), *block(300, "05/05/2022", "06/06/2022", page=page)]]
        assert [r[4] for r in found(spark, words)] == [[("A B", 5), ("C", None)], []] * 9
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
