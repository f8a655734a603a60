from pyspark.sql import functions as F

from folioscope.functions import periods, text


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()["y"]


def test_folding(spark):
    assert one(spark, "  Ἀξιολόγησις \n ΈΤΟΥΣ ", text.folded) == "αξιολογησις ετους"
    assert one(spark, "a  É", lambda c: text.folded(c, collapse=False)) == "a  e"
    assert one(spark, "Ταγμ. άρχης", text.rank_form) == "ΤΑΓΜ ΑΡΧΗΣ"
    assert one(spark, "Évaluation, x2 ok", lambda c: text.stems(c, accents=False)) == ["evalua", "x2", "ok"]
    assert one(spark, None, text.folded) is None


def test_lookalikes(spark):
    mixed = "ΑΞΙOΛΟΓΗΣΗ  PLAIN ΤO\tΟK5"
    fixed = one(spark, mixed, text.repair_lookalikes)
    assert fixed.startswith("ΑΞΙΟΛΟΓΗΣΗ  PLAIN") and "\t" in fixed and one(spark, fixed, text.repair_lookalikes) == fixed
    assert one(spark, "ΑΞΙOΛ", text.is_mixed_script) and not one(spark, "PLAIN", text.is_mixed_script) and not one(spark, "ΑBC", text.is_mixed_script)


def test_fuzzy_ratio_is_not_edit_distance(spark):
    df = spark.createDataFrame([("abcd", "bcde"), ("", ""), (None, "a")], "a string, b string").select(text.fuzzy_ratio("a", "b").alias("r"))
    assert [r.r for r in df.collect()] == [0.75, 1.0, None]


def test_heading(spark):
    f = lambda c: text.best_match(c, ["Personal Details", "Evaluations"])
    assert one(spark, "2. EVALUATIONS of the officer", f) == "Evaluations"
    assert one(spark, "Personál details", f) == "Personal Details"
    assert one(spark, "Personal details of all persons that were ever here", f) is None
    assert one(spark, "3. " + "Evaluations " * 10, f) is None and one(spark, "", f) is None
    assert one(spark, "3 Evaluations of all the others", f) is None and one(spark, "3 - Evaluations of all the others", f) == "Evaluations"
    assert one(spark, "12. Evalu", f) is None and one(spark, "Evaluations" + " " * 70, f) is None and one(spark, None, f) is None


def test_codes_whatever_the_accents_and_endings(spark):
    code = lambda c: text.field_code(c, ["πεδιο", "κωδικ*"])
    assert one(spark, "Το ΠΕΔΊΟ 142", code) == "142" and one(spark, "πεδίο 7\tΒ;", code) == "7β" and one(spark, "ο κωδικός 51a", code) == "51α"
    assert one(spark, "κωδικοί 3 και", code) == "3" and one(spark, "κωδικός. 3", code) is None and one(spark, None, code) is None


def test_codes_and_years(spark):
    code = lambda c: text.field_code(c, ["field", "code"])
    assert one(spark, "what about Field 142b and code 7", code) == "142β"
    assert one(spark, "142 without a word", code) is None and one(spark, "code 12345", code) is None
    year = lambda c: text.years(c, ["code"])
    assert one(spark, "1999, 2001 and 1999; 12001 20015 code 1984", year) == [1999, 2001]


def test_labels_and_rows(spark):
    body = "Unit : A\n  B\nOther: z\n\nRank / Grade: Major"
    assert one(spark, body, lambda c: text.labelled_value(c, "Unit")) == "A B"
    assert one(spark, body, lambda c: text.labelled_value(c, "Rank / Grade")) == "Major"
    assert one(spark, "Unit:\n\nx: y", lambda c: text.labelled_value(c, "Unit")) is None
    assert one(spark, "a: 1 | b: x:y | a: 2", text.pipe_row) == {"a": "2", "b": "x:y"}


def test_parsed_values(spark):
    good, bad, odd = (one(spark, x, text.parsed_date) for x in ("29/02/2020", "31/02/2020", "2020-01-01"))
    assert str(good.date) == "2020-02-29" and not good.rejected and bad.date is None and bad.rejected and not odd.rejected
    assert one(spark, "12", text.stored_value) == 12 and one(spark, "²", text.stored_value) is None and one(spark, "ναι", text.stored_value) is None
    assert one(spark, "score 95 of 100", lambda c: text.ingested_value(c, ["yes"])) == "95" and one(spark, " yes ", lambda c: text.ingested_value(c, ["yes"])) == "yes"
    assert one(spark, "Major, A. B, head", text.evaluator).asDict() == {"rank": "Major", "name": "A. B", "role": "head"}
    assert one(spark, "A. B", text.evaluator).asDict() == {"rank": None, "name": "A. B", "role": None}
    assert one(spark, "Col (INF) Ann Lee - deputy - chief", text.evaluator_line).asDict() == {"rank": "Col (INF)", "name": "Ann Lee - deputy", "role": "chief"}
    assert one(spark, "head X end", lambda c: text.text_between(c, "head", "end")) == " X "
    assert one(spark, " Ab.C ", text.username) == "ab.c" and one(spark, "ab", text.username) is None
    assert one(spark, "ann lee", text.initials) == "AL" and one(spark, "ann", text.initials) == "AN"


def test_person_search(spark):
    df = spark.createDataFrame([("Μαρία Κώ", "77")], "n string, i string")
    for q, want in (("μαρια", True), ("maria", False), ("mαρια", True), ("77", True), (" ", True), ("x", False)):
        assert df.select(text.matches_person(F.col("n"), F.col("i"), q).alias("y")).first().y is want


def test_periods(spark):
    r = one(spark, "2020-01-01..2020-06-30", periods.period_range)
    assert str(r["from"]) == "2020-01-01" and str(r["to"]) == "2020-07-01" and str(r["middle"]) == "2020-04-01 00:00:00"
    d = spark.sql("select date'2020-01-01' a, date'2020-06-30' b, date'2020-12-31' c, 91.5 s, -2.0 d")
    got = d.select(periods.period_label(F.col("a"), F.col("b")), periods.period_label(F.col("a"), F.col("c")), periods.period_label(F.col("b"), F.col("c")), periods.score_text(F.col("s")), periods.delta_text(F.col("d")), periods.delta_text(F.lit(0)), periods.citation_text(F.lit("d"), F.lit(None).cast("int"))).first()
    assert list(got) == ["H1 2020", "2020", "30/06/2020 - 31/12/2020", "91,5", "-2", "±0", "d"]


def test_mixed_tokens_of_whole_texts(spark):
    """The one pass over a text finds what each token by itself says, and the repair goes by words whatever the white space."""
    words = ["ΑΞΙOΛ", "PLAIN", "ΑBC", "ΑΒ1C", "ΩΩ-Z", "ΩZ", "Ω", "É", "ΆΈx", "1", "ΩΩZ"]
    said = "".join(w + s for w, s in zip(words * 3, [" ", "\n\t", "\u00a0"] * 11))
    row = spark.createDataFrame([(said,)], "t string").select(text.mixed_script_tokens(F.col("t")).alias("one"), F.filter(F.split("t", r"\s+"), text.is_mixed_script).alias("each"), text.repair_lookalikes("t").alias("r")).first()
    assert row.one == row.each and len(row.one) > 8
    assert row.r == said.replace("ΑΞΙOΛ", "ΑΞΙΟΛ").replace("ΩΩZ", "ΩΩΖ")
    assert spark.createDataFrame([(None,)], "t string").select(text.mixed_script_tokens(F.col("t"))).first()[0] is None
    assert text._repaired.cache_info().maxsize
