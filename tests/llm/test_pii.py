import datetime
import re

from pyspark.sql import functions as F

from folioscope.llm import pii
from tests.llm.conftest import frame


def luhn(s):
    d = [int(c) for c in s][::-1]
    return sum(d[0::2] + [sum(divmod(2 * x, 10)) for x in d[1::2]]) % 10 == 0


def new_texts(spark, texts, key="k"):
    return [r.text for r in pii.pseudonymise(frame(spark, texts), key).orderBy("doc_id").collect()]


def test_formats_stay_and_values_stay_linked(spark):
    a, b, c = new_texts(spark, ["card 4111 1111 1111 1111.", "again 4111111111111111 or 4111-1111-1111-1111", "not a card: 4111111111111112"])
    card = re.search(r"\d{4} \d{4} \d{4} \d{4}", a).group()
    assert card != "4111 1111 1111 1111" and luhn(card.replace(" ", ""))
    assert b == f"again {card.replace(' ', '')} or {card.replace(' ', '-')}" and c.endswith("4111111111111112")


def test_dates_numbers_and_mail(spark):
    out = new_texts(spark, ["1984-02-29 31/02/2020 5/7/1999 04.03.1999", "+1 (017) 555-7713", "ip 10.1.2.3, 300.1.1.1", "Und.34@mail7.example.com UND.34@mail7.example.com", "123-45-6789 000-12-3456", "DE89 3704 0044 0532 0130 00"])
    iso, bad, short, dotted = out[0].split()
    datetime.date.fromisoformat(iso)
    assert iso != "1984-02-29" and bad == "31/02/2020" and re.fullmatch(r"\d{1,2}/\d{1,2}/\d{4}", short) and re.fullmatch(r"\d\d\.\d\d\.\d{4}", dotted)
    assert re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", out[1]) and out[1] != "+1 (017) 555-7713"
    assert all(int(x) < 256 for x in re.search(r"ip (\S+),", out[2]).group(1).split(".")) and out[2].endswith("300.1.1.1")
    first, second = out[3].split()
    assert re.fullmatch(r"[A-Z][a-z]{2}\.\d\d@mail7\.example\.com", first) and first.lower() == second.lower() and "und.34" not in first.lower()
    assert re.fullmatch(r"(?!000|666|9)\d{3}-(?!00)\d\d-(?!0000)\d{4} 000-12-3456", out[4])
    iban = out[5].replace(" ", "")
    assert int("".join(str(int(x, 36)) for x in iban[4:] + iban[:4])) % 97 == 1 and iban != "DE89370400440532013000"


def test_feistel_is_one_to_one(spark):
    values = spark.range(9 * 11).select(F.array(F.floor(F.col("id") / 11), F.col("id") % 11).alias("v"))
    got = {tuple(r.n) for r in values.select(pii.feistel(F.col("v"), F.array(F.lit(9), F.lit(11)), "k", "t").alias("n")).collect()}
    assert got == {(a, b) for a in range(9) for b in range(11)}


def test_key_matters_and_odd_rows(spark, odd_docs, odd_texts, empty_docs):
    assert new_texts(spark, ["4111111111111111"], "k") != new_texts(spark, ["4111111111111111"], "other")
    clash = odd_docs.withColumn("kinds", F.lit(1)).withColumn("n_found", F.lit("x"))
    rows = pii.pseudonymise(clash, "k").orderBy("doc_id").collect()
    assert [r.text for r in rows] == odd_texts and {r.n_found for r in rows} == {0}
    assert pii.pseudonymise(empty_docs, "k").count() == 0


def test_only_built_in_operators_run(spark, odd_docs):
    plan = pii.pseudonymise(odd_docs, "k")._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan.split("Physical Plan")[1])
