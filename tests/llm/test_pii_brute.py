"""A pseudonymiser in plain Python, written from the operator's description, agrees with it on every kind."""

import datetime
import hashlib
import re
import time

import pytest
from pyspark.sql import functions as F

from folioscope.llm import pii
from tests.llm.conftest import frame

SHAPES = {k: re.compile(v) for k, v in pii.SHAPES.items()}


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def permuted(values, bases, key, tweak):
    values = list(values)
    half = len(values) // 2
    for r in range(1, 9):
        moves = range(half) if r % 2 == 0 else range(half, len(values))
        other = values[half:] if r % 2 == 0 else values[:half]
        seed = sha(f"{key}|{tweak}|{r}|{','.join(map(str, other))}")
        for i in moves:
            values[i] = (values[i] + int(sha(f"{seed}|{i}")[:12], 16)) % bases[i]
    return values


def characters(text, key, tweak):
    base = {c: (48 if c.isdigit() else 97 if c.islower() else 65) for c in text if re.match("[A-Za-z0-9]", c)}
    plain = [c for c in text if c in base]
    new = iter(permuted([ord(c) - base[c] for c in plain], [10 if c.isdigit() else 26 for c in plain], key, tweak))
    return "".join(chr(base[c] + next(new)) if c in base else c for c in text)


def luhn(d):
    return str(-sum(int(c) if i % 2 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10)


def mod97(x):
    return int("".join(str(int(c, 36)) for c in x)) % 97


def parts(m):
    a, b, c = re.split(r"[-/.]", m)
    if re.match(r"\d{4}-", m):
        return int(a), int(b), int(c), False
    swap = "/" in m and int(b) > 12
    return (int(c), int(a), int(b), True) if swap else (int(c), int(b), int(a), False)


def valid(kind, m):
    if kind == "date":
        try:
            return bool(datetime.date(*parts(m)[:3]))
        except ValueError:
            return False
    if kind == "ssn":
        return not re.search("^(000|666|9..)|-00-|0000$", m)
    if kind == "ip":
        return all(int(x) < 256 for x in m.split("."))
    if kind == "card":
        d = re.sub(r"\D", "", m)
        return luhn(d[:-1]) == d[-1]
    if kind == "iban":
        flat = m.replace(" ", "")
        return mod97(flat[4:] + flat[:4]) == 1
    return kind == "email" or 10 <= len(re.sub(r"\D", "", m)) <= 15


def renamed(kind, m, key):
    if kind == "email":
        name, _, domain = m.partition("@")
        return f"{characters(name, key, kind)}@{domain}"
    if kind == "phone":
        country = re.match(pii.CALLING, m).group() if re.match(r"\+\d{4}", m) else (re.match(r"(\+\d{1,3})(?=[ (.-])|", m).group())
        return country + characters(m[len(country) :], key, kind)
    if kind == "card":
        new = characters(m[:-1], key, kind)
        return new + luhn(re.sub(r"\D", "", new))
    if kind == "ip":
        return ".".join(map(str, permuted(map(int, m.split(".")), [256] * 4, key, kind)))
    if kind == "ssn":
        a, b, c = map(int, m.split("-"))
        a, b, c = permuted([a - 2 if a > 666 else a - 1, b - 1, c - 1], [898, 99, 9999], key, kind)
        return f"{a + 2 if a >= 665 else a + 1:03d}-{b + 1:02d}-{c + 1:04d}"
    if kind == "iban":
        rest = characters(m[4:], key, kind)
        return f"{m[:2]}{98 - mod97(rest.replace(' ', '') + m[:2] + '00'):02d}{rest}"
    year, month, day, swap = parts(m)
    start = datetime.date(max(1, year // 400 * 400), 1, 1)
    a, b = (93, 1567) if year < 400 else (27, 5411)
    x, y = permuted(divmod((datetime.date(year, month, day) - start).days, b), [a, b], key, "date")
    new = start + datetime.timedelta(x * b + y)
    if re.match(r"\d{4}-", m):
        return new.isoformat()
    old, sep = re.split(r"[-/.]", m), re.search(r"[-/.]", m).group()
    two = [new.month, new.day] if swap else [new.day, new.month]
    return sep.join([*(str(x) if len(o) == 1 else f"{x:02d}" for x, o in zip(two, old, strict=False)), f"{new.year:04d}"])


def brute(text, key):
    def one(m):
        kind = next((k for k in ("email", "date", "ssn", "ip", "card", "iban", "phone") if SHAPES[k].fullmatch(m.group()) and valid(k, m.group())), None)
        found.append(kind)
        return renamed(kind, m.group(), key) if kind else m.group()

    found = []
    new = re.sub(pii.ANY, one, text)
    return new, ",".join(k for k in found if k)


TEXTS = [
    "mail Anna.Maria-22@mail.example.org or x@y.de, not @home", "+1 (415) 555-2671, +14155552671, +33612345678, +49 30 12345678, 415-555-2671", "card 4111 1111 1111 1111 4111-1111-1111-1111 4111111111111111 4111111111111112",
    "378282246310005 and 3782 822463 10005", "10.1.2.3 255.255.255.0 256.1.1.1", "123-45-6789 667-01-0001 665-99-9999 899-01-0001 000-12-3456", "DE89 3704 0044 0532 0130 00 EUR, ES9121000418450200051332 EUR, BE68 5390 0754 7034 BIC, NO9386011117947",
    "9999-12-31 31/12/9999 0001-01-01 0199-12-31 9850-06-07 2024-01-15T10:00 2/13/2020 13/2/2020 04.03.1999 5/7/1999 31/02/2020 0399-12-31 0400-01-01 1600-02-29",
]


@pytest.mark.parametrize("key", ["k", "another key"])
def test_equals_brute_force(spark, key):
    got = pii.pseudonymise(frame(spark, TEXTS), key).orderBy("doc_id").collect()
    want = [brute(t, key) for t in TEXTS]
    assert [(r.text, r.kinds) for r in got] == want
    assert [r.n_found for r in got] == [len(k.split(",")) for _, k in want]


def test_dates_stay_dates_and_none_collide(spark):
    days = ["9999-12-31", "31/12/9999", "0001-01-01", "0199-12-31", "9600-01-01", "9850-05-05", "29/02/2000"]
    for key in map(str, range(10)):
        for old, r in zip(days, pii.pseudonymise(frame(spark, days), key).orderBy("doc_id").collect(), strict=True):
            assert len(r.text) == len(old) and datetime.date(*parts(r.text)[:3]) and parts(r.text)[0] // 400 == parts(old)[0] // 400
    every = spark.sql("SELECT id AS doc_id, date_format(date_add(DATE'0001-01-01', cast(id AS int)), 'yyyy-MM-dd') AS text FROM range(145731)")
    assert pii.pseudonymise(every, "k").select("text").distinct().where("text between '0001-01-01' and '0399-12-31'").count() == 145731


def test_a_long_value_takes_seconds(spark):
    docs = spark.range(1).select(F.col("id").alias("doc_id"), F.concat(F.repeat(F.lit("aB3."), 25_000), F.lit("@example.org")).alias("text"))
    began = time.time()
    (row,) = pii.pseudonymise(docs, "k").collect()
    assert time.time() - began < 60 and row.kinds == "email" and row.text == characters("aB3." * 25_000, "k", "email") + "@example.org"


def test_clashing_names_and_repeated_rows(spark):
    docs = frame(spark, ["4111111111111111"] * 3).selectExpr("*", "1 AS hits", "2 AS Found", "3 AS new", "4 AS new_text", "'x' AS kinds")
    rows = pii.pseudonymise(docs, "k").collect()
    assert len(rows) == 3 and len({r.text for r in rows}) == 1 and {(r.hits, r.Found, r.new, r.new_text, r.kinds) for r in rows} == {(1, 2, 3, 4, "card")}
