import re

import pytest

from tests.llm.test_pii import new_texts

IBANS = ["ES9121000418450200051332", "BE68 5390 0754 7034", "PL61109010140000071219812874", "NO93 8601 1117 947", "DE89 3704 0044 0532 0130 00", "FR14 2004 1010 0505 0001 3M02 606"]
PHONES = ["+14155552671", "+33612345678", "+49 30 12345678", "415-555-2671", "+33 6 12 34 56 78", "+1 (017) 555-7713"]
AFTER = ["", " EUR", " BIC X", " ABCD", " 2024", " IBAN 12"]


def shape(text):
    return re.sub("[A-Z]", "A", re.sub("[0-9]", "0", text))


def test_values_before_words_and_numbers(spark):
    texts = [v + a for v in IBANS + PHONES for a in AFTER]
    for (value, after), new in zip([(v, a) for v in IBANS + PHONES for a in AFTER], new_texts(spark, texts), strict=True):
        assert value not in new and shape(new) == shape(value + after), (value, after, new)
        if value in IBANS:
            flat = new[: len(value)].replace(" ", "")
            assert new[len(value) :] == after and int("".join(str(int(x, 36)) for x in flat[4:] + flat[:4])) % 97 == 1
        elif value.startswith("+"):
            assert new[:2] == value[:2]


def test_iso_times_and_what_is_no_phone(spark):
    time, word, plain = new_texts(spark, ["at 2024-01-15T10:00 UTC", "2024-01-15x 2024-01-15Tx", "115-555-2671 415-155-2671 +123456789 415-555-2671-3 212.255.2551.3"])
    assert re.fullmatch(r"at \d{4}-\d\d-\d\dT10:00 UTC", time) and "2024-01-15" not in time
    assert word == "2024-01-15x 2024-01-15Tx" and plain == "115-555-2671 415-155-2671 +123456789 415-555-2671-3 212.255.2551.3"


@pytest.mark.parametrize("text", ["+14155552671", "+1 415 555 2671"])
def test_one_number_has_one_pseudonym(spark, text):
    assert re.sub("[^0-9]", "", new_texts(spark, [text])[0]) == re.sub("[^0-9]", "", new_texts(spark, ["+1-415-555-2671"])[0])
