"""Format-preserving pseudonyms for personal data, in DataFrame operations alone."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.shared import fresh

#: Countries by the length of their IBANs.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH CR HR LI LV", 22: "BG BH DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
#: An IBAN ends where its country's does, whatever follows; one of another country where its run of groups does.
_IBANS = "|".join(f"(?:{c.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{{n // 4 - 1}}}" + (f" ?[A-Z0-9]{{{n % 4}}}" if n % 4 else "") + "(?![A-Za-z0-9])" for n, c in IBAN_LENGTHS.items())
#: Country codes of telephone numbers.
CALLING = r"^(\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3}))"
#: Shapes of personal data; each begins and ends at the border of a longer run, so that a long text is read once.
SHAPES = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "iban": rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?:{_IBANS}|[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,3}})?(?![A-Za-z0-9]))",
    "phone": r"(?<![A-Za-z0-9+])(?:\+[0-9]{1,3}[ .-]?)?\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}(?![0-9])|(?<![A-Za-z0-9+])\+(?:[0-9][ .-]?){9,14}[0-9](?![0-9]|[.-][0-9])|(?<![A-Za-z0-9+.-])[2-9][0-9]{2}(?:-[2-9][0-9]{2}-|\.[2-9][0-9]{2}\.| [2-9][0-9]{2} )[0-9]{4}(?![A-Za-z0-9]|[.-][0-9])",
    "date": r"(?<![A-Za-z0-9.-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?!(?!T[0-9]{2})[A-Za-z0-9]|-[0-9])|(?<![A-Za-z0-9./])[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}(?![A-Za-z0-9]|/[0-9])|(?<![A-Za-z0-9.])[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}(?![A-Za-z0-9]|\.[0-9])",
    "ssn": r"(?<![A-Za-z0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9]|-[0-9])",
    "ip": r"(?<![A-Za-z0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![A-Za-z0-9]|\.[0-9])",
    "card": r"(?<![A-Za-z0-9])(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}|[0-9]{4}([ -])[0-9]{6}\2[0-9]{5})(?![A-Za-z0-9])",
}
ANY = "|".join(SHAPES.values())
#: Rounds of the Feistel network.
ROUNDS = 8
#: A block of 400 years of the calendar has 27 * 5411 days; the first one begins with year 1 and has 93 * 1567.
CYCLE_PARTS, FIRST_PARTS = (27, 5411), (93, 1567)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def feistel(values: Column, bases: Column, key: str, tweak: str) -> Column:
    """A keyed permutation of arrays of digits, where digit i is below bases[i]; the inverse adds the same numbers backwards.

    In each round one half moves, digit by digit modulo its base, by a hash of the other half: so it is one to one for any bases.
    The other half is hashed once a round, so the work grows with the number of digits.
    """

    def permuted(start: Column) -> Column:
        half = F.floor(F.size(start) / 2).cast("int")

        def moved(state: Column, r: Column) -> Column:
            first = r % 2 == 0
            other = F.when(first, F.slice(state, half + 1, F.size(state))).otherwise(F.slice(state, 1, half))
            seed = F.concat_ws("|", F.lit(key), F.lit(tweak), r.cast("string"), F.array_join(F.transform(other, lambda x: x["v"].cast("string")), ","))

            def digits(both: Column) -> Column:
                drawn = lambda i: F.conv(F.substring(F.sha2(F.concat_ws("|", both["seed"], i.cast("string")), 256), 1, 12), 16, 10).cast("long")
                new = lambda x, i: F.when((i < both["half"]) == first, F.pmod(x["v"] + drawn(i), x["b"])).otherwise(x["v"])
                return F.transform(both["state"], lambda x, i: F.struct(new(x, i).alias("v"), x["b"].alias("b")))

            return _let(F.struct(F.sha2(seed, 256).alias("seed"), half.alias("half"), state.alias("state")), digits)

        return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, moved, lambda s: F.transform(s, lambda x: x["v"]))

    return _let(F.zip_with(values.cast("array<long>"), bases.cast("array<long>"), lambda v, b: F.struct(v.alias("v"), b.alias("b"))), permuted)


def _characters(core: Column, key: str, tweak: str) -> Column:
    """Letters and digits of ASCII permuted, each within its kind and case; other characters stay where they are."""
    base = lambda c: F.when(c.between("0", "9"), F.lit(48)).when(c.between("a", "z"), F.lit(97)).otherwise(F.lit(65))
    plain = F.filter(F.split(F.regexp_replace(core, "[^A-Za-z0-9]", ""), ""), lambda c: c != "")

    def made(plain: Column) -> Column:
        values = F.transform(plain, lambda c: F.ascii(c) - base(c))
        new = feistel(values, F.transform(plain, lambda c: F.when(c.between("0", "9"), F.lit(10)).otherwise(F.lit(26))), key, tweak)
        letters = F.zip_with(plain, new, lambda c, v: F.char(base(c) + v))
        # What stands between two letters, and before the first and after the last, is one more string than there are letters.
        return F.array_join(F.zip_with(F.split(core, "[A-Za-z0-9]", -1), letters, lambda gap, x: F.concat(gap, F.coalesce(x, F.lit("")))), "")

    return _let(plain, made)


def luhn_sum(digits: Column) -> Column:
    """Of a string of digits that lacks its check digit: the sum that the check digit fills up to a multiple of ten."""
    one = F.filter(F.split(F.reverse(digits), ""), lambda c: c != "")
    each = F.transform(one, lambda c, i: F.when(i % 2 == 0, (c.cast("int") * 2) % 10 + F.floor(c.cast("int") / 5).cast("int")).otherwise(c.cast("int")))
    return F.aggregate(each, F.lit(0), lambda s, x: s + x)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _check_digit(digits: Column) -> Column:
    return F.pmod(-luhn_sum(digits), F.lit(10)).cast("string")


def is_card(m: Column) -> Column:
    d = _digits(m)
    return _check_digit(F.substring(d, F.lit(1), F.length(d) - 1)) == F.substring(d, -1, 1)


def _iban_mod(rest: Column, head: Column) -> Column:
    """The number of rest and head, with letters as 10 to 35, modulo 97."""
    chars = F.filter(F.split(F.concat(rest, head), ""), lambda c: c != "")
    value = lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    return F.aggregate(chars, F.lit(0), lambda s, c: F.pmod(F.when(value(c) > 9, s * 100 + value(c)).otherwise(s * 10 + value(c)), F.lit(97)).cast("int"))


def _date_parts(m: Column) -> tuple[Column, Column, Column]:
    """Year, month and day of a date of one of the shapes; without a year first, the day comes first unless only the month can."""
    n = [F.regexp_extract(m, r"^([0-9]+)[-/.]([0-9]+)[-/.]([0-9]+)$", i).cast("int") for i in (1, 2, 3)]
    iso, month_first = m.rlike("^[0-9]{4}-"), m.contains("/") & (n[1] > 12)
    return F.when(iso, n[0]).otherwise(n[2]), F.when(iso, n[1]).when(month_first, n[0]).otherwise(n[1]), F.when(iso, n[2]).when(month_first, n[1]).otherwise(n[0])


def _date(m: Column) -> Column:
    y, mo, d = _date_parts(m)
    return F.try_to_date(F.concat_ws("-", F.lpad(y.cast("string"), 4, "0"), F.lpad(mo.cast("string"), 2, "0"), F.lpad(d.cast("string"), 2, "0")), "yyyy-MM-dd")


def _new_date(m: Column, key: str) -> Column:
    block = F.floor(_date_parts(m)[0] / 400).cast("int")
    start = F.make_date(F.greatest(block * 400, F.lit(1)), F.lit(1), F.lit(1))
    day = F.datediff(_date(m), start)

    def permuted(parts: tuple[int, int]) -> Column:
        a, b = parts
        new = feistel(F.array(F.floor(day / b), F.pmod(day, F.lit(b))), F.array(F.lit(a), F.lit(b)), key, "date")
        return _let(new, lambda x: F.get(x, F.lit(0)) * b + F.get(x, F.lit(1))).cast("int")

    moved = F.when(block == 0, permuted(FIRST_PARTS)).otherwise(permuted(CYCLE_PARTS))

    def written(d: Column) -> Column:
        n = [F.regexp_extract(m, r"^([0-9]+)[-/.]([0-9]+)[-/.]([0-9]+)$", i) for i in (1, 2, 3)]
        month_first = m.contains("/") & (n[1].cast("int") > 12)
        sep, day, month = F.regexp_extract(m, "([-/.])", 1), F.date_format(d, "dd"), F.date_format(d, "MM")
        bare = lambda x, like: F.when(F.length(like) == 1, x.cast("int").cast("string")).otherwise(x)
        other = F.concat(F.when(month_first, bare(month, n[0])).otherwise(bare(day, n[0])), sep, F.when(month_first, bare(day, n[1])).otherwise(bare(month, n[1])), sep, F.lpad(F.year(d).cast("string"), 4, "0"))
        return F.when(m.rlike("^[0-9]{4}-"), F.date_format(d, "yyyy-MM-dd")).otherwise(other)

    return _let(F.date_add(start, moved), written)


def kind_of(m: Column) -> Column:
    """The kind of a match that is valid as one of that kind, else null."""
    shape = lambda k: m.rlike(f"^(?:{SHAPES[k]})$")
    octets = F.split(m, r"\.")
    ssn = shape("ssn") & ~m.rlike("^(000|666|9..)|-00-|0000$")
    kinds = F.when(shape("email"), F.lit("email"))
    kinds = kinds.when(shape("date") & _date(m).isNotNull(), F.lit("date")).when(ssn, F.lit("ssn"))
    kinds = kinds.when(shape("ip") & F.forall(octets, lambda o: o.cast("int") <= 255), F.lit("ip"))
    kinds = kinds.when(shape("card") & is_card(m), F.lit("card"))
    kinds = kinds.when(shape("iban") & (_iban_mod(F.substring(F.regexp_replace(m, " ", ""), 5, 64), F.substring(m, 1, 4)) == 1), F.lit("iban"))
    return kinds.when(shape("phone") & F.length(_digits(m)).between(10, 15), F.lit("phone"))


def pseudonym(m: Column, kind: Column, key: str) -> Column:
    """A match's pseudonym: valid, of the same format, and the same for equal values in every document."""
    local = F.substring_index(m, "@", 1)
    at = F.instr(m, "@")
    domain = F.substring(m, at, F.length(m))
    country = F.when(m.rlike(r"^\+[0-9]{4}"), F.regexp_extract(m, CALLING, 1)).otherwise(F.regexp_extract(m, r"^(\+[0-9]{1,3})(?=[ (.-])", 1))
    national = F.substring(m, F.length(country) + 1, F.length(m))
    body = F.substring(m, F.lit(1), F.length(m) - 1)
    octets = F.transform(F.split(m, r"\."), lambda o: o.cast("long"))
    ssn = [F.substring(m, a, n).cast("long") for a, n in ((1, 3), (5, 2), (8, 4))]
    area = F.when(ssn[0] > 666, ssn[0] - 2).otherwise(ssn[0] - 1)

    def new_ssn(x: Column) -> Column:
        first = F.when(F.get(x, F.lit(0)) >= 665, F.get(x, F.lit(0)) + 2).otherwise(F.get(x, F.lit(0)) + 1)
        return F.format_string("%03d-%02d-%04d", first, F.get(x, F.lit(1)) + 1, F.get(x, F.lit(2)) + 1)

    def new_iban(rest: Column) -> Column:
        flat = F.regexp_replace(rest, " ", "")
        return F.concat(F.substring(m, 1, 2), F.lpad((98 - _iban_mod(flat, F.concat(F.substring(m, 1, 2), F.lit("00")))).cast("string"), 2, "0"), rest)

    return (
        F.when(kind == "email", F.concat(_characters(local, key, "email"), domain))
        .when(kind == "phone", F.concat(country, _characters(national, key, "phone")))
        .when(kind == "card", _let(_characters(body, key, "card"), lambda b: F.concat(b, _check_digit(_digits(b)))))
        .when(kind == "ip", F.array_join(feistel(octets, F.transform(octets, lambda o: F.lit(256)), key, "ip").cast("array<string>"), "."))
        .when(kind == "ssn", _let(feistel(F.array(area, ssn[1] - 1, ssn[2] - 1), F.array(F.lit(898), F.lit(99), F.lit(9999)), key, "ssn"), new_ssn))
        .when(kind == "date", _new_date(m, key))
        .when(kind == "iban", _let(_characters(F.substring(m, F.lit(5), F.length(m)), key, "iban"), new_iban))
        .otherwise(m)
    )


def pseudonymise(docs: DataFrame, key: str, outputs: tuple[str, str] = ("n_found", "kinds")) -> DataFrame:
    """All columns of ``docs`` with a new text, and n_found and kinds (of what was replaced, in order, joined by commas), under the names ``outputs``.

    E-mail addresses (the part before the @), phone numbers (behind the country), payment cards (Luhn), IP addresses,
    US social security numbers, IBANs (modulo 97) and calendar dates are found by shape and checked; what fails its check stays
    as it is. Each valid one is permuted under ``key`` within its format, so a card stays a valid card, a date a date of the same
    400 years (those that begin with a multiple of 400; the first with year 1), separators, case and length stay, and equal values get
    equal pseudonyms in all documents. Nothing is shuffled: a row needs no other, so repeated rows repeat and ties have no meaning; an empty
    table gives no rows. A null text stays null with n_found 0; columns with the names of the outputs are replaced, others stay whatever their
    names. An empty text stays empty. The work grows with the length of a text and of each value in it.
    """
    kept = [c for c in docs.columns if c.lower() not in [x.lower() for x in outputs]]
    hits_, found_, new_, text_ = fresh(docs.columns, "hits", "found", "new", "new_text")
    text = F.col("text")
    hits = F.when(text.rlike("[0-9@]"), F.regexp_extract_all("text", F.lit(ANY), F.lit(0)))
    found = F.transform(hits_, lambda m: F.struct(m.alias("m"), kind_of(m).alias("kind")))
    new = F.transform(found_, lambda x: F.when(x["kind"].isNull(), x["m"]).otherwise(pseudonym(x["m"], x["kind"], key)))
    some = F.exists(found_, lambda x: x["kind"].isNotNull())
    out = docs.select(*kept).withColumn(hits_, hits).withColumn(found_, F.when(F.size(hits_) > 0, found))
    whole = F.array_join(F.zip_with(F.split(text, ANY, -1), new_, lambda g, x: F.concat(g, F.coalesce(x, F.lit("")))), "")
    out = out.withColumn(new_, F.when(some, new)).withColumn(text_, F.when(F.col(new_).isNotNull(), whole).otherwise(text))
    kinds = F.coalesce(F.filter(F.transform(found_, lambda x: x["kind"]), lambda k: k.isNotNull()), F.array().cast("array<string>"))
    keep = [F.col(text_).alias("text") if c == "text" else F.col(c) for c in kept]
    return out.select(*keep, F.size(kinds).cast("long").alias(outputs[0]), F.array_join(kinds, ",").alias(outputs[1]))
