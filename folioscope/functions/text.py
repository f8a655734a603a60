"""Scalar functions on text as columns; Arrow-batched Python only where no built-in function has the semantics."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence
from difflib import SequenceMatcher
from functools import cache, lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

#: Upper-case Latin letters that look like Greek ones; fixed values.
LOOKALIKES = {"A": "Α", "B": "Β", "E": "Ε", "H": "Η", "I": "Ι", "K": "Κ", "M": "Μ", "N": "Ν", "O": "Ο", "P": "Ρ", "T": "Τ", "X": "Χ", "Y": "Υ", "Z": "Ζ"}
SPACE = r"[\s ]+"


def _mapped(column: pa.Array, f) -> pa.Array:
    return pa.array([None if x is None else f(x) for x in column.to_pylist()], pa.string())


def _bare(text: str, form: str) -> str:
    return "".join(c for c in unicodedata.normalize(form, text) if not unicodedata.combining(c))


@F.arrow_udf(StringType())
def without_accents(text: pa.Array) -> pa.Array:
    """Compatibility decomposition without combining marks."""
    return _mapped(text, lambda t: _bare(t, "NFKD"))


@F.arrow_udf(StringType())
def canonical_without_accents(text: pa.Array) -> pa.Array:
    """Canonical decomposition without combining marks."""
    return _mapped(text, lambda t: _bare(t, "NFD"))


def stripped(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def folded(text: Column, collapse: bool = True) -> Column:
    """Lower case without accents; ``collapse`` makes each run of white space one blank and trims."""
    bare = F.lower(without_accents(text))
    return F.trim(F.regexp_replace(bare, SPACE, " ")) if collapse else bare


def plain_form(text: str) -> str:
    """``folded`` of a constant."""
    return re.sub(r"\s+", " ", _bare(text, "NFKD")).strip().lower()


def rank_form(text: Column) -> Column:
    """Upper case without accents and full stops, for the comparison of ranks."""
    return F.replace(canonical_without_accents(F.upper(text)), F.lit("."), F.lit(""))


def stems(text: Column, size: int = 6, accents: bool = True) -> Column:
    """The first ``size`` characters of each run of letters and digits, lowered; ``accents=False`` also folds them (Python)."""
    low = F.lower(text) if accents else F.lower(canonical_without_accents(text))
    return F.transform(F.regexp_extract_all(low, F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), lambda w: F.substring(w, 1, size))


@cache
def _is_greek(letter: str) -> bool:
    return "GREEK" in unicodedata.name(letter, "")


_LATIN = re.compile("[A-Za-z]")
_TO_GREEK = str.maketrans(LOOKALIKES)


@lru_cache(1 << 16)
def _repaired(token: str) -> str:
    if not _LATIN.search(token) or not token.isalpha() or 2 * sum(map(_is_greek, token)) <= len(token):
        return token
    return token.translate(_TO_GREEK)


@F.arrow_udf(StringType())
def repair_lookalikes(text: pa.Array) -> pa.Array:
    """Latin capitals inside mostly Greek words become the Greek letters that they look like; white space stays. Words repeat, so a worker remembers some."""
    return _mapped(text, lambda t: re.sub(r"\S+", lambda m: _repaired(m[0]), t))


def is_mixed_script(token: Column) -> Column:
    """Whether a token has Latin and Greek letters and more than half of its letters are Greek."""
    greek, letters = (F.length(F.regexp_replace(token, p, "")) for p in (r"\P{IsGreek}+", r"\P{L}+"))
    return token.rlike("[A-Za-z]") & token.rlike(r"\p{IsGreek}") & (2 * greek > letters)


def mixed_script_tokens(text: Column) -> Column:
    """The tokens between white space that ``is_mixed_script`` holds for; one pass finds those with letters of both scripts, and only these are counted through."""
    both = r"(?<!\S)(?=\S*?[A-Za-z])(?=\S*?\p{IsGreek})\S++"
    return F.filter(F.regexp_extract_all(text, F.lit(both), F.lit(0)), is_mixed_script)


@F.arrow_udf(DoubleType())
def fuzzy_ratio(left: pa.Array, right: pa.Array) -> pa.Array:
    """Ratcliff-Obershelp similarity: twice the matching characters over all characters."""
    pairs = zip(left.to_pylist(), right.to_pylist(), strict=True)
    return pa.array([None if a is None or b is None else SequenceMatcher(None, a, b).ratio() for a, b in pairs], pa.float64())


def best_match(line: Column, titles: Sequence[str], least: float = 0.72, longest: int = 80, slack: int = 20, numbered: float = 0.9) -> Column:
    """The title that a line is a heading of, or null: titles are few and constant, so they travel with the function.

    A line of up to ``longest`` characters counts by the ratio of its whole folded form to a folded title. A line that begins with a number and a full
    stop or hyphen, and has the title behind it, has at least the ratio ``numbered``; one without a number may be ``slack`` characters
    longer than the title at most. The best ratio wins, the first title on ties. Longer lines don't leave the JVM, and equal ones of a batch are compared once.
    """
    known = [(t, plain_form(t)) for t in titles]

    def one(text: str) -> str | None:
        whole = text.strip()
        head = re.match(r"\d+\s*[-.]\s*", whole)
        plain, behind = plain_form(whole), plain_form(whole[head.end() :]) if head else ""
        best, found = 0.0, None
        for title, form in known if plain else []:
            if not head and len(whole) > len(title) + slack:
                continue
            ratio = SequenceMatcher(None, form, plain).ratio()
            if head and form in behind:
                ratio = max(ratio, numbered)
            if ratio > best and ratio >= least:
                best, found = ratio, title
        return found

    @F.arrow_udf("string")
    def matched(column: pa.Array) -> pa.Array:
        each = column.to_pylist()
        of = {x: one(x) for x in set(each) if x is not None}
        return pa.array([of.get(x) for x in each], pa.string())

    return matched(F.when(F.length(line) <= longest, line))


@cache
def _accented() -> dict[str, str]:
    """The letters with accents of the Latin and Greek blocks by their plain letter."""
    forms: dict[str, str] = {}
    for c in map(chr, range(0xC0, 0x2000)):
        plain = _bare(c, "NFKD").lower()
        if len(plain) == 1 and plain.isalpha() and plain != c.lower():
            forms[plain] = forms.get(plain, "") + c
    return forms


def _coded(prefixes: Sequence[str]) -> str:
    """The pattern of a code behind one of the words, whatever the accents and the case; a word that ends in ``*`` may go on."""

    def word(prefix: str) -> str:
        letters = "".join(f"[{c}{_accented().get(c, '')}]\\p{{M}}*" if c.isalpha() else re.escape(c) for c in plain_form(prefix.removesuffix("*")))
        return letters + (r"\w*" if prefix.endswith("*") else "")

    return rf"(?iuU)(?:{'|'.join(map(word, prefixes))})\s*(\d{{1,4}})(?:\s?([αβγab]))?(?!\w)"


def field_code(text: Column, prefixes: Sequence[str]) -> Column:
    """The first code behind one of the prefix words: 1 to 4 digits and perhaps α, β or γ (a and b count as α and β); null without one.

    Accents and case of the words don't matter, and a prefix that ends in ``*`` stands for all words that begin so.
    """
    code = F.concat(*[F.regexp_extract(text, _coded(prefixes), i) for i in (1, 2)])
    return F.nullif(F.translate(F.lower(code), "ab", "αβ"), F.lit(""))


def years(text: Column, prefixes: Sequence[str] = ()) -> Column:
    """Sorted distinct years 1900 to 2099 that no digit touches, after codes behind the prefixes are blanked."""
    if prefixes:
        text = F.regexp_replace(text, _coded(prefixes), " ")
    found = F.regexp_extract_all(text, F.lit(r"(?<!\d)((?:19|20)\d{2})(?!\d)"), F.lit(1))
    return F.array_sort(F.array_distinct(F.transform(found, lambda y: y.cast("int"))))


def spaced(label: str) -> str:
    """The pattern of a label with any white space between its characters, and some between its words."""
    return r"\s*".join(re.escape(c) if c != " " else "" for c in re.sub(r"\s*/\s*", "/", re.sub(r"\s+", " ", label))).replace(r"\s*\s*", r"\s+")


def labelled_value(text: Column, label: str) -> Column:
    """What follows ``label:`` at the start of a line, up to the next line that looks like a label or a blank line; null if empty."""
    value = F.regexp_extract(text, rf"(?ms)^[ \t]*{spaced(label)}[ \t]*:[ \t]*(.*?)(?=\n[ \t]*\n|\n[^\n:]{{1,60}}:|\z)", 1)
    return F.nullif(F.trim(F.regexp_replace(value, r"\s+", " ")), F.lit(""))


def _last_values(pairs: Column) -> Column:
    """A map of structs (k, v); of a key that repeats, the last value counts."""
    return F.map_from_entries(F.filter(pairs, lambda x, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda y: y["k"] == x["k"])))


def pipe_row(line: Column) -> Column:
    """``k: v | k: v`` as a map of strings; of a key that repeats, the last value counts."""
    parts = F.filter(F.split(line, r"\|"), lambda p: p.contains(":"))
    return _last_values(F.transform(parts, lambda p: F.struct(F.trim(F.substring_index(p, ":", 1)).alias("k"), F.trim(F.substring(p, F.instr(p, ":") + 1, F.length(p))).alias("v"))))


def label_lines(lines: Column) -> Column:
    """An array of lines ``k: v`` as a map of strings; a key begins with a letter and has up to 61 characters, and other lines don't count."""
    pattern = r"(?s)^\s*([\p{IsGreek}A-Za-z][^:]{0,60}?)\s*:\s*(.*)$"
    fit = F.filter(lines, lambda x: x.rlike(pattern))
    return _last_values(F.transform(fit, lambda x: F.struct(F.regexp_extract(x, pattern, 1).alias("k"), stripped(F.regexp_extract(x, pattern, 2)).alias("v"))))


def parsed_date(text: Column) -> Column:
    """A strict day/month/year date: struct of date, and of rejected (the text has the shape but is no day)."""
    shaped = F.trim(text).rlike(r"^\d{2}/\d{2}/\d{4}$")
    date = F.when(shaped, F.try_to_date(F.trim(text), "dd/MM/yyyy"))
    return F.struct(date.alias("date"), (shaped & date.isNull()).alias("rejected"))


def parsed_int(text: Column) -> Column:
    return F.when(F.trim(text).rlike(r"^\d{1,9}$"), F.trim(text).cast("int"))


def stored_value(text: Column) -> Column:
    """A stored number as a number: digits only, else null (the words yes and no stay text)."""
    return F.when(text.rlike("^[0-9]{1,9}$"), text.cast("int"))


def ingested_value(text: Column, words: Sequence[str]) -> Column:
    """A word of ``words`` as it is, else the first run of digits anywhere, else the trimmed text as it stands (null if there is none)."""
    digits = F.coalesce(F.nullif(F.regexp_extract(text, "[0-9]+", 0), F.lit("")), F.nullif(F.trim(text), F.lit("")))
    return F.when(F.trim(text).isin(*words), F.trim(text)).otherwise(digits)


def evaluator(text: Column) -> Column:
    """``rank, name, role`` as a struct: two parts are rank and name, one is a name."""
    p = F.transform(F.split(text, ","), lambda x: F.trim(x))
    n = F.size(p)
    return F.struct(F.when(n >= 2, F.get(p, F.lit(0))).alias("rank"), F.when(n >= 2, F.get(p, F.lit(1))).otherwise(F.get(p, F.lit(0))).alias("name"), F.when(n >= 3, F.get(p, F.lit(2))).alias("role"))


def evaluator_line(text: Column) -> Column:
    """``RANK (ARM) NAME - ROLE`` as a struct: the role follows the last " - ", a second word in brackets belongs to the rank."""
    parts = F.split(text, " - ")
    role = F.when(F.size(parts) > 1, F.trim(F.element_at(parts, -1)))
    head = F.trim(F.when(F.size(parts) > 1, F.array_join(F.slice(parts, 1, F.size(parts) - 1), " - ")).otherwise(text))
    rank = F.nullif(F.regexp_extract(head, r"^(\S+(?:\s+\([^)]*\))?)\s+\S", 1), F.lit(""))
    name = F.when(rank.isNull(), head).otherwise(F.trim(F.substring(head, F.length(rank) + 1, F.length(head))))
    return F.struct(rank.alias("rank"), name.alias("name"), role.alias("role"))


def text_between(text: Column, begin: str, end: str | None = None) -> Column:
    """What stands between a marker and the next one; without the first, what stands before the second."""
    after = F.when(text.contains(begin), F.substring(text, F.instr(text, begin) + len(begin), F.length(text))).otherwise(text)
    return after if end is None else F.when(after.contains(end), F.substring(after, F.lit(1), F.instr(after, end) - 1)).otherwise(after)


def username(text: Column) -> Column:
    """The stored form of a user name, or null if it isn't one."""
    low = F.lower(F.trim(text))
    return F.when(low.rlike(r"^[a-z0-9._-]{3,64}$"), low)


def initials(name: Column) -> Column:
    """Capital first letters of the first two words, or the first two letters of one word."""
    w = F.filter(F.split(F.trim(name), r"\s+"), lambda x: x != "")
    two = F.concat(F.substring(F.get(w, F.lit(0)), 1, 1), F.substring(F.get(w, F.lit(1)), 1, 1))
    return F.upper(F.when(F.size(w) >= 2, two).otherwise(F.substring(F.get(w, F.lit(0)), 1, 2)))


#: Compares letters alone, neither their case nor their accents; the final sigma is a sigma.
LETTERS_ALONE = "UNICODE_CI_AI"


def contains_folded(text: Column, part: str) -> Column:
    """Whether a constant is part of the text, whatever case and accents; a run of white space counts as one blank. No row leaves the JVM."""
    spaced_once = F.trim(F.regexp_replace(text, SPACE, " "))
    return F.contains(F.collate(spaced_once, LETTERS_ALONE), F.collate(F.lit(plain_form(part)), LETTERS_ALONE))


def matches_person(name: Column, person_id: Column, query: str) -> Column:
    """Whether a query is part of "name id" whatever case and accents; an empty query matches all, and a Latin m also stands for μ."""
    wanted, whole = plain_form(query), F.concat_ws(" ", name, person_id)
    return F.lit(True) if not wanted else contains_folded(whole, wanted) | contains_folded(whole, wanted.replace("m", "μ"))


def content_id(content: Column) -> Column:
    """The first 16 hex digits of the SHA-256 of bytes."""
    return F.substring(F.sha2(content.cast("binary"), 256), 1, 16)
