"""Typed records from section texts: labelled rows, tables of lines, evaluations and their field scores."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions.text import LOOKALIKES, evaluator, evaluator_line, ingested_value, label_lines, labelled_value, parsed_date, pipe_row, spaced, stripped


def pipe_records(sections: DataFrame, first_label: str) -> DataFrame:
    """(doc_id, row, values map) of texts whose records begin with a line ``first_label:`` and go on to the next one.

    A record with a | anywhere is ``k: v | k: v``, over as many lines as it takes; another one has one ``k: v`` a line.
    """
    rows = sections.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "t"))
    opens = F.col("t").rlike(rf"^{spaced(first_label)}\s*:").cast("int")
    row = F.sum(opens).over(Window.partitionBy("doc_id").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)) - 1
    each = F.transform(F.sort_array(F.collect_list(F.struct("line", "t"))), lambda x: x["t"])
    blocks = rows.withColumn("row", row).where("row >= 0").groupBy("doc_id", "row").agg(each.alias("lines"))
    piped = F.exists("lines", lambda x: x.contains("|"))
    return blocks.select("doc_id", "row", F.when(piped, pipe_row(F.array_join("lines", " "))).otherwise(label_lines(F.col("lines"))).alias("values"))


def records(rows: DataFrame, columns: Mapping[str, str], dates: Sequence[str] = (), numbers: Sequence[str] = ()) -> DataFrame:
    """Named columns from the maps of ``pipe_records``; dates and numbers are parsed, and ``rejected`` lists dates of the right shape that are no days."""
    value = lambda label: F.nullif(F.trim(F.try_element_at("values", F.lit(label))), F.lit(""))
    out, rejects = [], []
    for name, label in columns.items():
        if name in dates:
            out.append(parsed_date(value(label))["date"].alias(name))
            rejects.append(F.when(parsed_date(value(label))["rejected"], F.lit(name)))
        elif name in numbers:
            out.append(F.when(value(label).rlike(r"^\d{1,9}$"), value(label).cast("int")).alias(name))
        else:
            out.append(value(label).alias(name))
    return rows.select("doc_id", "row", *out, (F.array_compact(F.array(*rejects)) if rejects else F.array().cast("array<string>")).alias("rejected"))


def block_values(blocks: DataFrame, labels: Sequence[str]) -> DataFrame:
    """blocks with the value of each label, up to the next of the labels or a blank line; the colon may stand on the next line."""
    stop = "|".join(re.escape(x) for x in labels)
    for label in labels:
        pattern = rf"(?ms)^\s*{re.escape(label)}\s*:[ \t]*(.*?)(?=\n\s*(?:{stop})\s*:|\n[ \t]*\n|\z)"
        blocks = blocks.withColumn(label, F.nullif(F.trim(F.regexp_replace(F.regexp_extract("text", pattern, 1), r"\s+", " ")), F.lit("")))
    return blocks


SCORES = "array<struct<field_code:string,description:string,value:string>>"


def labelled_scores(text: Column, labels: Sequence[str], words: Sequence[str], descriptions: Mapping[str, str] | None = None) -> Column:
    """Lines ``FIELD: code | DESCRIPTION: text | SCORE: value`` as an array of structs in order; ``labels`` are the three words.

    A description that is empty is the code's in ``descriptions``, if it has one there. A value is a word of ``words``, else its first digits, else the
    text as it stands. Lines that lack one of the labels are none of these (see ``rejected_scores``).
    """
    field, description, score = map(re.escape, labels)
    pattern = rf"(?m)^[ \t]*{field}:[ \t]*([^\s|]+)[ \t]*\|[ \t]*{description}:[ \t]*([^\n]*?)[ \t]*\|[ \t]*{score}:[ \t]*([^\n]*\S)[ \t]*$"
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    known = F.create_map(*[F.lit(x) for pair in descriptions.items() for x in pair]) if descriptions else None

    def one(line: Column) -> Column:
        code, said = F.regexp_extract(line, pattern, 1), F.nullif(F.regexp_extract(line, pattern, 2), F.lit(""))
        return F.struct(code.alias("field_code"), (said if known is None else F.coalesce(said, F.try_element_at(known, code))).alias("description"), ingested_value(F.regexp_extract(line, pattern, 3), words).alias("value"))

    return F.coalesce(F.transform(found, one), F.array().cast(SCORES))


def rejected_scores(text: Column, labels: Sequence[str]) -> Column:
    """The lines that begin with the first of the labels but aren't whole: they hold a score that can't be read."""
    field, description, score = map(re.escape, labels)
    lines = F.regexp_extract_all(text, F.lit(rf"(?m)^[ \t]*{field}:[^\n]*$"), F.lit(0))
    whole = rf"^[ \t]*{field}:[ \t]*[^\s|]+[ \t]*\|[ \t]*{description}:[^\n]*\|[ \t]*{score}:[ \t]*[^\n]*\S"
    return F.coalesce(F.filter(lines, lambda line: ~line.rlike(whole)), F.array().cast("array<string>"))


def field_scores(text: Column, words: Sequence[str]) -> Column:
    """``code description: value`` lines as an array of structs in order of appearance; a value is a word of ``words``, else the first digits, else the text as it stands."""
    pattern = r"(?m)^[ \t]*(\d{1,4}[αβγ]?)\b[ \t]*([^\n:]*):[ \t]*([^\n]*\S)[ \t]*$"
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    part = lambda line, i: F.regexp_extract(line, pattern, i)
    one = lambda line: F.struct(part(line, 1).alias("field_code"), F.nullif(F.trim(part(line, 2)), F.lit("")).alias("description"), ingested_value(part(line, 3), words).alias("value"))
    return F.transform(found, one)


def characterization(text: Column, vocabulary: Sequence[str]) -> Column:
    """``word (n)`` as a struct of word and score; a word outside the vocabulary gives nulls."""
    word, n = F.trim(F.regexp_extract(text, r"^(.*?)\s*\((\d{1,3})\)\s*$", 1)), F.regexp_extract(text, r"\((\d{1,3})\)\s*$", 1)
    known = word.isin(*vocabulary)
    return F.struct(F.when(known, word).alias("word"), F.when(known, n.cast("int")).alias("score"))


def positional_scores(lines: Column, codes: Sequence[str], words: Sequence[str]) -> Column:
    """Field scores without labels as an array of structs: a line that is a known code, its description on one or more lines, and a line with the value.

    A value is digits alone or a word of ``words``; a code without a value behind it yields nothing. ``lines`` are trimmed.
    """
    zero = F.struct(F.lit(None).cast("string").alias("code"), F.array().cast(SCORES).alias("out"))

    def step(state: Column, line: Column) -> Column:
        value = line.rlike("^[0-9]+$") | line.isin(*words)
        code = F.when(state["code"].isNull(), F.when(line.isin(*codes), line)).when(~value, state["code"])
        out = F.when(state["code"].isNotNull() & value, F.concat(state["out"], F.array(F.struct(state["code"].alias("field_code"), F.lit(None).cast("string").alias("description"), line.alias("value"))))).otherwise(state["out"])
        return F.struct(code.alias("code"), out.alias("out"))

    return F.aggregate(lines, zero, step)["out"]


#: The fields of an evaluation, from whichever layout.
EVALUATION = ("doc_id", "block", "period_start", "period_end", "kind", "characterization", "score", "unit", "evaluator", "reviewer", "reviewer_notes", "defects", "field_scores", "reject_reason")


def evaluations(blocks: DataFrame, labels: Mapping[str, str], vocabulary: Sequence[str], kinds: Sequence[str], words: Sequence[str], none_word: str) -> DataFrame:
    """Evaluations and rejects from labelled blocks (doc_id, block, text).

    labels names period_start, period_end, kind, characterization, unit, evaluator and defects, and perhaps reviewer, reviewer_notes, and field,
    field_description and field_score, by which lines of scores are read beside those that begin with a code. A
    missing kind is the first one. An unknown characterization rejects a record of the first kind; for the second kind, its text is the
    unit. ``none_word`` as defects is null.
    """
    v = {n: labelled_value(F.col("text"), labels[n]) if n in labels else F.lit(None).cast("string") for n in (*labels, "reviewer", "reviewer_notes")}
    scores = field_scores(F.col("text"), words)
    if "field" in labels:
        scores = F.concat(labelled_scores(F.col("text"), [labels[n] for n in ("field", "field_description", "field_score")], words), scores)
    out = blocks.select("doc_id", "block", *[c.alias(n) for n, c in v.items() if not n.startswith("field")], scores.alias("field_scores"))
    start, end = parsed_date(F.col("period_start")), parsed_date(F.col("period_end"))
    rated = characterization(F.col("characterization"), vocabulary)
    out = out.withColumn("kind", F.coalesce("kind", F.lit(kinds[0]))).withColumn("rated", rated)
    out = out.withColumn("unit", F.coalesce("unit", F.when((F.col("kind") == kinds[1]) & F.col("rated.word").isNull(), F.col("characterization"))))
    reason = F.when(start["date"].isNull() | end["date"].isNull(), "period").when((F.col("kind") == kinds[0]) & F.col("rated.word").isNull(), "characterization")
    out = out.withColumn("reject_reason", reason).withColumn("period_start", start["date"]).withColumn("period_end", end["date"])
    out = out.withColumn("characterization", F.col("rated.word")).withColumn("score", F.col("rated.score")).withColumn("defects", F.when(F.col("defects") != none_word, F.col("defects")))
    return out.withColumn("evaluator", evaluator(F.col("evaluator"))).withColumn("reviewer", F.when(F.col("reviewer").isNotNull(), evaluator(F.col("reviewer")))).select(*EVALUATION)


def positional_evaluations(blocks: DataFrame, labels: Mapping[str, str], vocabulary: Sequence[str], kinds: Sequence[str], codes: Sequence[str], words: Sequence[str]) -> DataFrame:
    """Evaluations and rejects from blocks (doc_id, block, text) that go by the places of their lines.

    The lines without blank ones are: the kind; a date, a hyphen, a date; perhaps a word of ``vocabulary`` with a score in brackets; lines of unit and
    duties, of which the first that is no hyphen and no number is the unit; a line with the label of the evaluator (labels: evaluator,
    reviewer, reviewer_notes), whose name stands on it or on the next one; and perhaps the reviewer's notes and the reviewer so. Look-alike
    Latin capitals in the word count as the Greek ones. A block of the first kind without a known word is rejected, since taking the
    line as the unit would lose the unit; one of the second kind begins with its unit there.
    """
    bare = str.maketrans(LOOKALIKES)
    names = F.create_map(*[F.lit(x) for w in vocabulary for x in (w.translate(bare), w)])
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: stripped(x)), lambda x: x != "")
    out = blocks.select("doc_id", "block", lines.alias("lines"))
    line = lambda i: F.get("lines", F.lit(i))
    dated = line(1).rlike(r"^\d{2}/\d{2}/\d{4}$") & (line(2) == "-") & line(3).rlike(r"^\d{2}/\d{2}/\d{4}$")
    token = F.trim(F.regexp_replace(line(4), r"\s*\((\d{1,3})\)\s*$", ""))
    word = F.try_element_at(names, F.translate(token, "".join(LOOKALIKES), "".join(LOOKALIKES.values())))
    out = out.withColumns({"kind": line(0), "dated": F.coalesce(dated, F.lit(False)), "start": line(1), "end": line(3), "word": word, "n": F.regexp_extract(line(4), r"\((\d{1,3})\)\s*$", 1)})
    out = out.withColumn("rest", F.expr("slice(lines, if(word is null, 5, 6), size(lines))"))

    def said(label: str) -> tuple[Column, Column]:
        """The place, from 1, of the first line with a label (null without), and what stands behind the colon."""
        pattern = rf"^{re.escape(label)}\s*:\s*(.*)$"
        at = F.nullif(F.array_position(F.transform("rest", lambda x: x.rlike(pattern)), True), F.lit(0)).cast("int")
        return at, stripped(F.regexp_extract(F.get("rest", at - 1), pattern, 1))

    (evaluator_at, evaluator_said), (reviewer_at, reviewer_said), (notes_at, notes_said) = (said(labels[x]) for x in ("evaluator", "reviewer", "reviewer_notes"))
    person = lambda at, text: evaluator_line(F.coalesce(F.nullif(text, F.lit("")), F.get("rest", at)))
    before = F.slice("rest", F.lit(1), F.coalesce(evaluator_at - 1, F.size("rest")))
    unit = F.get(F.filter(before, lambda x: (x != "-") & ~x.rlike("^[0-9]+$")), F.lit(0))
    body = F.slice("rest", notes_at + 1, F.greatest(F.coalesce(reviewer_at, notes_at + 1) - notes_at - 1, F.lit(0)))
    notes = F.nullif(F.array_join(F.filter(F.concat(F.array(notes_said), body), lambda x: x != ""), " "), F.lit(""))
    start, end = parsed_date(F.col("start")), parsed_date(F.col("end"))
    reason = F.when(~F.col("dated") | start["date"].isNull() | end["date"].isNull(), "period").when((F.col("kind") == kinds[0]) & F.col("word").isNull(), "characterization")
    return out.withColumns({
        "period_start": F.when(F.col("dated"), start["date"]), "period_end": F.when(F.col("dated"), end["date"]), "characterization": F.col("word"), "score": F.when(F.col("word").isNotNull(), F.nullif("n", F.lit("")).cast("int")),
        "unit": F.coalesce(unit, F.lit("")), "evaluator": F.when(evaluator_at.isNotNull(), person(evaluator_at, evaluator_said)), "reviewer": F.when(reviewer_at.isNotNull(), person(reviewer_at, reviewer_said)),
        "reviewer_notes": F.when(notes_at.isNotNull(), notes), "defects": F.lit(None).cast("string"), "field_scores": positional_scores(F.col("lines"), codes, words), "reject_reason": reason,
    }).select(*EVALUATION)


def promotion_rows(sections: DataFrame, header: Sequence[str]) -> DataFrame:
    """(doc_id, row_index, rank, decision_date, decision, promotion_date) of texts with a table of lines.

    The header is its lines one after another. Below it, groups of at least four lines between blank ones are rows: rank, date, the decision (joined;
    without a blank after a hyphen), and the last is the date of promotion. Texts without the header have no rows.
    """
    head = "\n".join(header)
    body = F.when(F.col("text").contains(head), F.substring(F.col("text"), F.instr(F.col("text"), head) + len(head), F.length("text")))
    groups = F.filter(F.transform(F.split(body, r"\n[ \t]*\n"), lambda g: F.filter(F.transform(F.split(g, "\n"), lambda x: F.trim(x)), lambda x: x != "")), lambda g: F.size(g) >= 4)
    rows = sections.select("doc_id", F.posexplode(groups).alias("row_index", "g"))
    decision = F.replace(F.array_join(F.slice("g", 3, F.size("g") - 3), " "), F.lit("- "), F.lit("-"))
    return rows.select("doc_id", "row_index", F.get("g", F.lit(0)).alias("rank"), F.get("g", F.lit(1)).alias("decision_date"), decision.alias("decision"), F.element_at("g", -1).alias("promotion_date"))


def service_rows(sections: DataFrame, units: Sequence[str], stop: str | None = None) -> DataFrame:
    """(doc_id, row_index, label, years, months, days): a label followed by exactly three pairs of lines, a number and its unit; from ``stop`` on nothing counts."""
    text = F.col("text") if stop is None else F.substring_index(F.col("text"), stop, 1)
    pair = "".join(rf"[ \t]*(\d{{1,4}})[ \t]*\n[ \t]*{re.escape(u)}[ \t]*" + (r"\n" if i < 2 else r"(?=\n|\z)") for i, u in enumerate(units))
    pattern = rf"(?m)^[ \t]*([^\d\n][^\n]*?)[ \t]*\n{pair}"
    rows = sections.select("doc_id", F.posexplode(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).alias("row_index", "m"))
    return rows.select("doc_id", "row_index", *[F.regexp_extract("m", pattern, i).cast("string" if i == 1 else "int").alias(n) for i, n in enumerate(("label", "years", "months", "days"), 1)])


def labelled_spans(text: Column, spans: Column, labels: Column) -> Column:
    """The text with a label before each span, if every span occurs exactly once; else the text as it is. Labelled spans stay."""

    @F.arrow_udf("string")
    def made(texts: pa.Array, all_spans: pa.Array, all_labels: pa.Array) -> pa.Array:
        out = []
        for t, ss, ll in zip(texts.to_pylist(), all_spans.to_pylist(), all_labels.to_pylist(), strict=True):
            if t is not None and ss and ll and all(s and t.count(s) == 1 for s in ss):
                for s, label in zip(ss, ll, strict=True):
                    if f"{label}: {s}" not in t:
                        t = t.replace(s, f"{label}: {s}")
            out.append(t)
        return pa.array(out, pa.string())

    return made(text, spans, labels)


def empty_fields(text: Column, labels: Sequence[str], mark: str = "(empty)") -> Column:
    """The text with a mark behind each label that only blank lines or another label follow."""
    stop = "|".join(re.escape(x) for x in labels)
    for label in labels:
        text = F.regexp_replace(text, rf"(?m)^([ \t]*{re.escape(label)}[ \t]*:?)[ \t]*(?=\n\s*(?:{stop})|\n?\s*\z)", f"$1 {mark}")
    return text


def empty_zones(text: Column, labels: Sequence[str], children: Mapping[str, Sequence[str]] | None = None, ends: Sequence[str] = (), mark: str = "(empty)") -> Column:
    """The text with ``: mark`` behind each label whose zone is empty.

    ``labels`` stand at the beginnings of lines, in this order; blanks in them may be any white space, and hyphens may have blanks around them. A
    label's zone reaches from its first place to that of the next one that is there, or to the end. ``children`` names the labels of each container, which may be containers
    again: a container is empty if its own zone and all its children are, so emptiness goes up from the leaves; a child that is missing is not empty.
    ``ends`` only close the zone before them. A marked zone is no longer empty, so a second time changes nothing; null stays null.
    """
    children = dict(children or {})
    if unknown := (set(children) | {c for cs in children.values() for c in cs} | set(ends)) - set(labels):
        raise ValueError(f"no such labels: {sorted(unknown)}")

    def tolerant(label: str) -> str:
        parts = re.split(r"(\s*-\s*|\s+)", label.strip())
        return "".join((r"\s*-\s*" if "-" in p else r"\s+") if i % 2 else re.escape(p) for i, p in enumerate(parts))

    # Places count characters, as substring does: what stands before the label, and with it.
    before, upto = {}, {}
    for label in labels:
        pattern = rf"(?sm)\A(.*?)(^[ \t]*{tolerant(label)})"
        there = text.rlike(rf"(?m)^[ \t]*{tolerant(label)}")
        before[label] = F.when(there, F.length(F.regexp_extract(text, pattern, 1)))
        upto[label] = before[label] + F.length(F.regexp_extract(text, pattern, 2))
    bare = {}
    for i, label in enumerate(labels):
        end = F.coalesce(*[before[x] for x in labels[i + 1 :]], F.length(text))
        bare[label] = F.coalesce(stripped(F.substring(text, upto[label] + 1, F.greatest(end - upto[label], F.lit(0)))) == "", F.lit(False))

    def empty(label: str, above: tuple[str, ...] = ()) -> Column:
        if label in above:
            raise ValueError(f"{label} is a child of its own")
        out = bare[label]
        for child in children.get(label, ()):
            out = out & empty(child, (*above, label))
        return out

    places = F.array_compact(F.array(*[F.when(empty(x), upto[x]) for x in labels if x not in ends]))
    return F.aggregate(F.sort_array(places, asc=False), text, lambda t, p: F.concat(F.substring(t, F.lit(1), p), F.lit(f": {mark}"), F.substring(t, p + 1, F.length(t))))
