"""From pages to the tables of the engine: sections, typed records, and chunks with vectors."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions.periods import period
from folioscope.functions.text import labelled_value, repair_lookalikes, stored_value
from folioscope.operators import extract, retrieval, sections, splitter
from folioscope.operators.scope import CAREER
from folioscope.sources.store import stable_id


@dataclass(frozen=True)
class Form:
    """The words of one kind of dossier."""

    titles: Sequence[str]
    person_section: str
    person_label: str
    name_label: str
    evaluation_section: str
    evaluation_anchor: str
    evaluation_labels: Mapping[str, str]
    characterizations: Sequence[str]
    kinds: Sequence[str]
    promotion_section: str
    promotion_header: Sequence[str]
    service_section: str
    service_units: Sequence[str]
    #: The labels of evaluator, reviewer and reviewer_notes, and the codes, of blocks that go by the places of their lines; without labels there are none.
    positional_labels: Mapping[str, str] = field(default_factory=dict)
    field_codes: Sequence[str] = field(default_factory=tuple)
    subsection_headers: Sequence[str] = field(default_factory=tuple)
    words: Sequence[str] = ("yes", "no")
    none_word: str = "none"


def ingest(pages: DataFrame, form: Form) -> dict[str, DataFrame]:
    """The tables of documents given as pages (doc_id, page, text).

    persons, evaluations, field_scores, documents, promotions, service_time and chunks, and rejects (doc_id, reason): a document
    without a person is rejected as a whole, as its rows would fall into one nameless scope; a record that can't be read is rejected
    alone. Records are read from whole sections, never from the pieces that are indexed, so a long table keeps all its rows. Only the indexed
    text and the line tables have look-alike letters repaired. Ids follow from keys, so a repeated load gives the same tables.
    """
    parts = sections.section_chunks(pages, form.titles)
    whole = sections.sections_joined(parts.where("section is not null"))
    of = lambda name: whole.where(F.col("section") == name)

    people = of(form.person_section).select("doc_id", labelled_value(F.col("text"), form.person_label).alias("person_id"), labelled_value(F.col("text"), form.name_label).alias("name"))
    known = people.where("person_id is not null").select("doc_id", "person_id", "name")
    nameless = pages.select("doc_id").distinct().join(known, "doc_id", "left_anti").select("doc_id", F.lit("no person").alias("reason"))

    def split_at(anchor: str, texts: DataFrame) -> DataFrame:
        parts = F.filter(F.split("text", rf"(?m)(?=^{anchor})"), lambda b: b.rlike(rf"(?m)^{anchor}"))
        return texts.select("doc_id", F.posexplode(parts).alias("block", "text"))

    def owned(rows: DataFrame) -> DataFrame:
        return rows.join(known.select("doc_id", "person_id"), "doc_id")

    rated_texts = of(form.evaluation_section)
    blocks = split_at(form.evaluation_anchor, rated_texts)
    read = extract.evaluations(blocks, form.evaluation_labels, form.characterizations, form.kinds, form.words, form.none_word)
    if form.positional_labels:
        # A document without any labelled block goes by the places of its lines.
        bare = rated_texts.where(~F.col("text").rlike(rf"(?m)^{form.evaluation_anchor}"))
        kinds = "|".join(re.escape(k) for k in form.kinds)
        placed = split_at(rf"[ \t]*(?:{kinds})[ \t]*$", bare)
        read = read.unionByName(extract.positional_evaluations(placed, form.positional_labels, form.characterizations, form.kinds, form.field_codes, form.words))
        blocks = blocks.union(placed)
    read = owned(read)
    read = read.withColumn("period", period(F.col("period_start"), F.col("period_end")))
    good = read.where("reject_reason is null").withColumn("id", stable_id("person_id", "period"))
    scores = good.select(F.col("id").alias("eval_id"), F.posexplode("field_scores").alias("n", "f")).select(stable_id("eval_id", "n").alias("id"), "eval_id", "f.field_code", "f.description", "f.value", stored_value(F.col("f.value")).alias("number"))

    career = lambda name: of(name).withColumn("text", repair_lookalikes("text"))
    tables = {"promotions": extract.promotion_rows(career(form.promotion_section), form.promotion_header), "service_time": extract.service_rows(career(form.service_section), form.service_units)}
    tables = {n: t.join(known.select("doc_id", "person_id"), "doc_id").withColumn("id", stable_id("person_id", F.lit(n), "row_index")) for n, t in tables.items()}
    docs = good.select("doc_id", "person_id", "period").union(known.select("doc_id", "person_id", F.lit(CAREER))).distinct()

    headers = F.filter(F.transform(F.split("text", "\n"), lambda line: F.trim(line)), lambda line: line.isin(*form.subsection_headers)) if form.subsection_headers else F.array().cast("array<string>")
    rated = blocks.join(good.select("doc_id", "block", "period", "score"), ["doc_id", "block"])
    rated = rated.select("doc_id", F.col("block").alias("seq"), F.lit(None).cast("int").alias("page"), F.lit(form.evaluation_section).alias("section"), "text", "period", "score", F.lit(None).cast("string").alias("subsection"))
    rest = sections.carry_subsections(parts.where(~F.col("section").eqNullSafe(form.evaluation_section)), headers)
    rest = rest.select("doc_id", "seq", "page", "section", repair_lookalikes("text").alias("text"), F.lit(CAREER).alias("period"), F.lit(None).cast("int").alias("score"), "subsection")
    pieces = sections.with_markers(splitter.split_long(rated.unionByName(rest))).drop("subsection")
    order = Window.partitionBy("doc_id").orderBy("period", "seq", "piece")
    pieces = pieces.join(known, "doc_id").withColumn("id", F.concat_ws(":", "doc_id", F.row_number().over(order) - 1))
    chunks = pieces.join(retrieval.bag_vectors(pieces.select("id", "text"), "id"), "id").drop("seq", "piece")

    bad = read.where("reject_reason is not null").select("doc_id", F.concat(F.lit("evaluation: "), "reject_reason").alias("reason"))
    return {
        "persons": known.groupBy("person_id").agg(F.max_by("name", "doc_id").alias("name")),
        "evaluations": good.drop("block", "field_scores", "reject_reason"),
        "field_scores": scores,
        "documents": docs,
        "chunks": chunks,
        "rejects": nameless.union(bad),
        **tables,
    }


def coverage(tables: Mapping[str, DataFrame]) -> DataFrame:
    """How much of the documents was read: evaluations, of them scored, the span of years, and whether all scores are 0 to 100."""
    e = tables["evaluations"]
    return e.groupBy("person_id").agg(F.count("*").alias("evaluations"), F.count_if(F.col("score").isNotNull()).alias("scored"), F.min(F.year("period_start")).alias("first_year"), F.max(F.year("period_end")).alias("last_year"), F.every(F.coalesce(F.col("score").between(0, 100), F.lit(True))).alias("in_range"))


def attach_duties(evaluations: DataFrame, duties: DataFrame) -> DataFrame:
    """evaluations with the duties that were read by position for the same document and period; a reading without its evaluation is an error."""
    lists = duties.groupBy("doc_id", "period").agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", "label", "days"))), lambda d: F.struct(d["label"].alias("label"), d["days"].alias("days"))).alias("read"))
    if lists.join(evaluations, ["doc_id", "period"], "left_anti").limit(1).count():
        raise ValueError("duties of a period without an evaluation")
    out = evaluations.join(lists, ["doc_id", "period"], "left")
    return out.withColumn("duties", F.coalesce("read", "duties") if "duties" in evaluations.columns else F.col("read")).drop("read")
