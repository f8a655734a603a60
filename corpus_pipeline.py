"""A cleaned and encoded corpus in five stages, each written as Parquet before the next one reads it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm import bpe, decontaminate, language_id, near_dedup, pii
from folioscope.llm.shared import Scratch, fresh

#: The key of the pseudonyms, for the driver's invented tables; a real corpus has a secret one.
PSEUDONYM_KEY = "folioscope-demo"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one or several of the languages that the documents declare; texts in none of them, letter junk and texts without letters go."""
    names = fresh(docs.columns, "language", "text_language", "posterior", "accepted")
    return language_id.identify(docs, outputs=names).where(F.col(names[-1])).select(*docs.columns)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near copies (80 % of the five-word shingles): that of the smallest doc_id.

    Rows are compared by their texts, so different texts under one doc_id, or under none, all stay.
    """
    return near_dedup.kept_rows(docs, percent=80, width=5)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any ten running words of a benchmark item (or a whole shorter item)."""
    return decontaminate.clean_rows(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents with format-preserving pseudonyms for personal data; n_chars stays, as lengths do."""
    return pii.pseudonymise(docs, PSEUDONYM_KEY, outputs=tuple(fresh(docs.columns, "n_found", "kinds"))).select(*docs.columns)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the decoded text of every document that is left."""
    ranks = bpe.read_ranks(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return bpe.encode_documents(docs, ranks, public_tokenizers.PATTERN)


STAGES = [("language_id", language), ("near_dedup", near_dedup_stage), ("decontamination", decontamination), ("pii", pseudonyms), ("byte_bpe", encoding)]

#: No SQL has the merges of byte-level BPE, keyed hashes of Feistel rounds or connected components; a test has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, docs = Scratch(spark, "pipeline"), spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        before, docs = docs, scratch.keep(stage(spark, docs, sf_dir))
        scratch.drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
