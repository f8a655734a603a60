"""Queries of the training-data operators over the driver's tables, with DuckDB equivalents where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm import bpe, decontaminate, language_id, lm_scoring, near_dedup, pii, repeats, resampling, secrets, sharding, toxicity, vector_search, whitening


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_bytes(_table(spark, sf_dir, "documents"), shards=24)


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    dictionary = secrets.Dictionary(spark, secrets.vocabulary_words(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")))
    model = secrets.train(secrets.labelled_findings(spark), dictionary)
    found = secrets.scan(_table(spark, sf_dir, "documents"), model, dictionary)
    return found.select("doc_id", "start", "length", F.sha2(F.col("candidate").cast("binary"), 256).alias("candidate_sha256"), "score", "secret")


def op3_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(_table(spark, sf_dir, "documents").select("doc_id", "text"), key="folioscope-demo")


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"), percent=85, width=3)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = bpe.read_ranks(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return bpe.encode_documents(_table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


def op7_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_search.top_k(_table(spark, sf_dir, "embeddings"), every=50, k=5)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = _table(spark, sf_dir, "labels").where("quality = 1")
    return lm_scoring.score_documents(_table(spark, sf_dir, "documents"), good)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language_id.identify(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "lang", "source", "language", "text_language", "posterior", "accepted")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings"), components=8)


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), percent=10, longest=1, buckets=10000, least_words=20, seed=2024)


def op13_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(_table(spark, sf_dir, "documents"), length=100)


QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_secret_scan": op2_secret_scan,
    "op3_pii_pseudonyms": op3_pii_pseudonyms,
    "op4_minhash_near_dedup": op4_minhash_near_dedup,
    "op5_decontamination": op5_decontamination,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_exact_top_k": op7_exact_top_k,
    "op8_toxicity": op8_toxicity,
    "op9_lm_scoring": op9_lm_scoring,
    "op10_language_id": op10_language_id,
    "op11_whitening": op11_whitening,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_suffix_array_dedup": op13_suffix_array_dedup,
}

ORACLES = {
    "op5_decontamination": r"""
        WITH d AS (
            SELECT row_number() OVER () AS r, doc_id,
                   list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
            FROM documents
        ), b AS (
            SELECT item_id::VARCHAR AS item_id,
                   list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
            FROM benchmark
        ), bw AS (
            SELECT item_id, unnest([array_to_string(w[i:i + 9], ' ') for i in range(1, greatest(len(w) - 9, 1) + 1)]) AS win, least(len(w), 10) AS n
            FROM b WHERE len(w) > 0
        ), lens AS (SELECT DISTINCT n FROM bw), dw AS (
            SELECT r, n, unnest(range(1, len(w) - n + 2)) AS i, w FROM d, lens WHERE len(w) >= n
        ), o AS (
            SELECT r, i, dw.n, item_id FROM dw JOIN bw ON dw.n = bw.n AND array_to_string(w[i:i + dw.n - 1], ' ') = win
        ), p AS (
            SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS k FROM o) GROUP BY r
        ), t AS (
            SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, item_id FROM o) GROUP BY r
        )
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
               sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN p USING (r) LEFT JOIN t USING (r)""",
    "op7_exact_top_k": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS vec FROM embeddings
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.vec, c.vec)::BIGINT AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
        )
        SELECT query_id, rank::INT AS rank, vec_id, score FROM (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
        ) WHERE rank <= 5""",
    # CRC-32 by its table of 256 remainders, for each different word.
    "op12_importance_resampling": r"""
        WITH remainders AS MATERIALIZED (
            SELECT list(list_reduce([i, 1, 2, 3, 4, 5, 6, 7, 8], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS r
            FROM (SELECT unnest(range(256)) AS i)
        ), said AS MATERIALIZED (
            SELECT row_number() OVER () AS n, doc_id, false AS wanted, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents
            UNION ALL
            SELECT -row_number() OVER (), NULL, true, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') FROM benchmark
        ), each AS MATERIALIZED (SELECT n, wanted, unnest(w) AS word FROM said
        ), hashed AS MATERIALIZED (
            SELECT word, xor(list_reduce([4294967295] || list_transform(range(len(hex(encode(word))) // 2),
                lambda i: ('0x' || substr(hex(encode(word)), 2 * i + 1, 2))::BIGINT), lambda c, x: xor(c >> 8, r[(xor(c, x) & 255) + 1])), 4294967295) % 10000 AS b
            FROM (SELECT DISTINCT word FROM each), remainders
        ), counts AS (
            SELECT b.b, count(*) FILTER (NOT wanted) AS s, count(*) FILTER (wanted) AS t
            FROM hashed b JOIN each USING (word) GROUP BY b.b
        ), gains AS (
            SELECT b, floor(1000 * ln(((t + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE) / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)::DOUBLE)))::BIGINT AS gain FROM counts
        ), weights AS (
            SELECT n, sum(gain) AS total FROM each JOIN hashed USING (word) JOIN gains USING (b) WHERE NOT wanted GROUP BY n
        ), scored AS (
            SELECT n, doc_id, len(w)::BIGINT AS n_features, coalesce(floor(total::DOUBLE / len(w)), 0)::BIGINT AS weight,
                   coalesce(floor(total::DOUBLE / len(w)), 0)::BIGINT
                   + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5) / 4294967296::DOUBLE)))::BIGINT AS score
            FROM said LEFT JOIN weights USING (n) WHERE NOT wanted
        ), placed AS (
            SELECT *, CASE WHEN n_features >= 20 THEN row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) END AS place,
                   count(*) FILTER (n_features >= 20) OVER () AS able
            FROM scored
        )
        SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * able // 100 THEN place END AS rank FROM placed""",
}
