"""Scoped retrieval: hashed bag-of-words vectors, cosine top-k in a scope, reranking, grounded prompts and answer checks."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions.text import rank_form, stems
from folioscope.operators.scope import Scope

RETRIEVED, RERANKED, BUCKETS = 20, 5, 256
#: Rows of a scope that are compared at once.
CHUNKS_AT_ONCE, QUESTIONS_AT_ONCE, PAIRS_AT_ONCE = 4096, 512, 65536


def bag_of_stems(tokens: Column, buckets: int = BUCKETS) -> Column:
    """A unit vector of token counts by bucket (the first 32 bits of a token's SHA-256, modulo ``buckets``); zero stays zero."""
    at = F.transform(tokens, lambda t: (F.conv(F.substring(F.sha2(t.cast("binary"), 256), 1, 8), 16, 10).cast("long") % buckets).cast("int"))
    counts = F.transform(F.sequence(F.lit(0), F.lit(buckets - 1)), lambda b: F.size(F.filter(at, lambda x: x == b)).cast("double"))
    return unit(counts)


def bag_vectors(chunks: DataFrame, key: str, text: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """(key, embedding): the same vectors for many or long texts, by counting (key, bucket) pairs before they meet."""
    tokens = chunks.select(key, F.explode(stems(F.col(text))).alias("t"))
    at = (F.conv(F.substring(F.sha2(F.col("t").cast("binary"), 256), 1, 8), 16, 10).cast("long") % buckets).cast("int")
    counts = tokens.groupBy(key, at.alias("b")).agg(F.count("*").cast("double").alias("n"))
    norm = counts.groupBy(key).agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"), F.map_from_entries(F.collect_list(F.struct("b", "n"))).alias("m"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(buckets - 1)), lambda b: F.coalesce(F.try_element_at("m", b), F.lit(0.0)) / F.col("norm"))
    zero = F.array_repeat(F.lit(0.0), buckets)
    return chunks.select(key).join(norm.select(key, dense.alias("embedding")), key, "left").withColumn("embedding", F.coalesce("embedding", zero))


def unit(v: Column) -> Column:
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(norm > 0, F.transform(v, lambda x: x / norm)).otherwise(v)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def search(chunks: DataFrame, scope: Scope, question: Sequence[float], k: int = RETRIEVED) -> DataFrame:
    """The scope's k chunks of the highest cosine, ties by id; the scope is applied first, so no other subject's row is compared."""
    asked = F.array(*[F.lit(float(x)) for x in question])
    near = scope.chunks(chunks).withColumn("score", cosine(F.col("embedding"), asked)).where("score is not null")
    return near.orderBy(F.desc("score"), "id").limit(k)


def search_many(chunks: DataFrame, questions: DataFrame, k: int = RETRIEVED) -> DataFrame:
    """``search`` for a table of questions (question_id, person_id, period, question_embedding): joined by scope, ranked per question.

    A scope's chunks and its questions are packed into blocks of at most ``CHUNKS_AT_ONCE`` and ``QUESTIONS_AT_ONCE`` rows, and each pair of blocks is compared by one
    matrix product, so a frequent scope is split. The products only choose: what may be among a question's k best of a block is scored again by
    ``cosine``'s sum, element by element. Vectors end there; what is ranked are ids and scores, and only the k best meet their chunks again.
    """
    scoped = questions.withColumn("wanted", F.explode(F.array_distinct(F.array("period", F.lit("career"))))).drop("period").withColumnRenamed("wanted", "period")
    scope = ["person_id", "period", "size"]
    asked = _blocks(_vectors(scoped, "question_embedding").select("question_id", *scope, "v"), scope, QUESTIONS_AT_ONCE, {"questions": "question_id", "asked": "v"})
    dealt = _blocks(_vectors(chunks, "embedding").select("id", *scope, "v"), scope, CHUNKS_AT_ONCE, {"ids": "id", "vectors": "v"})
    types = dict(chunks.select("id").dtypes) | dict(questions.select("question_id").dtypes)

    def best_of_block(pair: pa.Table) -> pa.Table:
        return pa.Table.from_batches([_best_of_block(b, k) for b in pair.combine_chunks().to_batches()])

    # A pair of blocks is a group, so a task holds one at a time; it is far more work than its bytes tell, so pairs are dealt over all cores.
    key = [*scope, "chunk_block", "question_block"]
    pairs = dealt.withColumnRenamed("block", "chunk_block").join(asked.withColumnRenamed("block", "question_block"), scope)
    pairs = pairs.repartition(4 * pairs.sparkSession.sparkContext.defaultParallelism, *key)
    near = pairs.groupBy(*key).applyInArrow(best_of_block, f"question_id {types['question_id']}, id {types['id']}, period string, score double")
    w = Window.partitionBy("question_id").orderBy(F.desc("score"), "id", "period")
    best = near.withColumn("retrieval_rank", F.row_number().over(w)).where(F.col("retrieval_rank") <= k)
    return best.join(chunks, ["id", "period"])


def _vectors(rows: DataFrame, embedding: str) -> DataFrame:
    """rows with v, the embedding in doubles, and its size; a vector that is null or holds null compares with nothing."""
    v = F.col(embedding).cast("array<double>")
    return rows.withColumn("v", v).withColumn("size", F.size("v")).where("v is not null and size > 0 and not exists(v, x -> x is null)")


def _blocks(rows: DataFrame, scope: list[str], at_once: int, lists: dict[str, str]) -> DataFrame:
    """One row for each block of at most about ``at_once`` rows of a scope, with its columns as lists: blocks are dealt by a hash of the id, as many as the scope's count asks for."""
    ident = next(iter(lists.values()))
    counts = rows.groupBy(*scope).agg(F.ceil(F.count("*") / F.lit(at_once)).alias("blocks"))
    dealt = rows.join(counts, scope).withColumn("block", F.pmod(F.xxhash64(ident), F.col("blocks")))
    return dealt.groupBy(*scope, "block").agg(F.collect_list(F.struct(*[F.col(c).alias(n) for n, c in lists.items()])).alias("b")).select(*scope, "block", *[F.col(f"b.{n}").alias(n) for n in lists])


def _matrix(vectors: pa.Array) -> np.ndarray:
    return vectors.flatten().flatten().to_numpy(zero_copy_only=False).reshape(len(vectors.flatten()), -1)


def _summed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``dot`` of the rows of a and b: the same sums in the same order, so that equal vectors have equal scores wherever they lie."""
    out = np.zeros(len(a))
    for d in range(a.shape[1]):
        out += a[:, d] * b[:, d]
    return out


def _best_of_block(pair: pa.RecordBatch, k: int) -> pa.RecordBatch:
    """(question_id, id, period, score): for each question of a pair of blocks, its k best of the block's chunks; ties go to the smaller id.

    A score that is not a number (a zero vector, or one with such an entry) comes first, as in SQL.
    """
    ids, questions = pair["ids"].flatten(), pair["questions"].flatten()
    vectors, asked = _matrix(pair["vectors"]), _matrix(pair["asked"])
    with np.errstate(all="ignore"):
        chunk_norms, question_norms = _summed(vectors, vectors), _summed(asked, asked)
        rough = (asked @ vectors.T) / np.sqrt(np.outer(question_norms, chunk_norms))
        odd = ~np.isfinite(rough)
        rough[odd] = -np.inf
        least = np.partition(rough, rough.shape[1] - k, axis=1)[:, -k] if k < rough.shape[1] else np.full(len(asked), -np.inf)
        q, c = np.nonzero((rough >= least[:, None] - 1e-9) | odd)
        scores = np.empty(len(q))
        for at in range(0, len(q), PAIRS_AT_ONCE):
            some = slice(at, at + PAIRS_AT_ONCE)
            scores[some] = _summed(vectors[c[some]], asked[q[some]]) / np.sqrt(chunk_norms[c[some]] * question_norms[q[some]])
    place = np.empty(len(ids), np.int64)
    place[pc.array_sort_indices(ids).to_numpy()] = np.arange(len(ids))
    order = np.lexsort((place[c], -scores, ~np.isnan(scores), q))
    q, c, scores = q[order], c[order], scores[order]
    start = np.searchsorted(q, q)
    kept = np.arange(len(q)) - start < k
    q, c, scores = q[kept], c[kept], scores[kept]
    period = pa.array(np.repeat(pair["period"].to_pylist(), len(q)), pa.string())
    return pa.RecordBatch.from_arrays([questions.take(pa.array(q)), ids.take(pa.array(c)), period, pa.array(scores, from_pandas=False)], ["question_id", "id", "period", "score"])


def overlap(a: Column, b: Column) -> Column:
    """Distinct stems that two token lists share."""
    return F.size(F.array_intersect(a, b))


def rerank(found: DataFrame, score: Column, k: int = RERANKED, key: str = "question_id") -> DataFrame:
    """Each question's k best by a second score; of equal ones the earlier retrieved comes first."""
    w = Window.partitionBy(key).orderBy(F.desc("rerank_score"), "retrieval_rank")
    return found.withColumn("rerank_score", score).withColumn("rerank_rank", F.row_number().over(w)).where(F.col("rerank_rank") <= k)


def prompts(found: DataFrame, key: str = "question_id", order: str = "rerank_rank") -> DataFrame:
    """Per question the excerpts with their labels in order, and the sorted distinct documents that they come from."""
    label = F.concat(F.lit("["), F.concat_ws(", ", "doc_id", F.concat(F.lit("page "), F.col("page").cast("string")), "section"), F.lit("]\n"), F.col("text"))
    items = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), label.alias("x"))))
    return found.groupBy(key).agg(F.array_join(F.transform(items, lambda i: i["x"]), "\n\n---\n\n").alias("context"), F.sort_array(F.collect_set("doc_id")).alias("doc_ids"))


def answer(prompt_rows: DataFrame, model: Callable[[str], str]) -> DataFrame:
    """Adds ``answer`` by a pluggable model, one call for each prompt; a null context is answered without a call."""

    @F.arrow_udf("string")
    def called(context: pa.Array) -> pa.Array:
        return pa.array([None if c is None else model(c) for c in context.to_pylist()], pa.string())

    return prompt_rows.withColumn("answer", F.coalesce(called("context"), F.lit("No matching passages.")))


def ranks_in(text: Column, canonical_by_stem: dict[str, str], endings: Sequence[str] = ("",)) -> Column:
    """Sorted distinct canonical ranks that a text names: the longest stem first, at letter borders, with one of the endings."""
    stems_ = sorted(canonical_by_stem, key=lambda s: (-len(s), s))
    tail = "|".join(re.escape(e) for e in sorted(endings, key=len, reverse=True))
    pattern = rf"(?<!\p{{L}})({'|'.join(re.escape(s) for s in stems_)})(?:{tail})(?!\p{{L}})"
    names = F.create_map(*[F.lit(x) for pair in canonical_by_stem.items() for x in pair])
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(rank_form(text), F.lit(pattern), F.lit(1)), lambda s: F.element_at(names, s))))


def unsupported_ranks(answer_text: Column, context: Column, canonical_by_stem: dict[str, str], endings: Sequence[str] = ("",)) -> Column:
    """Ranks that an answer names and its context doesn't, sorted."""
    return F.array_sort(F.array_except(ranks_in(answer_text, canonical_by_stem, endings), ranks_in(context, canonical_by_stem, endings)))
