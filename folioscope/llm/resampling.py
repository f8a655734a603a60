"""Importance resampling towards a target distribution, from hashed word features."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.decontaminate import lowered, words_of
from folioscope.llm.shared import Scratch


def features_of(text: Column, longest: int) -> Column:
    """All runs of 1 to ``longest`` words, joined by blanks, repeats included; A-Z lowered. Null has none."""
    words = words_of(lowered(text))
    if longest == 1:
        return words

    def joined(w: Column, n: int):
        return lambda i: F.array_join(F.slice(w, i, n), " ")

    def runs(w: Column) -> Column:
        out = [w]
        for n in range(2, longest + 1):
            at = F.sequence(F.lit(1), F.greatest(F.size(w) - (n - 1), F.lit(1)))
            out.append(F.when(F.size(w) >= n, F.transform(at, joined(w, n))).otherwise(F.array().cast("array<string>")))
        return F.concat(*out)

    # A lambda's variable holds the words, which would be split again for each run otherwise.
    return F.flatten(F.transform(F.array(words), runs))


def buckets_of(text: Column, longest: int, buckets: int) -> Column:
    """The bucket of each feature: the unsigned CRC-32 of its UTF-8 bytes, modulo ``buckets``."""
    return F.transform(features_of(text, longest), lambda f: (F.crc32(f.cast("binary")) % buckets).cast("int"))


def bucket_counts(texts: DataFrame, longest: int, buckets: int) -> list[int]:
    """How many features of all ``texts`` (text) fall into each bucket: each task adds up its own, so ``buckets`` numbers of each move."""
    got = texts.select(F.explode(buckets_of(F.col("text"), longest, buckets)).alias("b")).groupBy("b").agg(F.count("*").alias("n")).toArrow()
    out = [0] * buckets
    for b, n in zip(got["b"].to_pylist(), got["n"].to_pylist(), strict=True):
        out[b] = n
    return out


def gains(source: list[int], target: list[int]) -> list[int]:
    """By bucket, a thousand times the log ratio of its smoothed shares in the target and in the source, rounded down."""
    k, s_all, t_all = len(source), sum(source), sum(target)
    return [math.floor(1000 * math.log((t + 1) * (s_all + k) / ((s + 1) * (t_all + k)))) for s, t in zip(source, target, strict=True)]


def floored_mean(total: Column, n: Column) -> Column:
    """total / n rounded down, in integers; 0 where n is 0."""
    n = F.greatest(n, F.lit(1).cast("long"))
    return F.floor((total - F.pmod(total, n)) / n).cast("long")


def noise(doc_id: Column, seed: int) -> Column:
    """A thousand times a Gumbel number, rounded down, that the seed and the id fix."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def scored(docs: DataFrame, gain: list[int], longest: int, seed: int) -> DataFrame:
    """doc_id, n_features, n_words, weight and score of every row: one pass of functions on arrays, which neither explodes nor shuffles."""
    table = F.expr(f"array({','.join(map(str, gain))})")
    found = F.col("found")
    total = F.aggregate(found, F.lit(0).cast("long"), lambda s, b: s + F.element_at(table, b + 1))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), buckets_of(F.col("text"), longest, len(gain)).alias("found"), (F.lit(0) if longest == 1 else F.size(words_of(F.col("text")))).alias("words"))
    rows = rows.select("doc_id", F.size(found).cast("long").alias("n_features"), F.size(found).cast("long").alias("n_words") if longest == 1 else F.col("words").cast("long").alias("n_words"), total.alias("total"))
    rows = rows.withColumn("weight", floored_mean(F.col("total"), F.col("n_features")))
    return rows.select("doc_id", "n_features", "n_words", "weight", (F.col("weight") + noise(F.col("doc_id"), seed)).alias("score"))


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, longest: int = 1, buckets: int = 10000, least_words: int = 20, seed: int = 2024) -> DataFrame:
    """doc_id, n_features, weight, score and rank for every row of ``docs`` (doc_id, text; further columns are ignored).

    A feature is a run of 1 to ``longest`` words (letters and digits, A-Z lowered, all characters beyond ASCII are letters). A bucket's gain tells how much more
    usual its features are in ``target`` (text) than in docs; weight is the mean gain of a document's features, score adds a Gumbel number that seed and
    doc_id fix, so the highest scores are a draw without replacement by exp(weight / 1000). Of the documents with ``least_words`` words at
    least, ``percent`` in a hundred (rounded down) are drawn, and ranked from 1; others have no rank.

    Ties in the score go to the smaller doc_id (null first), then to fewer features; rows that are equal in all of them are ranked in the order
    read. Null and empty texts have no features, and the weight 0; an empty target has the counts 0, an empty table gives no rows. A long text is one array.

    Texts are read twice, once for counts and once for scores, and never move. Ranks: scores are whole numbers, so counts by score give the least
    score that can be drawn; the rows from there on are dealt to ranges of (score, doc_id), and each range starts at the number of rows before it.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "draw")
    gain = gains(bucket_counts(docs, longest, buckets), bucket_counts(target, longest, buckets))
    rows = scratch.keep(scored(docs, gain, longest, seed))
    able = F.col("n_words") >= least_words
    # Whole scores within the logarithms of counts: tens of thousands of different ones, however many rows.
    by_score = rows.where(able).groupBy("score").agg(F.count("*").alias("n")).toArrow().sort_by([("score", "descending")])
    most, seen, least = percent * sum(by_score["n"].to_pylist()) // 100, 0, None
    for score, n in zip(by_score["score"].to_pylist(), by_score["n"].to_pylist(), strict=True):
        if seen >= most:
            break
        seen, least = seen + n, score
    out = ["doc_id", "n_features", "weight", "score"]
    unranked = F.lit(None).cast("long").alias("rank")
    if least is None:
        return rows.select(*out, unranked)
    high = able & (F.col("score") >= least)
    order = [F.desc("score"), F.asc("doc_id"), F.asc("n_features"), F.asc("seen")]
    # The last column splits rows that are alike, however many they are.
    top = rows.where(high).withColumn("seen", F.monotonically_increasing_id())
    top = scratch.keep(top.repartitionByRange(*order).sortWithinPartitions(*order).select(*out, F.monotonically_increasing_id().alias("at")))
    part, place = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    # One row for each range.
    starts = top.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    starts = starts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    ranked = top.withColumn("part", part).join(F.broadcast(starts), "part").withColumn("rank", F.col("before") + place + 1)
    ranked = ranked.select(*out, F.when(F.col("rank") <= most, F.col("rank")).alias("rank"))
    return ranked.union(rows.where(~F.coalesce(high, F.lit(False))).select(*out, unranked))
