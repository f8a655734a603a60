"""Benchmark decontamination: a prefix-filtered join of benchmark windows with documents, in DataFrame operations alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.shared import Scratch, fresh
from folioscope.llm.wordset import WordSet

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What lies between words: ASCII but for letters and digits. The text keeps its case here.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """The words as they are written; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BETWEEN), "")


def lowered(text: Column) -> Column:
    """A-Z lowered, and no other letter."""
    return F.translate(text, UPPER, LOWER)


def windows_of(benchmark: DataFrame, size: int) -> DataFrame:
    """window (its words, joined by blanks), w (its words), length and items (of every item with the window); a shorter item is one window."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words_of(lowered(F.col("text"))).alias("w")).where("size(w) > 0 and item_id is not null")
    items = items.withColumn("at", F.explode(F.expr(f"sequence(0, greatest(size(w) - {size}, 0))")))
    made = items.select("item_id", F.expr(f"slice(w, at + 1, {size})").alias("w")).groupBy("w").agg(F.collect_set("item_id").alias("items"))
    return made.select(F.array_join("w", " ").alias("window"), "w", F.size("w").alias("length"), "items")


def frequencies(docs: DataFrame, tokens: DataFrame) -> DataFrame:
    """token and n: how often each of ``tokens`` (token) occurs in all texts of ``docs``, in lower case."""
    among = WordSet(tokens, "token")
    said = F.filter(F.transform(words_of(F.col("text")), F.lower), among.may_have)
    counts = docs.select(F.explode(said).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    return tokens.join(counts, "token", "left").select("token", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def with_prefixes(windows: DataFrame, docs: DataFrame, scratch: Scratch) -> DataFrame:
    """window, length, items, token and offset: the prefix token of a window is its rarest word in ``docs``, offset its first place.

    Any occurrence of a window holds all of its words, so one token of each window is enough of a prefix.
    """
    each = scratch.keep(windows.select("window", F.posexplode(F.transform("w", F.lower)).alias("offset", "token")))
    often = frequencies(docs, each.select("token").distinct())
    rarest = Window.partitionBy("window").orderBy("n", F.desc(F.length("token")), "token", "offset")
    first = each.join(often, "token").withColumn("r", F.row_number().over(rarest)).where("r = 1").select("window", "token", "offset")
    return windows.drop("w").join(first, "window")


def occurrences(docs: DataFrame, benchmark: DataFrame, scratch: Scratch, key: str, size: int = 10) -> DataFrame:
    """``key``, start (of the first word), length and items for the occurrences of windows in ``docs`` (key, text); those of equal keys are one.

    Documents are read twice, whatever the size of the benchmark: once for the frequencies of its words, and once for the
    positions whose word is a prefix token. Such a position keeps the words around it, as far as a window reaches; these meet the
    windows by token, must have room for the window at that offset (the positional and length bounds), and must be equal
    word for word. Rare tokens leave few such positions, and a token that is frequent in the windows is split by their offsets.
    """
    windows = scratch.keep(windows_of(benchmark, size))
    windows = scratch.keep(with_prefixes(windows, docs, scratch))
    tokens = WordSet(windows.select("token").distinct(), "token")
    rows = docs.select(key, words_of(F.col("text")).alias("w"))
    at = F.filter(F.transform("w", lambda w, i: F.when(tokens.may_have(F.lower(w)), i)), lambda i: i.isNotNull())
    near = F.transform(at, lambda i: F.struct(i.alias("i"), F.greatest(i - (size - 1), F.lit(0)).alias("from")))
    near = F.transform(near, lambda x: F.struct(x["i"].alias("i"), x["from"].alias("from"), F.slice("w", x["from"] + 1, x["i"] - x["from"] + size).alias("near"), F.size("w").alias("n")))
    met = rows.select(key, F.explode(near).alias("x")).select(key, "x.*").withColumn("token", F.lower(F.element_at("near", F.col("i") - F.col("from") + 1)))
    fits = (F.col("i") >= F.col("offset")) & (F.col("i") - F.col("offset") + F.col("length") <= F.col("n"))
    same = lowered(F.array_join(F.slice("near", F.col("i") - F.col("offset") - F.col("from") + 1, F.greatest("length", F.lit(1))), " ")) == F.col("window")
    found = met.join(scratch.hinted(windows), "token").where(F.when(fits, same))
    return found.select(key, (F.col("i") - F.col("offset")).alias("start"), "length", "items")


def _hits(docs: DataFrame, benchmark: DataFrame, scratch: Scratch, key: str, size: int) -> DataFrame:
    """``key``, n_hit and items of the texts with any occurrence, written once."""
    found = occurrences(docs, benchmark, scratch, key, size)
    spans = F.flatten(F.transform(F.collect_set(F.struct("start", "length")), lambda s: F.sequence(s["start"], s["start"] + s["length"] - 1)))
    return scratch.keep(found.groupBy(key).agg(F.size(F.array_distinct(spans)).cast("long").alias("n_hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items")))


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated for every row of ``docs`` (doc_id, text).

    Words are runs of letters and digits with A-Z lowered, where all characters beyond ASCII are letters. n_hit counts words inside any
    occurrence of ``size`` words running in an item of ``benchmark`` (item_id, text), or of a whole shorter item. n_items
    counts these items, items_sha256 is of their ids, sorted as strings and joined by commas. Null and empty texts have no words
    and no hits; items without words or without an id have no part; repeated rows and items are each treated alike, and empty tables
    give no rows or no hits. Long texts are split into words once for each of two readings, and their neighbourhoods leave one by one.

    Texts are compared under their SHA-256, so the hits of equal texts are found together and need no row number; all rows then
    look theirs up in a table of hits, which is broadcast while it is small.
    """
    scratch = Scratch(docs.sparkSession, "windows")
    one = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    digest = F.unhex(F.sha2("text", 256))
    hits = _hits(one.select(digest.alias("digest"), "text"), benchmark, scratch, "digest", size)
    scratch.drop_all_but(hits)
    rows = one.select("doc_id", digest.alias("digest"), F.size(words_of(F.col("text"))).cast("long").alias("n_words"))
    n_hit, items = F.coalesce("n_hit", F.lit(0).cast("long")), F.coalesce("items", F.array().cast("array<string>"))
    out = rows.join(scratch.hinted(hits), "digest", "left")
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def clean_rows(docs: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """The rows of ``docs`` (text, further columns) without any occurrence; all columns stay, and so do null texts and repeated rows."""
    scratch, (key,) = Scratch(docs.sparkSession, "windows"), fresh(docs.columns, "digest")
    digest = F.unhex(F.sha2("text", 256))
    hits = _hits(docs.select(digest.alias("digest"), "text"), benchmark, scratch, "digest", size)
    scratch.drop_all_but(hits)
    dirty = scratch.hinted(hits).select(F.col("digest").alias(key))
    return docs.withColumn(key, digest).join(dirty, key, "left_anti").select(*docs.columns)
