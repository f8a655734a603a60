"""Near-duplicate documents: bottom-k sketches, inverted lists, union-sketch estimates and exact Jaccard similarity."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.components import components
from folioscope.llm.shared import Scratch, bound_batches, fresh
from folioscope.llm.words import Words, chunks, shingles

#: Lists of up to so many classes are paired directly; longer ones go through the prefixes of the full sets.
SHORT_LIST = 32
#: Entries of one list that meet in one task.
BLOCK = 1500


def signatures(docs: DataFrame, width: int, keep: int) -> DataFrame:
    """doc_id, row (if docs has it), n (shingles), digest (of the set; null if it is empty) and sketch (the ``keep`` smallest hashes)."""
    own = ["doc_id", "row"] if "row" in docs.columns else ["doc_id"]

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, digest, sketch = [], [], []
            for _, data, at in chunks(batch.column(len(own))):
                for s in shingles(Words(data, at), width):
                    n.append(len(s))
                    digest.append(blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                    sketch.append(s[:keep])
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(own)], pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(sketch, pa.list_(pa.int64()))], names=[*own, "n", "digest", "sketch"])

    bound_batches(docs.sparkSession)
    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *own[1:], "text")
    return kept.mapInArrow(made, f"doc_id long, {'row binary, ' if own[1:] else ''}n long, digest binary, sketch array<long>")


def full_sets(docs: DataFrame, width: int) -> DataFrame:
    """digest and the whole set as a sorted array."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, at in chunks(batch.column(0)):
                sets = list(shingles(Words(data, at), width))
                yield pa.RecordBatch.from_arrays([pa.array([blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()), pa.array(sets, pa.list_(pa.int64()))], names=["digest", "items"])

    return docs.select("text").mapInArrow(made, "digest binary, items array<long>")


def _jaccard(left: str, right: str, percent: int) -> Column:
    shared = f"size(array_intersect({left}, {right}))"
    return F.expr(f"100L * {shared} >= {percent}L * (size({left}) + size({right}) - {shared})")


def _stars(lists: DataFrame, scratch: Scratch) -> DataFrame:
    """Of each list, every class with the most typical one: the one whose retained values are the most frequent.

    The lists' own rows join a written table of one row a list, so a long list is no more than a skewed side, which Spark splits.
    """
    pivot = lists.groupBy("v").agg(F.max(F.struct("typical", "id", "n", "c")).alias("p"), F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi")
    pivot = scratch.hinted(scratch.keep(pivot.select("v", "p")))
    return lists.join(pivot, "v").select(F.col("p.id").alias("a"), F.col("id").alias("b"), F.col("p.n").alias("na"), F.col("n").alias("nb"), F.col("p.c").alias("ca"), F.col("c").alias("cb"))


def _pairs(found: DataFrame, percent: int) -> DataFrame:
    """Different pairs of one order that lie in different components and whose sizes allow the similarity."""
    ok = (F.col("ca") != F.col("cb")) & (100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    return found.where(ok).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _links(pairs: DataFrame, sketches: DataFrame, sets: DataFrame, percent: int, k: int, least: int, scratch: Scratch) -> DataFrame:
    """Those pairs whose union sketch doesn't rule the similarity out and whose full sets have it."""
    side = lambda t, c, x, y: t.select(F.col("id").alias(c), F.col(x).alias(y))
    met = pairs.join(side(sketches, "a", "sketch", "sa"), "a").join(side(sketches, "b", "sketch", "sb"), "b")
    met = met.withColumn("u", F.expr(f"slice(array_sort(array_union(sa, sb)), 1, {k})")).withColumn("m", F.expr("size(array_intersect(array_intersect(u, sa), sb))"))
    # Where the sketches are whole sets, the estimate is the similarity itself.
    whole = F.expr(f"size(sa) < {k} and size(sb) < {k} and size(array_union(sa, sb)) < {k}")
    met = scratch.keep(met.where(F.when(whole, F.expr(f"100 * m >= {percent} * size(u)")).otherwise(F.expr(f"m >= {least}"))).select("a", "b"))
    # Sets that no pair names are not moved, while the names are few.
    named = scratch.keep(met.select(F.col("a").alias("id")).union(met.select("b")).distinct())
    sets = sets.join(scratch.hinted(named), "id", "left_semi")
    met = met.join(side(sets, "a", "items", "ia"), "a").join(side(sets, "b", "items", "ib"), "b")
    return scratch.keep(met.where(_jaccard("ia", "ib", percent)).select("a", "b"))


def near_duplicates(docs: DataFrame, percent: int = 80, width: int = 5, k: int = 40) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of ``docs`` (doc_id, text; further columns are ignored).

    Two documents are linked if their sets of ``width``-word shingles have a Jaccard similarity of ``percent`` / 100; a
    component's id is its smallest doc_id, and that document is kept. Documents of the same set are one class and meet
    as one. The classes' bottom-k sketches come from one hash function:

    1. Of each sketch the rarest values are put into inverted lists, as many as a pair of the similarity must share one
       of: with a sketch of k values, at least half of the union's k smallest values lie in both (with k = 40, all but 4 in 10^8
       of the pairs just at 0.85 and 5 in 10^6 of those just at 0.80); a sketch of a much smaller set has its exact prefix.
    2. Each list's classes meet its most typical one. Pairs pass by their union sketch and are confirmed on full sets.
    3. What then lies in different components meets pairwise in short lists. The classes of longer lists are dealt to new
       lists by the rarest shingles of their full sets (exact prefix and positional filter); there, the rest is compared
       in blocks of bounded size, and a join yields confirmed links alone.

    Null and empty texts and texts of white space have no shingles, and are linked with nothing. Fewer than ``width``
    words are one shingle. Rows may repeat; a null doc_id is a smallest doc_id of no component that has another one.
    """
    sig, home = _homes(docs.drop("row"), percent, width, k)
    out = sig.select("doc_id", F.col("n").alias("n_shingles"), "digest").join(home.drop("root"), "digest", "left")
    out = out.withColumn("component_id", F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def kept_rows(docs: DataFrame, percent: int = 80, width: int = 5, k: int = 40) -> DataFrame:
    """One row of each component of ``near_duplicates``, and all rows without shingles, with all their columns.

    Rows decide and not ids, so rows that share a doc_id, or have none, stay if they are no near copies. Of a component the row of
    the smallest doc_id stays (null last), and of several such rows that of the smallest digest of all columns.
    """
    (key,) = fresh(docs.columns, "row_digest")
    row = F.unhex(F.sha2(F.to_json(F.struct(*[F.col(c) for c in docs.columns]), {"ignoreNullFields": "false"}), 256))
    worded = docs.where(F.col("text").rlike(r"[^ \t\n\x0b\x0c\r]"))
    sig, home = _homes(worded.select("doc_id", "text", row.alias("row")), percent, width, k)
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "row")
    kept = sig.select("doc_id", "row", "digest").join(home, "digest").groupBy("root").agg(F.min(order).alias("best")).select(F.col("best.row").alias(key))
    # Rows that are equal in all columns are one by now, before the join, however many they are.
    one = worded.withColumn(key, row).dropDuplicates([key]).join(kept, key, "left_semi").select(*docs.columns)
    blank = docs.where(~F.coalesce(F.col("text").rlike(r"[^ \t\n\x0b\x0c\r]"), F.lit(False)))
    return one.union(blank)


def _homes(docs: DataFrame, percent: int, width: int, k: int) -> tuple[DataFrame, DataFrame]:
    """The signatures of all rows; and digest, root and component_id of each class."""
    spark = docs.sparkSession
    scratch, least = Scratch(spark, "near"), k // 2
    sig = scratch.keep(signatures(docs, width, k))
    classes = sig.where("n > 0").groupBy("digest").agg(F.min("doc_id").alias("first"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    classes = scratch.keep(classes.withColumn("id", F.monotonically_increasing_id()))

    vals = classes.select("id", F.explode("sketch").alias("v"))
    counts = scratch.keep(vals.groupBy("v").agg(F.count("*").alias("df")).where("df > 1"))
    shared = vals.join(scratch.hinted(counts), "v").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("df", "v"))).alias("vs"), F.sum("df").alias("typical"))
    size, n = F.size("sketch"), F.col("n")
    short = f"size(sketch) - cast(ceil({percent} * size(sketch) / 100D) as int) + 1"
    prefix = F.when(n <= k * 2 // 5, F.expr(short)).otherwise(size - F.floor(size / 2) + 1).cast("int")
    # Values of one class alone come first in the order of rarity, and need no list.
    needed = classes.select("id", "n", size.alias("size"), prefix.alias("prefix"))
    picked = needed.join(shared, "id").withColumn("room", (F.col("prefix") - (F.col("size") - F.size("vs"))).cast("int")).where("room > 0")
    lists = scratch.keep(picked.select("id", "n", "typical", F.explode(F.expr("slice(vs, 1, room)")).alias("x")).select("id", "n", "typical", F.col("x.v").alias("v")))
    by_list = scratch.keep(lists.groupBy("v").agg(F.count("*").alias("m")).where("m > 1"))
    lists = scratch.keep(lists.join(scratch.hinted(by_list), "v").select("v", "id", "n", "typical", "m"))
    scratch.drop(counts, by_list)

    active = lists.select("id").distinct().join(classes, "id").select("id", "digest", F.col("first").alias("doc_id"), "sketch")
    active = scratch.keep(active)
    wanted = scratch.keep(active.select("doc_id").distinct())
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(scratch.hinted(wanted), "doc_id", "left_semi")
    if classes.where("first is null").limit(1).count():
        texts = texts.union(docs.where("doc_id is null").select(F.col("doc_id").cast("long"), "text"))
    named = scratch.keep(active.select("digest", "id"))
    sets = full_sets(texts, width).join(scratch.hinted(named), "digest").groupBy("id").agg(F.first("items").alias("items"))
    sets = scratch.keep(sets)
    confirm = lambda pairs: _links(pairs, active, sets, percent, k, least, scratch)

    alone = lists.withColumn("c", F.col("id"))
    links = [confirm(_pairs(_stars(alone, scratch), percent))]
    roots = components(links[0], scratch)

    def labelled(t: DataFrame) -> DataFrame:
        return t.join(scratch.hinted(roots).withColumnRenamed("node", "id"), "id", "left").withColumn("c", F.coalesce("root", "id")).drop("root")

    now = scratch.keep(labelled(lists))
    mixed = scratch.keep(now.groupBy("v").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("v"))
    rest = scratch.keep(now.join(scratch.hinted(mixed), "v"))
    scratch.drop(now)
    few = rest.where(F.col("m") <= SHORT_LIST)
    left, right = (few.select(F.col("v").alias(f"v{s}"), F.col("id").alias(s), F.col("n").alias(f"n{s}"), F.col("c").alias(f"c{s}")) for s in "ab")
    short_pairs = _pairs(left.join(right, (F.col("va") == F.col("vb")) & (F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb"))), percent)

    many = rest.where(F.col("m") > SHORT_LIST).groupBy("id").agg(F.max("n").alias("n"), F.max("typical").alias("typical"), F.max("c").alias("c"))
    many = scratch.keep(many)
    deep = None
    if many.limit(1).count():
        deep = scratch.keep(_deep_lists(many, sets, percent, scratch))
        deep_pairs = _pairs(_stars(deep, scratch), percent)
        links.append(confirm(short_pairs.union(deep_pairs).distinct()))
    else:
        links.append(confirm(short_pairs))
    known = links[0].union(links[1])
    roots = components(known, scratch)
    if deep is not None:
        links.append(scratch.keep(_block_links(labelled(deep.drop("c")), sets, percent, scratch)))
        roots = components(known.union(links[2]), scratch)

    owner = classes.join(scratch.hinted(roots).withColumnRenamed("node", "id"), "id", "left").select("digest", "first", F.coalesce("root", "id").alias("root"))
    lowest = owner.groupBy("root").agg(F.min("first").alias("component_id"))
    homes = scratch.keep(owner.join(lowest, "root").select("digest", "root", "component_id"))
    scratch.drop_all_but(sig, homes)
    return sig, homes


def _alpha(percent: int, a: str, b: str) -> str:
    """How many shingles sets of so many must share."""
    return f"cast(ceil({percent} * ({a} + {b}) / {100 + percent}D - 1e-9) as long)"


def _deep_lists(many: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Lists by the rarest shingles of the full sets, with the place ``i`` of the shingle in the order of rarity."""
    items = many.join(sets, "id").select("id", F.explode("items").alias("v"))
    counts = scratch.keep(items.groupBy("v").agg(F.count("*").alias("df")).where("df > 1"))
    shared = items.join(scratch.hinted(counts), "v").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("df", "v"))).alias("vs"))
    base = many.join(shared, "id").withColumn("lone", F.expr("n - size(vs)"))
    room = F.expr(f"cast(n - cast(ceil({percent} * n / 100D) as long) + 1 - lone as int)")
    lists = base.withColumn("room", room).where("room > 0").select("id", "n", "typical", "c", "lone", F.posexplode(F.expr("slice(vs, 1, room)")).alias("i", "x"))
    lists = scratch.keep(lists.select("id", "n", "typical", "c", (F.col("i") + F.col("lone")).alias("i"), F.col("x.v").alias("v")))
    smallest = scratch.keep(lists.groupBy("v").agg(F.min("n").alias("least"), F.count("*").alias("m")).where("m > 1").drop("m"))
    return lists.join(scratch.hinted(smallest), "v").where(f"n - i >= {_alpha(percent, 'n', 'least')}").drop("least")


def _block_links(lists: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Links between different components in the lists, block against block; the join's condition confirms them."""
    lists = scratch.keep(lists)
    sizes = scratch.keep(lists.groupBy("v").agg(F.count("*").alias("m"), F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("v", "m"))
    dealt = lists.join(scratch.hinted(sizes), "v").withColumn("of", F.expr(f"cast(ceil(m / {BLOCK}D) as int)"))
    dealt = dealt.withColumn("own", F.expr("pmod(xxhash64(id), of)")).join(sets, "id")
    dealt = dealt.withColumn("other", F.explode(F.expr("sequence(0, of - 1)")))
    dealt = dealt.select("v", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "own", "id", "n", "i", "c", "items")
    left, right = (dealt.select([F.col(c).alias(f"{c}_{s}") for c in dealt.columns]) for s in "ab")
    same = (F.col("v_a") == F.col("v_b")) & (F.col("p_a") == F.col("p_b")) & (F.col("q_a") == F.col("q_b"))
    met = (F.col("id_a") < F.col("id_b")) & (F.col("c_a") != F.col("c_b")) & ((F.col("p_a") == F.col("q_a")) | (F.col("own_a") != F.col("own_b")))
    place = F.expr(f"least(n_a - i_a, n_b - i_b) >= {_alpha(percent, 'n_a', 'n_b')}")
    found = left.join(right, same & met & place & _jaccard("items_a", "items_b", percent))
    return found.select(F.col("id_a").alias("a"), F.col("id_b").alias("b")).distinct()
