import zlib

from pyspark.sql import functions as F

from folioscope.llm.sharding import shard_by_bytes


def brute(rows, shards):
    sizes = [(i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows]
    total, done, out, seen = sum(s for _, s, _ in sizes), 0, [], {}
    for i, s, c in sizes:
        shard = (2 * done + s) * shards // (2 * total)
        out.append((i, s, c, shard, seen.setdefault(shard, 0)))
        seen[shard] += 1
        done += s
    return out


def test_equals_running_sum(spark, odd_docs, odd_texts):
    got = shard_by_bytes(odd_docs.repartition(5), 4).orderBy("doc_id").collect()
    want = brute(list(enumerate(odd_texts)), 4)
    assert [(r.doc_id, r["size"], r.text_crc32, r.shard, r.slot) for r in got] == want
    assert {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None}


def test_balance_and_slots(spark):
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.expr("repeat('ab', cast(id % 37 as int))").alias("text"), F.lit(1).alias("size"), F.lit("x").alias("shard"))
    got = shard_by_bytes(docs, 24).toPandas()
    sums = got.groupby("shard")["size"].sum()
    assert len(sums) == 24 and sums.max() - sums.min() <= 2 * got["size"].max()
    for _, part in got.sort_values(["shard", "slot"]).groupby("shard"):
        assert list(part.slot) == list(range(len(part))) and part.doc_id.is_monotonic_increasing


def test_repeated_null_and_no_rows(spark, empty_docs):
    assert shard_by_bytes(empty_docs).count() == 0
    docs = spark.createDataFrame([(None, "a"), (1, None), (1, "b"), (1, "b"), (None, None)], "doc_id long, text string")
    got = shard_by_bytes(docs, 3).collect()
    assert len(got) == 5 and sorted(r["size"] for r in got) == [8, 8, 9, 9, 9]
    assert [r.doc_id for r in sorted(got, key=lambda r: (r.shard, r.slot))] == [None, None, 1, 1, 1]
