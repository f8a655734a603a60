"""Contiguous shards of nearly equal bytes from global prefix sums."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.shared import shared_dir


def shard_by_bytes(docs: DataFrame, shards: int = 24, overhead: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard for every row of ``docs`` (doc_id, text; other columns are ignored).

    Rows in the order of doc_id (nulls first, repeated ids in the order read) are cut into ``shards`` runs: a row whose
    middle byte lies in the i-th of equal parts of all bytes is in shard i, so a shard misses its target by less than a
    row at each end. size is the UTF-8 bytes of the text plus ``overhead``; a null text has none (its crc32 is 0, that of
    no bytes). slot counts a shard's rows from 0. An empty table gives no rows; more shards than rows leave some empty.

    One range partitioning of small rows (no texts) is frozen by a checkpoint. Each partition's totals, one row for each,
    become its start by a running sum; inside a partition the sums go on batch by batch.
    """
    spark = docs.sparkSession
    shared_dir(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.coalesce(F.octet_length("text"), F.lit(0)) + overhead).cast("long").alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"))
    rows = rows.withColumn("seen", F.monotonically_increasing_id())
    # Two columns, so that no repeated id can fill a partition.
    frozen = rows.repartitionByRange("doc_id", "seen").sortWithinPartitions("doc_id", "seen").drop("seen").checkpoint().withColumn("part", F.spark_partition_id())
    totals = frozen.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    starts = totals.select("part", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("bytes", "rows")], F.sum("bytes").over(whole).alias("all"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = {}
        for batch in batches:
            ids, size, crc, part, at, row, total = (c for c in batch.columns)
            sizes, parts = size.to_numpy(), part.to_numpy()
            edges = np.flatnonzero(np.diff(parts)) + 1
            shard, place = np.empty(len(sizes), np.int32), np.empty(len(sizes), np.int64)
            for a, b in zip([0, *edges], [*edges, len(sizes)], strict=True):
                if a == b:
                    continue
                base, first = done.get(parts[a], (at[int(a)].as_py(), row[int(a)].as_py()))
                ends = base + np.cumsum(sizes[a:b])
                shard[a:b] = (2 * ends - sizes[a:b]) * shards // (2 * total[int(a)].as_py())
                place[a:b] = np.arange(first, first + b - a)
                done[parts[a]] = (int(ends[-1]), first + b - a)
            yield pa.RecordBatch.from_arrays([ids, size, crc, pa.array(shard), pa.array(place)], names=["doc_id", "size", "text_crc32", "shard", "place"])

    # One row for each partition of the range partitioning: bounded by spark.sql.shuffle.partitions.
    placed = frozen.join(F.broadcast(starts), "part").select("doc_id", "size", "text_crc32", "part", "bytes_before", "rows_before", "all")
    placed = placed.mapInArrow(cut, "doc_id long, size long, text_crc32 long, shard int, place long")
    # One row for each shard.
    firsts = placed.groupBy("shard").agg(F.min("place").alias("first"))
    out = placed.join(F.broadcast(firsts), "shard")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("place") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
