"""Exact top-k by inner product with a file of vector approximations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.shared import Scratch, bound_batches

#: Queries of a block, vectors of a block of the approximation file, and cells of each dimension (a byte has up to 256).
QUERY_BLOCK, VECTOR_BLOCK, CELLS = 1024, 2048, 64
#: Rows that share a key in the join of survivors with their exact vectors are dealt to so many parts.
SALTS = 16


def integer_vectors(table: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id and vec, where each component x is floor(scale * x); rows with a null or non-finite component go."""
    x = F.transform("embedding", lambda e: e.cast("double"))
    fine = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    return table.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & fine).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda e: F.floor(scale * e)).alias("vec"))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Rows of numbers; a shorter vector is filled up with zeros."""
    flat, at = column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())
    if (at == dims).all():
        return flat.reshape(len(at), dims).astype(np.int64)
    out, rows = np.zeros((len(at), dims), np.int64), np.repeat(np.arange(len(at)), at)
    out[rows, np.arange(len(flat)) - np.repeat(np.cumsum(at) - at, at)] = flat
    return out


def _blocks(rows: DataFrame, size: int, dims: int, content, fields: str) -> DataFrame:
    """block, ids, rows and ``fields``: the rows of each partition, ``size`` at a time, as one row each; content makes the fields of a matrix."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        names = ["block", "ids", "rows", *[f.split()[0] for f in fields.split(", ")]]
        for batch in batches:
            for a in range(0, len(batch), size):
                part = batch.slice(a, size)
                ids, row = (pa.array([part.column(i).to_numpy()], pa.list_(pa.int64())) for i in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array([block]), ids, row, *[pa.array([c], pa.binary()) for c in content(_matrix(part.column(2), dims))]], names=names)
                block += 1

    bound_batches(rows.sparkSession)
    return rows.select("vec_id", "row", "vec").mapInArrow(made, f"block long, ids array<long>, rows array<long>, {fields}")


def _bounded(dims: int, k: int, low: np.ndarray, width: np.ndarray):
    """Of each block of queries with each block of cells: the pairs whose upper bound reaches the k-th best lower bound."""

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for q_ids, q_rows, queries, ids, rows, cells in zip(*(batch.column(i) for i in range(6)), strict=True):
                q_ids, q_rows, ids, rows = (x.values.to_numpy() for x in (q_ids, q_rows, ids, rows))
                q = np.frombuffer(queries.as_py(), np.int64).reshape(len(q_ids), dims).astype(float)
                floor = low + np.frombuffer(cells.as_py(), np.uint8).reshape(len(ids), dims) * width
                up, down = np.maximum(q, 0), np.minimum(q, 0)
                span = np.abs(q) @ (width - 1)
                least = up @ floor.T + down @ (floor + (width - 1)).T
                slack = 1e-12 * (np.abs(q) @ np.maximum(np.abs(low), np.abs(low + CELLS * width)))[:, None]
                own = q_ids[:, None] == ids[None, :]
                least[own] = -np.inf
                # Of each id the best lower bound among its rows, and of each query the k-th best of these.
                order = np.argsort(ids, kind="stable")
                first = np.flatnonzero(np.diff(ids[order], prepend=ids[order[0]] - 1))
                best = np.maximum.reduceat(least[:, order], first, axis=1)
                kth = np.partition(best, len(first) - k, axis=1)[:, len(first) - k] if len(first) >= k else np.full(len(q_ids), -np.inf)
                group = np.empty(len(ids), np.int64)
                group[order] = np.repeat(np.arange(len(first)), np.diff(first, append=len(ids)))
                need = np.maximum(kth[:, None], best[:, group])
                near, at = np.nonzero((least + span[:, None] + 2 * slack >= need) & ~own)
                found = least[near, at]
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[near]), pa.array(q_rows[near]), pa.array(ids[at]), pa.array(rows[at]), pa.array(found - slack[near, 0]), pa.array(found + span[near] + slack[near, 0])], names=["query_id", "query_row", "vec_id", "row", "low", "high"])

    return scanned


def _least(found: DataFrame, score: str, k: int) -> DataFrame:
    """query_id and reach: the k-th best score among different vec_ids, or null where there are fewer."""
    each = found.groupBy("query_id", "vec_id").agg(F.max(score).alias("s"))
    w = Window.partitionBy("query_id").orderBy(F.desc("s"))
    best = each.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k)
    return best.groupBy("query_id").agg(F.min(F.when(F.col("r") == k, F.col("s"))).alias("reach"))


def _exact(found: DataFrame, rows: DataFrame) -> DataFrame:
    """query_id, vec_id and score (of integers) of pairs: only the rows that they name are read on, a frequent one in parts."""
    pairs = found.select("query_id", "query_row", "vec_id", "row").withColumn("salt", F.pmod(F.xxhash64("query_row"), F.lit(SALTS)))
    named = pairs.select("row", "salt").distinct()
    vectors = rows.where("candidate").select("row", F.col("vec").alias("v")).join(named, "row")
    asked = rows.where("not candidate").select(F.col("row").alias("query_row"), F.col("vec").alias("q"))
    return pairs.join(vectors, ["row", "salt"]).join(asked, "query_row").select("query_id", "vec_id", _inner("q", "v").alias("score"))


def _inner(a: str, b: str) -> Column:
    """The inner product of integer arrays; the longer one's surplus counts as nothing."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.coalesce(x * y, F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda s, x: s + x)


def top_k(table: DataFrame, every: int = 50, k: int = 5, scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id and score: for each vec_id divisible by ``every``, the k other rows of highest inner product.

    Ties go to the smaller vec_id; with fewer rows than k, all are returned. Vectors that are null or hold a null, NaN or
    infinite component take no part, an empty table gives no rows. Vectors may differ in length: missing components count as 0. Of a
    vec_id's repeated rows none is returned for its own query; equal rows count once. Further columns are ignored.

    1. Of equal vectors only the k + 1 smallest ids can be among a query's best; a window with a partial limit finds them, so
       a frequent vector is a few rows before the shuffle.
    2. The approximation file is written: a byte for each component, its cell in a grid of CELLS over the range of the dimension.
    3. Each block of queries meets each block of cells, and no exact vector. A pair whose upper bound is below the k-th best
       lower bound of its query is ruled out, first in the block, then over all blocks.
    4. Exact vectors are read in the order of the bounds: the 2 k best pairs of each query give a k-th result; of the other
       pairs, those whose upper bound reaches it are read as well, after which the result is certain.

    Queries are a table in blocks, so their number has no bound; nothing but the grid (two numbers for each dimension) reaches the driver.
    """
    spark, scratch = table.sparkSession, Scratch(table.sparkSession, "topk")
    rows = integer_vectors(table, scale).dropDuplicates(["vec_id", "vec"])
    same = Window.partitionBy("vec").orderBy("vec_id")
    query = F.col("vec_id") % every == 0
    # Of equal vectors the queries stay as well, but as queries alone.
    ranked = rows.withColumn("r", F.row_number().over(same))
    few = ranked.where(F.col("r") <= k + 1).select("vec_id", "vec", F.lit(True).alias("candidate"))
    more = rows.where(query).select("vec_id", "vec", F.lit(False).alias("candidate"))
    kept = scratch.keep(few.union(more).withColumn("row", F.monotonically_increasing_id()))
    dims = kept.agg(F.max(F.size("vec"))).first()[0]
    if dims is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    ends = kept.where("candidate").select(F.posexplode("vec").alias("i", "x")).groupBy("i").agg(F.min("x").alias("lo"), F.max("x").alias("hi")).toArrow()
    low, high = np.zeros((2, dims := max(1, dims)), np.int64)  # an absent component is a 0, so the grid reaches over 0
    low[ends["i"].to_numpy()], high[ends["i"].to_numpy()] = np.minimum(0, ends["lo"].to_numpy()), np.maximum(0, ends["hi"].to_numpy())
    width = -(-(high - low + 1) // CELLS)

    cells = scratch.keep(_blocks(kept.where("candidate"), VECTOR_BLOCK, dims, lambda m: [((m - low) // width).astype(np.uint8).tobytes()], "cells binary"))
    queries = scratch.keep(_blocks(kept.where("not candidate"), QUERY_BLOCK, dims, lambda m: [m.tobytes()], "vectors binary"))
    # Both kinds of blocks are dealt to parts, and each part of the one meets each of the other under a key of its own.
    n_cells, n_queries = cells.count(), queries.count()
    of_cells, of_queries = max(1, min(n_cells, 2 * spark.sparkContext.defaultParallelism), n_cells // 8), max(1, n_queries // 4)
    part = lambda n: F.pmod(F.xxhash64("block"), F.lit(n))
    every_part = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    asked = queries.select(part(of_queries).alias("q_part"), every_part(of_cells).alias("part"), F.col("ids").alias("q_ids"), F.col("rows").alias("q_rows"), "vectors")
    there = cells.select(part(of_cells).alias("part"), every_part(of_queries).alias("q_part"), "ids", "rows", "cells")
    met = asked.hint("merge").join(there, ["q_part", "part"]).select("q_ids", "q_rows", "vectors", "ids", "rows", "cells")
    found = scratch.keep(met.mapInArrow(_bounded(dims, k, low.astype(float), width.astype(float)), "query_id long, query_row long, vec_id long, row long, low double, high double"))

    reach = scratch.hinted(scratch.keep(_least(found, "low", k)))
    order = Window.partitionBy("query_row").orderBy(F.desc("high"), "vec_id", "row")
    left = found.join(reach, "query_id").where("reach is null or high >= reach").drop("reach")
    left = scratch.keep(left.withColumn("place", F.row_number().over(order)))
    first = scratch.keep(_exact(left.where(F.col("place") <= 2 * k), kept))
    certain = scratch.hinted(scratch.keep(_least(first, "score", k)))
    rest = left.where(F.col("place") > 2 * k).join(certain, "query_id").where("reach is null or high >= reach")
    out = scratch.keep(first.union(_exact(rest, kept)).groupBy("query_id", "vec_id").agg(F.max("score").alias("score")))
    scratch.drop_all_but(out)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
