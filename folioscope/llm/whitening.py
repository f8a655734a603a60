"""Whitening of embeddings from an exact integer scatter matrix."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.shared import Scratch, bound_batches

#: Products of numbers of so many bits, added up over so many rows, are exact in doubles: 2 * 19 + 12 bits.
LIMB, ROWS = 20, 4096
#: Sums of tasks travel as digits of so many bits, so that a long holds the sum of 2**31 of them.
DIGIT = 32
#: An eigenvalue below this share of the largest is rounding, and its direction has no spread.
FLAT = 1e-13


def integer_rows(ids: pa.Array, column: pa.Array, scale: int) -> tuple[pa.Array, np.ndarray]:
    """The ids of the rows whose vector is there and finite, and floor(scale * entry) as longs; missing entries of shorter vectors are 0.

    An entry that no long holds counts as the nearest one, with 2**21 of room.
    """
    column = column.cast(pa.list_(pa.float64()))
    at, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    sizes, odd = np.diff(at), np.append(0, np.cumsum(~np.isfinite(flat)))
    keep = (odd[at[1:]] == odd[at[:-1]]) & column.is_valid().to_numpy(zero_copy_only=False)
    sizes = sizes[keep]
    own = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(own)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out, most = np.zeros((len(sizes), int(sizes.max(initial=0))), np.int64), float(2**63 - 2**21)
    out[own, place] = np.clip(np.floor(scale * flat[np.repeat(at[:-1][keep], sizes) + place]), -most, most).astype(np.int64)
    return ids.filter(pa.array(keep)), out


def scatter(y: np.ndarray) -> dict[tuple[int, int], int]:
    """The sums of y's columns at (-1, i) and of their products at (i, j), i <= j, as exact integers; its rows at (-1, -1)."""
    n, dims = y.shape
    out: dict[tuple[int, int], int] = {(-1, -1): n}
    # A column of ones gives the plain sums.
    y = np.concatenate([np.ones((n, 1), np.int64), y], 1)
    limbs, rest = [], y
    while not limbs or rest.any():
        low = ((rest + (1 << LIMB - 1)) & ((1 << LIMB) - 1)) - (1 << LIMB - 1)
        limbs.append(low.astype(float))
        rest = (rest - low) >> LIMB
    total = np.zeros((dims + 1, dims + 1), object)
    for a, left in enumerate(limbs):
        for b, right in enumerate(limbs):
            exact = np.zeros((dims + 1, dims + 1), np.int64)  # 2**13 blocks of 2**50 at most: batches are shorter by far
            for i in range(0, n, ROWS):
                exact += (left[i : i + ROWS].T @ right[i : i + ROWS]).astype(np.int64)
            total = total + exact.astype(object) * (1 << LIMB * (a + b))
    for i in range(dims + 1):
        for j in range(max(i, 1), dims + 1):
            out[i - 1, j - 1] = int(total[i, j])
    return out


def exact_scatter(table: DataFrame, scale: int, offset: int) -> tuple[int, list[int], np.ndarray]:
    """n, the sums S of x = floor(scale * entry) + offset by dimension, and n * XtX - S St, as integers of any size.

    The scatter does not change when ``offset`` is subtracted, which keeps the sums short and makes missing entries 0. Each task adds up its rows and
    sends the digits of its sums, so one row for each pair of dimensions and digit leaves a task, and as many reach the driver.
    """

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], int] = {}
        for batch in batches:
            for key, value in scatter(integer_rows(batch.column(0), batch.column(1), scale)[1]).items():
                sums[key] = sums.get(key, 0) + value
        cells = []
        for (i, j), value in sums.items():
            sign, rest, place = (-1 if value < 0 else 1), abs(value), 0
            while rest or not place:
                cells.append((i, j, place, sign * (rest & ((1 << DIGIT) - 1))))
                rest, place = rest >> DIGIT, place + 1
        columns = zip(*cells, strict=True) if cells else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int32(), pa.int64()), strict=True)], names=["i", "j", "place", "digit"])

    got = table.mapInArrow(added, "i int, j int, place int, digit long").groupBy("i", "j", "place").agg(F.sum("digit").alias("digit")).toArrow().to_pydict()
    sums: dict[tuple[int, int], int] = {}
    for i, j, place, digit in zip(*(got[c] for c in ("i", "j", "place", "digit")), strict=True):
        sums[i, j] = sums.get((i, j), 0) + (digit << (DIGIT * place))
    n, dims = sums.get((-1, -1), 0), max([-1, *(j for _, j in sums)]) + 1
    s = [sums[-1, i] for i in range(dims)]
    centred = np.zeros((dims, dims), object)
    for i in range(dims):
        for j in range(i, dims):
            centred[i, j] = centred[j, i] = n * sums.get((i, j), 0) - s[i] * s[j]
    return n, [x + n * offset for x in s], centred


def decompose(n: int, centred: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray, float]:
    """The largest eigenvalues of centred / n**2, falling, their unit vectors as columns, and the trace."""
    covariance = np.array([[x / (n * n) for x in row] for row in centred], float)  # Python divides integers with one rounding
    values, vectors = np.linalg.eigh(covariance)
    order = np.argsort(-values, kind="stable")[:components]
    return values[order], vectors[:, order], sum(centred[i, i] for i in range(len(centred))) / (n * n)


def whiten(table: DataFrame, components: int = 8, scale: int = 1024, offset: int = 100000) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error and deviation_text, one row for each vector and component.

    ``table`` has vec_id and embedding; further columns are ignored. Rows whose vector is null or holds null or non-finite
    entries go; others stay, repeated ones and those without a vec_id as well. x = floor(scale * entry) + offset; the covariance V of all x-vectors comes from
    exact integers, n * XtX - S St, which become doubles only then. deviation is the sum of (n * x - S)**2 over the dimensions: null where no
    long holds it, while deviation_text has the digits of any. whitened is the component of x - S / n by eigenvalue, with variance 1, explained
    its share of the trace, identity_error the largest entry of |cov(whitened) - 1|, measured on all rows that are returned.

    A component without spread (all vectors alike, fewer vectors than components, or under FLAT of the largest eigenvalue, which is rounding) has a null whitened value and explains nothing; it does not
    count in identity_error. With fewer dimensions than ``components`` there are as many as dimensions. A vector that is shorter than the
    longest has entries of 0 in its place. An entry beyond a long counts as the nearest that fits. Equal vectors get equal values; empty tables, or
    vectors of no dimension, give no rows.

    Two readings of the vectors, and no shuffle of them: only sums of tasks and the covariance of the result move.
    """
    spark, scratch = table.sparkSession, Scratch(table.sparkSession, "white")
    bound_batches(spark)
    table = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    n, s, centred = exact_scatter(table, scale, offset)
    dims = len(s)
    fields = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_text string"
    if not dims:
        return spark.createDataFrame([], fields)
    values, vectors, trace = decompose(n, centred, components)
    spread = values > FLAT * max(values[0], 0.0)
    turn = np.where(spread, vectors / np.sqrt(np.where(spread, values, 1.0)), 0.0)
    whole, rest = zip(*(divmod(x, n) for x in s), strict=True)
    part = np.array([r / n for r in rest])

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, y = integer_rows(batch.column(0), batch.column(1), scale)
            y = np.concatenate([y, np.zeros((len(y), dims - y.shape[1]), np.int64)], 1)
            # n * x - S = n * (x - whole) - rest, in integers of any size where a long does not hold the squares.
            wide = int(np.abs(y).max(initial=0)) >= 1 << 61 or max(map(abs, whole)) >= 1 << 61
            d = (y.astype(object) if wide else y) - np.array([w - offset for w in whole], object if wide else np.int64)
            far = int(np.abs(d).max(initial=0)) + 1
            if dims * (n * far) ** 2 < 2**63:
                deviation = ((n * d - np.array(rest)) ** 2).sum(1).tolist()
            elif dims * far * far < 2**62 and dims * far < 2**31:
                # (n d - r)**2 = n n dd - 2 n dr + rr, with r in two halves, so that only three numbers of a row leave the longs.
                high, low = np.array([r >> 31 for r in rest]), np.array([r & (2**31 - 1) for r in rest])
                rr = sum(r * r for r in rest)
                deviation = [n * n * dd - 2 * n * ((a << 31) + b) + rr for dd, a, b in zip((d * d).sum(1).tolist(), (d @ high).tolist(), (d @ low).tolist(), strict=True)]
            else:
                deviation = [sum((n * x - r) ** 2 for x, r in zip(row, rest, strict=True)) for row in d.tolist()]
            white = (d.astype(float) - part) @ turn
            listed = pa.ListArray.from_arrays(np.arange(len(white) + 1, dtype=np.int32) * white.shape[1], white.ravel())
            yield pa.RecordBatch.from_arrays([ids, pa.array([x if x < 2**63 else None for x in deviation], pa.int64()), pa.array(map(str, deviation), pa.string()), listed], names=["vec_id", "deviation", "deviation_text", "w"])

    wide = scratch.keep(table.mapInArrow(placed, "vec_id long, deviation long, deviation_text string, w array<double>"))
    use = [i for i in range(len(values)) if spread[i]]
    pairs = [(i, j) for i in use for j in use if i <= j]
    # covar_pop centres as it goes on, and combines centred sums.
    got = wide.agg(*[F.covar_pop(F.get("w", F.lit(i)), F.get("w", F.lit(j))).alias(f"c{i}_{j}") for i, j in pairs]).first() if pairs else []
    error = max((abs(c - (i == j)) for c, (i, j) in zip(got, pairs, strict=True)), default=None)
    of = lambda numbers: F.array(*[F.lit(x).cast("double") for x in numbers])
    explained = of([float(v / trace) if ok else 0.0 for v, ok in zip(values, spread, strict=True)])
    out = wide.select("vec_id", "deviation", "deviation_text", F.posexplode("w").alias("i", "value"))
    white = F.when(F.get(F.array(*[F.lit(bool(ok)) for ok in spread]), F.col("i")), F.col("value"))
    return out.select("vec_id", (F.col("i") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", white.alias("whitened"), F.get(explained, F.col("i")).alias("explained"), F.lit(error).cast("double").alias("identity_error"), "deviation_text")
