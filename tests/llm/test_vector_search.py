import math
import random

import pytest
from pyspark.sql import functions as F

from folioscope.llm import vector_search

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, every, k):
    good = {}
    for i, v, _ in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            good.setdefault((i, tuple(math.floor(256 * x) for x in v)), 1)
    out = {}
    for q, vec in good:
        if q % every == 0:
            near = sorted({(-sum(a * b for a, b in zip(vec, w, strict=False)), c) for c, w in good if c != q})
            out.setdefault(q, []).extend(near)
    best = {}
    for q, near in out.items():
        top = {}
        for s, c in near:
            top[c] = min(s, top.get(c, s))
        best[q] = sorted((s, c) for c, s in top.items())[:k]
    return sorted((q, r + 1, c, -s) for q, near in best.items() for r, (s, c) in enumerate(near))


def rows(n, dims=6, copies=0):
    rng = random.Random(n)
    out = [(i, [float(rng.randint(-300, 300)) / 256 for _ in range(dims)], 0) for i in range(n)]
    return out + [(n + i, [1.0] * dims, 0) for i in range(copies)]


@pytest.mark.parametrize("data", [
    rows(300), rows(40, 2, 60), rows(3), [],
    [*rows(30), (None, [1.0] * 6, 1), (50, None, 1), (100, [1.0, None] + [0.0] * 4, 1), (150, [float("nan")] * 6, 1), (200, [float("inf")] * 6, 1), (250, [], 1), (300, [1.0, 2.0], 1)],
    [*rows(60), *rows(60)],
    # An id with many different vectors is a query and a candidate.
    [*rows(25), *[(10, v, 0) for _, v, _ in rows(90, 5)], *[(13, v, 0) for _, v, _ in rows(80)]],
    [(i, [], 0) for i in range(12)],
])
def test_equals_brute_force(spark, data, monkeypatch):
    monkeypatch.setattr(vector_search, "VECTOR_BLOCK", 16)
    monkeypatch.setattr(vector_search, "QUERY_BLOCK", 4)
    table = spark.createDataFrame(data, SCHEMA).repartition(3).withColumn("score", F.lit("x")).withColumn("rank", F.lit(0))
    assert sorted(tuple(r) for r in vector_search.top_k(table, every=10, k=5).collect()) == brute(data, 10, 5)


def test_more_query_rows_of_one_id_than_any_block(spark):
    data = [(50, [float(i % 97) / 97, float(i) / 9000], 0) for i in range(9000)] + [(i, [1.0, i / 7], 0) for i in range(1, 8)]
    table = spark.createDataFrame(data, SCHEMA)
    assert sorted(tuple(r) for r in vector_search.top_k(table).collect()) == brute(data, 50, 5)


def test_no_exact_vector_meets_the_scan(spark):
    """The scan's rows hold cells of one byte a component, and few pairs are left for the exact vectors."""
    from folioscope.llm.shared import Scratch

    kept = []
    keep = Scratch.keep

    def spy(self, df):
        out = keep(self, df)
        kept.append((df.columns, out.count()))
        return out

    try:
        Scratch.keep = spy
        vector_search.top_k(spark.createDataFrame(rows(3000, 16), SCHEMA)).count()
    finally:
        Scratch.keep = keep
    assert ["block", "ids", "rows", "cells"] in [c for c, _ in kept]
    left = next(n for c, n in kept if "place" in c)
    assert left < 60 * 60
