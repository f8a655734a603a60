import random

import pytest
from pyspark.sql import functions as F

from folioscope.llm import near_dedup
from tests.llm.conftest import frame

BLANK = " \t\n\x0b\x0c\r"


def brute(rows, percent, width):
    """doc_id: shingles, component by comparing all pairs of sets."""
    sets = []
    for _, t in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        for b in BLANK:
            low = low.replace(b, " ")
        w = [x for x in low.split(" ") if x]
        sets.append(frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else []))
    different = list({s for s in sets if s})
    root = {s: s for s in different}

    def find(s):
        while root[s] is not s:
            s = root[s]
        return s

    for i, a in enumerate(different):
        for b in different[:i]:
            if 100 * min(len(a), len(b)) >= percent * max(len(a), len(b)) and 100 * len(a & b) >= percent * len(a | b):
                root[find(a)] = find(b)
    low = {}
    for (i, _), s in zip(rows, sets, strict=True):
        if s:
            low[find(s)] = min(low.get(find(s), i), i)
    return sorted((i, len(s), low[find(s)] if s else i) for (i, _), s in zip(rows, sets, strict=True))


def check(spark, texts, percent, width):
    rows = list(enumerate(texts))
    got = near_dedup.near_duplicates(frame(spark, texts).repartition(3), percent, width).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows, percent, width)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


@pytest.mark.parametrize(("percent", "width"), [(85, 3), (80, 5)])
def test_equals_all_pairs(spark, odd_texts, percent, width):
    check(spark, odd_texts, percent, width)


def test_large_group_goes_through_long_lists(spark, monkeypatch):
    """Many edited copies: lists beyond SHORT_LIST, deep lists and blocks, with links and near misses."""
    monkeypatch.setattr(near_dedup, "SHORT_LIST", 8)
    monkeypatch.setattr(near_dedup, "BLOCK", 20)
    rng, texts = random.Random(5), []
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(90)]
    for copy in range(150):
        words = list(base)
        for _ in range(rng.choice([1, 2, 3, 4, 6])):
            words[rng.randrange(90)] = rng.choice(["the", "of", f"n{copy}"])
        texts.append(" ".join(words))
    texts += [" ".join(base[:20] + [f"u{i}x{j}" for j in range(60)]) for i in range(60)]
    check(spark, texts, 85, 3)


def test_chain_of_versions(spark):
    words = [f"a{i}" for i in range(200)]
    check(spark, [" ".join(words[i : i + 120]) for i in range(0, 60, 3)], 85, 3)


def test_no_rows_repeated_ids_and_nulls(spark, empty_docs):
    assert near_dedup.near_duplicates(empty_docs, 85, 3).count() == 0
    docs = spark.createDataFrame([(7, "a b c d"), (7, "a b c d"), (7, "e f g h"), (None, "a b c d"), (None, None), (3, "A  B\tc d")], "doc_id long, text string").withColumn("digest", F.lit(0))
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(docs, 85, 3).collect()), key=str)
    assert got == sorted([(7, 2, 3, False), (7, 2, 3, False), (7, 2, 7, True), (None, 2, 3, False), (None, 0, None, True), (3, 2, 3, True)], key=str)
