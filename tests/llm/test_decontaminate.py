import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from folioscope.llm import decontaminate, wordset
from tests.llm.conftest import frame


def words(t):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(texts, items):
    out = []
    for i, t in enumerate(texts):
        w, hit, of = words(t), set(), set()
        for item, text in items:
            v = words(text)
            n = min(len(v), 10)
            wins = {tuple(v[j : j + n]) for j in range(len(v) - n + 1)} if n else set()
            for j in range(len(w) - n + 1 if n else 0):
                if tuple(w[j : j + n]) in wins:
                    hit |= set(range(j, j + n))
                    of.add(str(item))
        out.append((i, len(w), len(hit), len(of), hashlib.sha256(",".join(sorted(of)).encode()).hexdigest(), bool(hit)))
    return out


def fixture():
    rng = random.Random(9)
    v = [f"w{i}" for i in range(12)] + ["The", "ÑANDÚ", "été", "ΑΣ"]
    text = lambda n: " ".join(rng.choice(v) + rng.choice(["", ",", ".", " -"]) for _ in range(n))
    items = [(k, text(rng.randint(1, 30))) for k in range(20)] + [(100, None), (101, ""), (102, "..."), (103, "solo"), (104, text(25))]
    items.append((105, items[-1][1]))
    texts = [None, "", "...", "SOLO solo", *[text(rng.randint(0, 60)) + " " + items[rng.randrange(20)][1].upper() + " " + text(5) for _ in range(40)], items[0][1], text(5000)]
    return texts, items


def test_equals_brute_force(spark):
    texts, items = fixture()
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("start", F.lit(1))
    got = sorted(tuple(r) for r in decontaminate.contamination(frame(spark, texts).withColumn("length", F.lit(2)), bench).collect())
    assert got == brute(texts, items) and sum(r[5] for r in got) > 10


@pytest.mark.parametrize("slots", [1, 7])
def test_a_full_filter_finds_the_same(spark, monkeypatch, slots):
    monkeypatch.setattr(wordset, "SLOTS", slots)
    texts, items = fixture()
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = frame(spark, texts).repartition(5)
    assert sorted(tuple(r) for r in decontaminate.contamination(docs, bench).collect()) == brute(texts, items)


def test_a_benchmark_of_many_words(spark):
    """More distinct prefix tokens than fit into a plan as constants, over rows without a fixed order."""
    bench = spark.range(9_000).select(F.col("id").alias("item_id"), F.expr("array_join(transform(sequence(0, 11), i -> concat('t', id * 12 + i)), ' ')").alias("text"))
    texts = [f"a b {' '.join(f't{j}' for j in range(12 * k + 1, 12 * k + 12))} c" for k in range(0, 9000, 100)] + ["t1 t2 t3"] * 5
    got = decontaminate.contamination(frame(spark, texts).repartition(7), bench).toPandas().sort_values("doc_id")
    assert got.n_hit.tolist() == [11] * 90 + [0] * 5 and got.n_items.tolist() == [1] * 90 + [0] * 5


def test_the_rarest_word_of_the_corpus_is_the_prefix(spark):
    from folioscope.llm.shared import Scratch

    bench = spark.createDataFrame([(1, "rare common odd")], "item_id long, text string")
    docs = frame(spark, ["rare rare rare", "Common", "odd odd"])
    got = decontaminate.with_prefixes(decontaminate.windows_of(bench, 10), docs, Scratch(spark, "t")).first()
    assert (got.token, got.offset) == ("common", 1)


def test_clean_rows_keep_all_columns(spark, empty_docs):
    texts, items = fixture()
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = frame(spark, texts)
    kept = decontaminate.clean_rows(docs.union(docs).withColumnRenamed("source", "digest"), bench).withColumnRenamed("digest", "source")
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted([r[0] for r in brute(texts, items) if not r[5]] * 2)
    assert decontaminate.contamination(empty_docs, bench).count() == 0
    none = bench.where("false")
    assert {r.n_hit for r in decontaminate.contamination(docs, none).collect()} == {0}


def test_only_built_in_operators_run(spark):
    texts, items = fixture()
    plan = decontaminate.contamination(frame(spark, texts), spark.createDataFrame(items, "item_id long, text string"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan.split("Physical Plan")[1])
