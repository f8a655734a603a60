import random
import zlib

from pyspark.sql import functions as F

from folioscope.llm import toxicity
from tests.llm.conftest import frame


def corpus(n=900):
    rng, bad = random.Random(2), ["scum", "idiot", "moron"]
    texts, toxic = [], []
    for _ in range(n):
        t, words = rng.random() < 0.15, [f"w{rng.randint(0, 400)}" for _ in range(rng.randint(5, 120))]
        words[: 2 * t] = rng.choices(bad, k=2 * t)
        rng.shuffle(words)
        texts.append(" ".join(words))
        toxic.append(int(t))
    return texts, toxic


def test_held_out_quality_and_folds(spark):
    texts, toxic = corpus()
    labels = spark.createDataFrame([(i, 1, t) for i, t in enumerate(toxic) if i % 2], "doc_id long, quality int, toxic int")
    got = toxicity.score_documents(frame(spark, texts), labels).toPandas()
    assert [bool(x) for x in got.held_out] == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]
    assert got.score.between(0, 1).all() and ((got.score >= 0.5).astype(int) == got.predicted).all()
    found = toxicity.held_out_quality(got, labels.toPandas())
    assert found["auc"] > 0.97 and found["accuracy"] > 0.95


def test_held_out_labels_change_nothing(spark):
    texts, toxic = corpus(300)
    rows = [(i, 1, t) for i, t in enumerate(toxic)]
    turned = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, q, t in rows]
    a, b = (toxicity.score_documents(frame(spark, texts), spark.createDataFrame(r, "doc_id long, quality int, toxic int")).toPandas() for r in (rows, turned))
    assert a.equals(b)


def test_odd_rows(spark, odd_docs, odd_texts, empty_docs):
    none = spark.createDataFrame([(None, None, None)], "doc_id long, quality int, toxic int")
    got = toxicity.score_documents(odd_docs.withColumn("score", F.lit("x")), none).collect()
    assert len(got) == len(odd_texts) and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score_documents(empty_docs, none).count() == 0


def test_a_repeated_confirmed_id_does_not_crowd_out_the_others(spark):
    texts, toxic = corpus(400)
    labels = spark.createDataFrame([(i, 1, t) for i, t in enumerate(toxic)], "doc_id long, quality int, toxic int")
    docs, hot = frame(spark, texts), next(i for i, t in enumerate(toxic) if t and zlib.crc32(str(i).encode()) % 5)
    more = spark.range(600).select(F.lit(hot).cast("long").alias("doc_id"), F.concat(F.lit("scum again "), F.col("id") % 7).alias("text"))
    both = docs.select("doc_id", "text").union(more)
    weights = [toxicity.train(d, labels).weights for d in (both, both.repartition(7).orderBy(F.desc("text")))]
    assert (weights[0] == weights[1]).all()
    got = toxicity.score_documents(both, labels).where(F.col("doc_id") != hot).toPandas()
    assert toxicity.held_out_quality(got, labels.toPandas())["auc"] > 0.95


def test_counts_over_all_other_rows(spark):
    texts, toxic = corpus(60)
    confirmed = spark.createDataFrame([(i,) for i, t in enumerate(toxic) if t], "doc_id long")
    others, n = toxicity._others(frame(spark, texts).select("doc_id", "text"), confirmed)
    trained = [i for i in range(60) if zlib.crc32(str(i).encode()) % 5 and not toxic[i]]
    words = sum(len(set(texts[i].split())) for i in trained)
    assert n == len(trained) and 0.99 * words < others.sum() <= words  # two words of a row may share a feature
