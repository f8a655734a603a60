import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from folioscope.llm import language_id
from tests.llm.conftest import frame

TEXTS = {
    "de": ["der hund und die katze sind nicht im haus", "ich habe das buch auf den tisch gelegt", "wir gehen heute in die schule und lernen"],
    "en": ["the dog and the cat are not in the house", "she put the book on the table this morning", "we are going to school today and learning"],
    "fr": ["le chien et le chat ne sont pas dans la maison", "elle a mis le livre sur la table ce matin", "nous allons au marché aujourd'hui avec eux"],
    "es": ["el perro y el gato no están en la casa", "ella puso el libro sobre la mesa por la mañana", "hoy vamos a la escuela para aprender mucho"],
}


def corpus(spark):
    rows = [(t, k) for k in TEXTS for t in TEXTS[k] * 12]
    return frame(spark, [t for t, _ in rows], [k for _, k in rows], [f"www.{k}-site.{'com' if k == 'en' else k}" for _, k in rows])


def test_text_wins_over_a_wrong_declaration(spark):
    docs = corpus(spark)
    odd = frame(spark, ["the cat put the book on the table and the dog is going to the house today " * 3], ["fr"], ["www.en-site.com"], 1000)
    got = {r.doc_id: r for r in language_id.identify(docs.union(odd)).collect()}
    assert all(r.language == r.lang and r.accepted for i, r in got.items() if i < 1000)
    assert got[1000].language == "en" and got[1000].accepted


def test_weak_text_follows_declaration_and_host(spark):
    docs = corpus(spark)
    weak = frame(spark, ["ok", "ok"], ["de", None], ["www.de-site.de", "www.fr-site.fr"], 1000)
    got = {r.doc_id: r.language for r in language_id.identify(docs.union(weak)).where("doc_id >= 1000").collect()}
    assert got == {1000: "de", 1001: "fr"}


def test_trigram_counts_equal_brute_force(spark):
    docs, languages = corpus(spark), ["de", "en", "es", "fr"]
    logs = language_id.text_model(docs.repartition(3), F.col("lang"), languages)
    counts = np.zeros((4, language_id.SLOTS))
    for r in docs.collect():
        slot, _ = language_id._trigrams(np.frombuffer(r.text.encode(), np.uint8), np.array([0, len(r.text.encode())]))
        np.add.at(counts[languages.index(r.lang)], slot, 1)
    counts += np.minimum(0.05, 0.01 * counts.sum(1, keepdims=True) / language_id.SLOTS)
    assert np.allclose(logs, np.log(counts / counts.sum(1, keepdims=True)), atol=1e-4)


def test_odd_rows(spark, odd_docs, odd_texts, empty_docs):
    got = language_id.identify(odd_docs.withColumn("posterior", F.lit("x")).withColumn("source", F.lit(None).cast("string"))).orderBy("doc_id").collect()
    assert len(got) == len(odd_texts) and [r.accepted for r in got[:3]] == [False] * 3
    assert all(abs(r.posterior) <= 1.000001 for r in got)
    assert language_id.identify(empty_docs).count() == 0
    assert isinstance(pa.array([1]), pa.Array)
