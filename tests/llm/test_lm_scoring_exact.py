import random

import numpy as np

from folioscope.llm import lm_scoring
from tests.llm.conftest import frame
from tests.llm.test_lm_scoring import brute


def test_more_words_than_slots_equal_real_strings(spark, monkeypatch):
    """80,000 different words in several blocks, counted by their strings: words or pairs that share a count would show."""
    monkeypatch.setattr(lm_scoring, "BLOCK", 100_000)
    rng = random.Random(9)
    names = [f"w{i}" for i in range(80_000)]
    texts = [" ".join(names[i : i + 2000]) for i in range(0, 80_000, 2000)] + [" ".join(rng.choice(names[:50]) for _ in range(400)) for _ in range(60)]
    ids = [None if i % 7 == 0 else i % 50 for i in range(len(texts))]
    docs = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").repartition(3)
    good = {i for i in range(50) if i % 3 == 0}
    got = lm_scoring.score_documents(docs, spark.createDataFrame([(i,) for i in good], "doc_id long")).collect()
    want = [(-1 if r[0] is None else r[0], *r[1:]) for r in brute(list(zip(ids, texts, strict=True)), good, 80_000)]
    found = sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.target_loss, r.background_loss) for r in got)
    assert np.allclose(found, sorted(want), rtol=1e-9)


def test_texts_without_words_keep_their_rows(spark):
    got = lm_scoring.score_documents(frame(spark, [None, "", " \n"]), frame(spark, ["x"])).collect()
    assert len(got) == 3 and all(r.n_tokens == 0 and r.difference is None for r in got)
