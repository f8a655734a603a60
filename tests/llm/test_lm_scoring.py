import math
import re
from collections import Counter

import pytest

from folioscope.llm import lm_scoring
from tests.llm.conftest import frame


def brute(rows, good, vocabulary):
    """(doc_id, n, target loss, background loss) of (doc_id, text), from strings; a row's own counts are taken out of the models that hold it."""
    split = [(i, [w.lower() for w in re.findall(r"[^ \t\n\x0b\x0c\r]+", t or "")]) for i, t in rows]
    parts = lambda w: (Counter(w), Counter([None, *w[:-1]]), Counter(zip([None, *w[:-1]], w, strict=True))) if w else (Counter(), Counter(), Counter())
    models = [[Counter(), Counter(), Counter()] for _ in range(2)]
    for i, w in split:
        for m in models[0 if i in good else 1 :]:
            for c, own in zip(m, parts(w), strict=True):
                c.update(own)
    out = []
    for i, w in split:
        losses, own = [], parts(w)
        for k, m in enumerate(models):
            words, heads, pairs = ((lambda x, c=c, o=o: c[x] - o[x]) if k or i in good else (lambda x, c=c: c[x]) for c, o in zip(m, own, strict=True))
            total = sum(m[0].values()) - (len(w) if k or i in good else 0) + 0.5 * vocabulary
            losses.append(sum(-math.log((pairs((a, b)) + 200 * (words(b) + 0.5) / total) / (heads(a) + 200)) for a, b in zip([None, *w[:-1]], w, strict=True)) / len(w) if w else None)
        out.append((i, len(w), *losses))
    return out


def test_equals_brute_force(spark, odd_texts):
    """Nulls, blanks, a very long text, copies; the target's ids repeat."""
    texts = [*[t for t in odd_texts if t is None or t.isascii()], "the same", "the same", "the same again", "the other"]
    good = {i for i in range(len(texts)) if i % 3 == 0}
    target = spark.createDataFrame([(i,) for i in good] * 2 + [(None,), (10**6,)], "doc_id long")
    got = lm_scoring.score_documents(frame(spark, texts).repartition(4), target).orderBy("doc_id").collect()
    for r, (i, n, of_target, of_all) in zip(got, brute(list(enumerate(texts)), good, 1 << 16), strict=True):
        assert (r.doc_id, r.n_tokens) == (i, n)
        assert (r.target_loss, r.background_loss) == (None, None) if not n else (pytest.approx(of_target, rel=1e-6), pytest.approx(of_all, rel=1e-6))
        assert r.difference == (None if not n else pytest.approx(of_target - of_all, abs=1e-6))


def test_a_row_is_scored_as_if_it_were_not_there(spark):
    texts = ["alpha beta gamma delta"] * 3 + ["noise static hum buzz"] * 3
    one = frame(spark, ["odd words here"], first=50)
    alone, known = (lm_scoring.score_documents(frame(spark, texts).union(one), frame(spark, texts).where(where)).where("doc_id = 50").first() for where in ("doc_id < 3", "doc_id < 3 or doc_id = 50"))
    both = lm_scoring.score_documents(frame(spark, texts).union(one), frame(spark, texts).where("doc_id < 3").union(one)).where("doc_id = 50").first()
    assert alone.target_loss == known.target_loss == both.target_loss
    twice = lm_scoring.score_documents(frame(spark, texts).union(one).union(one), frame(spark, texts).where("doc_id < 3")).where("doc_id = 50").collect()
    assert len(twice) == 2 and twice[0] == twice[1] and twice[0].difference > alone.difference


def test_target_like_text_scores_lower(spark, empty_docs):
    texts = ["alpha beta gamma delta"] * 30 + ["noise static hum buzz"] * 30 + ["alpha beta gamma", "static hum buzz"]
    got = {r.doc_id: r.difference for r in lm_scoring.score_documents(frame(spark, texts), frame(spark, texts).where("doc_id < 30")).collect()}
    assert got[60] < 0 < got[61]
    none = lm_scoring.score_documents(frame(spark, texts), empty_docs).collect()
    assert len({round(r.target_loss, 9) for r in none}) == 1
    assert lm_scoring.score_documents(empty_docs, empty_docs).count() == 0
