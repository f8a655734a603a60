import hashlib

import corpus_pipeline
import public_tokenizers
import tiktoken

from folioscope.llm import bpe
from tests.llm.conftest import frame
from tests.llm.test_decontaminate import brute as hits
from tests.llm.test_language_id import TEXTS
from tests.llm.test_near_dedup import brute as groups


def test_run_equals_brute_force(spark, tmp_path):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    clean = [(t + f" and {i} more", k) for k in TEXTS for i, t in enumerate(TEXTS[k] * 4)]
    long = "the dog and the cat are not in the house while she put the book on the table this morning and we are going to school"
    texts = [t for t, _ in clean] + [long, long, long + " today", "here is " + item + " to find", None, "", "123 456"]
    langs = [k for _, k in clean] + ["en"] * 7
    docs = frame(spark, texts, langs)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r.doc_id: (r.n_tokens, r.ids_sha256) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}

    rows = [(i, t) for i, t in enumerate(texts) if t and any(c.isalpha() for c in t)]
    rows = [(i, t) for (i, t), g in zip(rows, groups(rows, 80, 5), strict=True) if g[2] == i]
    dirty = {rows[r[0]][0] for r in hits([t for _, t in rows], [(1, item)]) if r[5]}
    ranks = bpe.read_ranks(None, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    real = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {}
    for i, t in rows:
        if i not in dirty:
            ids = real.encode_ordinary(t)
            want[i] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
    assert got == want and len(clean) + 1 == len(want)


def test_stages_keep_columns_and_change_text(spark, tmp_path):
    docs = frame(spark, ["mail und.34@mail7.example.com to the house with the dog", "plain text of the house"])
    out = corpus_pipeline.pseudonyms(spark, docs, str(tmp_path))
    assert out.columns == corpus_pipeline.COLUMNS
    found = {r.doc_id: r.text for r in out.collect()}
    assert "und.34" not in found[0] and found[1] == "plain text of the house"


def test_repeated_ids_stay_once(spark, tmp_path):
    docs = spark.createDataFrame([(7, "one two three four five six", "en", "s", 1)] * 2, "doc_id long, text string, lang string, source string, n_chars long")
    assert corpus_pipeline.near_dedup_stage(spark, docs, str(tmp_path)).count() == 1
