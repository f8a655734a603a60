import corpus_pipeline


def test_null_and_shared_ids_keep_different_texts(spark, tmp_path):
    texts = {n: " ".join(f"{n}{i}" for i in range(40)) for n in "abcdef"}
    rows = [(None, texts["a"]), (None, texts["b"]), (None, texts["b"]), (7, texts["c"]), (7, texts["d"]), (7, texts["d"]), (3, texts["e"]), (7, texts["e"] + " more"), (None, texts["d"] + " more"), (9, None), (9, None), (9, " \n"), (8, texts["f"])]
    docs = spark.createDataFrame([(i, t, "en" if n % 2 else None, "s", 1) for n, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = corpus_pipeline.near_dedup_stage(spark, docs, str(tmp_path))
    assert got.columns == docs.columns
    want = [(None, texts["a"]), (None, texts["b"]), (7, texts["c"]), (7, texts["d"]), (3, texts["e"]), (9, None), (9, None), (9, " \n"), (8, texts["f"])]
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted(want, key=str)


def test_empty_table_and_clashing_columns(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, row_digest string, digest int, `__row` string, root string"
    empty = spark.createDataFrame([], schema)
    assert corpus_pipeline.near_dedup_stage(spark, empty, str(tmp_path)).collect() == []
    text = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(i, t, "en", "s", 1, f"r{i}", i, "x", "y") for i, t in enumerate([text, text + " more", "plain words of another text altogether"])], schema)
    got = corpus_pipeline.near_dedup_stage(spark, docs, str(tmp_path))
    assert got.columns == docs.columns
    assert sorted((r.doc_id, r.row_digest, r.digest) for r in got.collect()) == [(0, "r0", 0), (2, "r2", 2)]


OWN = ["language", "text_language", "posterior", "accepted", "n_found", "kinds", "digest", "near", "w"]


def test_every_stage_leaves_the_columns_of_others_alone(spark, tmp_path):
    spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in OWN)
    texts = [" ".join(f"word{chr(97 + (i + k) % 26)}" for k in range(20)) + " in the house" for i in range(30)]
    docs = spark.createDataFrame([(i, t, "en", "s.example.com", len(t), *[f"{c} of {i}" for c in OWN]) for i, t in enumerate(texts)], schema)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, str(tmp_path))
        assert got.columns == docs.columns
        kept = got.collect()
        assert kept and all(r[c] == f"{c} of {r.doc_id}" for r in kept for c in OWN)
        assert stage(spark, docs.limit(0), str(tmp_path)).collect() == []


def test_run_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and got.collect() == []
