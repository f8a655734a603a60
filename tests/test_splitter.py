import random
import re

import pytest
from pyspark.sql import functions as F

from folioscope.operators import splitter


def plain(text, size, overlap, separators=("\n\n", "\n", " ", "")):
    """The rules once more, by lists and indices."""
    sep = next((s for s in separators if s == "" or s in text), separators[-1])
    rest = separators[separators.index(sep) + 1 :]
    if sep:
        cut = re.split(f"({re.escape(sep)})", text)
        parts = [x for x in [cut[0], *(cut[i] + cut[i + 1] for i in range(1, len(cut), 2))] if x]
    else:
        parts = list(text)

    def pack(parts):
        out, begin, end = [], 0, 0
        while end < len(parts):
            if end > begin and sum(map(len, parts[begin:end])) + len(parts[end]) > size:
                out.append("".join(parts[begin:end]).strip())
                while begin < end and (sum(map(len, parts[begin:end])) > overlap or sum(map(len, parts[begin : end + 1])) > size):
                    begin += 1
            end += 1
        if end > begin:
            out.append("".join(parts[begin:end]).strip())
        return out

    found, short = [], []
    for part in [*parts, None]:
        if part is not None and len(part) < size:
            short.append(part)
            continue
        found += pack(short)
        short = []
        if part is not None:
            found += plain(part, size, overlap, rest) if rest else [part]
    return [x.strip() for x in found if x.strip()]


def texts(n):
    rng = random.Random(n)
    for _ in range(n):
        words = ["w" * rng.randint(1, 14) if rng.random() < 0.98 else "x" * rng.randint(20, 90) for _ in range(rng.randint(0, 60))]
        yield "".join(w + rng.choice([" ", " ", " ", "  ", "\n", "\n\n", "\n\n\n", "\t", ""]) for w in words)


def test_ten_thousand_texts_equal_plain_python():
    for text in texts(10_000):
        for size, overlap in ((40, 10), (12, 0)):
            assert list(splitter.pieces(text, size, overlap)) == plain(text, size, overlap), repr(text)


def test_known_cuts():
    assert list(splitter.pieces("aa bb cc dd", 6, 3)) == ["aa bb", "bb cc", "cc dd"]
    assert list(splitter.pieces("one\n\ntwo three\nfour", 10, 0)) == ["one", "two three", "four"]
    assert list(splitter.pieces("abcdef", 4, 1)) == ["abcd", "def"]
    assert list(splitter.pieces("abcdef gh", 4, 0, (" ",))) == ["abcdef", "gh"]
    with pytest.raises(ValueError):
        list(splitter.pieces("x", 10, 11))


def test_table_function_in_a_lateral_join(spark):
    rows = [(i, "k", t) for i, t in enumerate(texts(200))] + [(900, None, None), (901, "k", ""), (902, "k", " " * 90)]
    df = spark.createDataFrame(rows, "id int, key string, text string").repartition(4)
    got = {}
    for r in splitter.split_long(df, 60, 40, 10).orderBy("id", "piece").collect():
        assert r.piece == len(got.setdefault(r.id, []))
        got[r.id].append(r.text)
    want = {i: p for i, _, t in rows if t is not None and (p := [t] if len(t) <= 60 else plain(t, 40, 10))}
    assert got == want
    spark.udtf.register("split_text", splitter.SplitText)
    df.createOrReplaceTempView("texts_to_split")
    assert spark.sql("SELECT id, p.* FROM texts_to_split, LATERAL split_text(text, 60, 40, 10) AS p").count() == sum(map(len, want.values()))
    assert splitter.split_long(df.limit(0)).withColumn("x", F.lit(1)).collect() == []
