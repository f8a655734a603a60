import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, texts, langs=None, sources=None, first=0):
    rows = [(i + first, t, (langs or ["en"] * len(texts))[i], (sources or ["src0"] * len(texts))[i], len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def odd_texts():
    """Nulls, empty and blank texts, one word, a very long text, other letters, copies."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7)))
    base = [word() for _ in range(120)]
    near = [" ".join(base[:i] + ["changed"] + base[i + 1 :]) for i in range(0, 120, 10)]
    return [None, "", "  \t\n ", "one", "two words", " ".join(word() for _ in range(30_000)), "Ünïcode ñandú ΑΣ " * 5, "x" * 40_000, *near, " ".join(base), " ".join(base), " ".join(base).upper(), *[" ".join(word() for _ in range(50)) for _ in range(20)]]


@pytest.fixture(scope="session")
def odd_docs(spark, odd_texts):
    return frame(spark, odd_texts).cache()


@pytest.fixture(scope="session")
def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)
