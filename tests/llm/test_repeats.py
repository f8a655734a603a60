import random
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.llm import repeats
from folioscope.llm.suffixes import SuffixArray, anchors, column_anchors, merged
from tests.llm.conftest import frame


def brute(rows, length):
    """(doc_id, n_bytes, n_removed, n_spans, digest) of (doc_id, bytes), whose order is that of the list for equal ids."""
    seen, out = set(), []
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        gone = np.zeros(len(text) + 1, np.int8)
        for a in range(len(text) - length + 1):
            window = text[a : a + length]
            if window in seen:
                gone[a : a + length] = 1
            seen.add(window)
        runs = int((np.diff(gone, prepend=0) == 1).sum())
        out.append((i, len(text), int(gone.sum()), runs, sha256(bytes(b for b, g in zip(text, gone, strict=False) if not g)).hexdigest()))
    return out


def result(df):
    return sorted(map(tuple, df.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()), key=str)


def passages(seed, n=60):
    """Texts of few words that share passages, in other surroundings, within and across texts."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 8))) for _ in range(40)]
    say = lambda k: " ".join(rng.choice(words) for _ in range(k))
    shared = [say(rng.randint(10, 80)) for _ in range(6)]
    out = []
    for _ in range(n):
        parts = [say(rng.randint(0, 30)) for _ in range(3)] + rng.sample(shared, rng.randint(0, 3)) * rng.randint(1, 2)
        rng.shuffle(parts)
        out.append(" ".join(parts))
    return out + out[:5] + [t[20:] for t in out[5:9]]


@pytest.mark.parametrize("length", [100, 12])
def test_equals_brute_force(spark, length):
    texts = passages(length) + [None, "", "x" * 99, "x" * 100, "y" * 3000, "ab" * 900, "é" * 70, "\x00" * 250, "\x00" * 130 + "z" + "\x00" * 130]
    docs = frame(spark, texts).repartition(5).withColumn("doc", F.lit(7)).withColumn("tie", F.lit("mine")).withColumn("spans", F.lit(1))
    assert result(repeats.remove_repeats(docs, length)) == sorted(brute([(i, (t or "").encode()) for i, t in enumerate(texts)], length), key=str)


def test_crowded_anchors_equal_brute_force(spark, monkeypatch):
    """An anchor with more pieces than fit a part goes on window by window, whether the sample told so or the counts."""
    rng = random.Random(4)
    line = "a line that stands in a third of all the documents, word for word, and runs on for more than a hundred bytes"
    texts = ["".join(rng.choice("qrst uvw") for _ in range(rng.randint(0, 60))) + (line if i % 3 else line[5:] + line[:70]) + str(rng.random()) for i in range(400)]
    want = sorted(brute([(i, t.encode()) for i, t in enumerate(texts)], 100), key=str)
    for crowd, sample, part in ((8, 2, 1 << 12), (8, 10**9, 1 << 12), (10**9, 10**9, 1 << 10)):
        monkeypatch.setattr(repeats, "CROWD", crowd)
        monkeypatch.setattr(repeats, "SAMPLE", sample)
        monkeypatch.setattr(repeats, "PART", part)
        assert result(repeats.remove_repeats(frame(spark, texts).repartition(7))) == want


def test_repeated_and_missing_ids(spark):
    a, b = "first text " * 20 + "of its own", "second text " * 20 + "of its own"
    rows = [(1, a), (1, a), (1, a), (2, a + b), (2, b), (None, b), (None, b), (3, "short"), (3, "short"), (None, None), (None, None)]
    got = result(repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)))
    assert len(got) == len(rows)
    by = lambda i: sorted((r[1], r[2]) for r in got if r[0] == i)
    # The null ids come first, so their text is whole once; of id 1 one row is whole.
    inner = brute([(0, b.encode()), (1, a.encode())], 100)
    assert by(None) == [(0, 0), (0, 0), (len(b), inner[0][2]), (len(b), len(b))]
    assert by(1) == [(len(a), inner[1][2]), (len(a), len(a)), (len(a), len(a))]
    assert by(2) == [(len(b), len(b)), (len(a + b), len(a + b) - brute([(0, b.encode()), (1, a.encode()), (2, (a + b).encode())], 100)[2][1] + brute([(0, b.encode()), (1, a.encode()), (2, (a + b).encode())], 100)[2][2])]
    assert by(3) == [(5, 0), (5, 0)]


def test_very_long_and_empty(spark, empty_docs):
    assert repeats.remove_repeats(empty_docs).count() == 0
    rng = random.Random(2)
    long = "".join(rng.choice("abcdefgh ") for _ in range(600_000))
    texts = ["head " + long[1000:200_000], long + long[:150], long[299_950:]]
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in repeats.remove_repeats(frame(spark, texts)).collect()}
    assert got == {0: (0, 0), 1: (199_000 + 150, 2), 2: (300_050, 1)}


def test_maximal_repeats_have_all_occurrences(spark):
    texts = passages(5, 30)
    found = repeats.Repeats(frame(spark, texts), 20)
    groups, suffixes = (t.collect() for t in found.groups())
    at = {(r.part, r.place): (texts[r.doc].encode(), r.start) for r in suffixes}
    assert groups
    for g in groups:
        own = [at[g.part, i] for i in range(g.place, g.upto)]
        assert len({t[s : s + g.length] for t, s in own}) == 1 and len(own) > 1 and g.length >= 20


def test_tree_of_intervals_by_brute_force():
    """All strings of two occurrences at least that can't go on to the right or the left without losing one."""
    rng = random.Random(1)
    for size in (12, 60, 200):
        text = bytes(rng.choice(b"ab") for _ in range(size))
        array = SuffixArray([text], np.array([size - 3 + 1]), 3)
        groups, beaten = array.scan(array.place)
        got = {(text[array.place[lo] : array.place[lo] + n], tuple(sorted(array.place[lo:hi]))) for n, lo, hi in groups}
        want = set()
        for a in range(size):
            for n in range(3, size - a + 1):
                s = text[a : a + n]
                own = tuple(i for i in range(size - n + 1) if text[i : i + n] == s)
                if len(own) > 1 and len({text[i + n : i + n + 1] or i for i in own}) > 1 and (0 in own or len({text[i - 1] for i in own}) > 1):
                    want.add((s, own))
        assert got == want
        for place, n in zip(array.place, beaten, strict=True):
            assert n == max((k for k in range(3, size - place + 1) if text.find(text[place : place + k]) < place), default=0)


def test_equal_windows_have_equal_anchors():
    rng = random.Random(8)
    data = np.frombuffer(bytes(rng.choice(b"abc") for _ in range(5000)), np.uint8)
    at = np.array([0, 0, 30, 1700, 5000])
    key, _, row, start, n = anchors(data, at, 20, 6)
    windows = {}
    for k, r, s, m in zip(key.tolist(), row.tolist(), start.tolist(), n.tolist(), strict=True):
        for q in range(s, s + m):
            windows.setdefault(bytes(data[at[r] + q : at[r] + q + 20]), set()).add(k)
    assert n.sum() == sum(max(0, int(b - a) - 19) for a, b in zip(at, at[1:], strict=False)) and all(len(k) == 1 for k in windows.values())
    assert not list(column_anchors(__import__("pyarrow").array(["short"]), 20, 6))[0][0].size


def test_spans_join_where_they_touch():
    of, start, size = merged(np.array([1, 0, 0, 0, 1]), np.array([5, 10, 0, 4, 1]), np.array([2, 1, 4, 2, 9]))
    assert list(zip(of.tolist(), start.tolist(), size.tolist(), strict=True)) == [(0, 0, 6), (0, 10, 1), (1, 1, 9)]
