import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioscope.llm import bpe
from tests.llm.conftest import frame

RANKS = bpe.read_ranks(None, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
REAL = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
OWN = bpe.ByteBpe(RANKS)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_equals_tiktoken(text):
    made = bpe.EditableEncoding(OWN, public_tokenizers.PATTERN, text)
    assert made.ids() == REAL.encode_ordinary(text) and OWN.decode(made.ids()).decode() == text


@settings(max_examples=150, deadline=None)
@given(st.text("ab 1é\n.", max_size=40), st.integers(0, 40), st.integers(0, 10), st.text("ab 1é\n.", max_size=10))
def test_edits_equal_encoding_anew(text, at, length, new):
    made = bpe.EditableEncoding(OWN, public_tokenizers.PATTERN, text)
    at = min(at, len(text))
    made.replace(at, min(length, len(text) - at), new)
    changed = text[:at] + new + text[at + min(length, len(text) - at) :]
    assert made.text == changed and made.ids() == REAL.encode_ordinary(changed)


def test_appends_and_reuse():
    text = " ".join(random.Random(1).choices(["thonble", "erhaan", "été", "123", "..."], k=400))
    made = bpe.EditableEncoding(OWN, public_tokenizers.PATTERN)
    for i in range(0, len(text), 7):
        made.append(text[i : i + 7])
    assert made.ids() == REAL.encode_ordinary(text)
    made.replace(1000, 3, "zzz")
    assert made.ids() == REAL.encode_ordinary(text[:1000] + "zzz" + text[1003:]) and made.reused > 0.9 * len(made.spans)


@settings(max_examples=300, deadline=None)
@given(st.text("aehinrst é漢", min_size=1, max_size=30))
def test_filling_from_the_end_equals_all_prefixes(text):
    piece = text.encode()
    assert OWN.encode(piece) == ([RANKS[piece]] if piece in RANKS else OWN.walk(OWN.last_tokens(piece))) == REAL._encode_single_piece(piece)


def test_prefixes_hold_every_encoding():
    piece = b"counterrevolutionaries"
    last = OWN.last_tokens(piece)
    for n in range(1, len(piece) + 1):
        assert OWN.walk(last[:n]) == OWN.merged(piece[:n])


@pytest.mark.parametrize("ids", [False, True])
def test_documents(spark, odd_docs, odd_texts, empty_docs, ids):
    sha = lambda b: hashlib.sha256(b).hexdigest()
    clash = odd_docs.withColumn("n_tokens", F.lit("x")).withColumn("ids", F.lit(1))
    got = bpe.encode_documents(clash, RANKS, public_tokenizers.PATTERN, with_ids=ids).orderBy("doc_id").collect()
    for r, t in zip(got, odd_texts, strict=True):
        want = REAL.encode_ordinary(t or "")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(want), sha(",".join(map(str, want)).encode()), sha((t or "").encode()))
        assert not ids or (r.ids == want and r.decoded == (t or ""))
    assert bpe.encode_documents(empty_docs, RANKS, public_tokenizers.PATTERN).count() == 0


def test_two_vocabularies_of_one_size(spark):
    """Equal in size and in ids; only two tokens have changed places."""
    a, b = (next(t for t in RANKS if t.strip() == w and t.startswith(b" ")) for w in (b"the", b"and"))
    turned = RANKS | {a: RANKS[b], b: RANKS[a]}
    docs = frame(spark, ["the and of the", "so and so"] * 4).coalesce(1)
    for _ in range(2):
        for ranks in (RANKS, turned):
            real = tiktoken.Encoding("other", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
            got = bpe.encode_documents(docs, ranks, public_tokenizers.PATTERN, with_ids=True).orderBy("doc_id").collect()
            assert [r.ids for r in got] == [real.encode_ordinary(t) for t in ["the and of the", "so and so"] * 4]


def test_a_vocabulary_without_a_byte_is_an_error(spark, odd_docs):
    with pytest.raises(ValueError, match="1 of the 256 bytes"):
        bpe.encode_documents(odd_docs, {t: i for t, i in RANKS.items() if t != b"x"}, public_tokenizers.PATTERN)


def test_forgetting_changes_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 4_000)
    monkeypatch.setattr(bpe, "PAIRS", 4)
    small = bpe.ByteBpe(RANKS)
    pieces = bpe.Pieces(small)
    text = "Ouwhea the of rend and threlyes ofthstthor nd of ouble edoution wh onharent. " * 3
    assert bpe.EditableEncoding(small, public_tokenizers.PATTERN, text).ids() == REAL.encode_ordinary(text)
    monkeypatch.setattr(bpe, "REMEMBERED", 40_000)
    rng = random.Random(4)
    for _ in range(1000):
        w = "".join(rng.choices("abehrté", k=rng.randint(1, 5)))
        assert pieces[w] == (",".join(map(str, REAL.encode_ordinary(w))), w.encode())
    assert 0 < len(pieces) <= 62 and len(pieces.old) <= 62
    assert pieces["x" * 500][1] == b"x" * 500 and "x" * 500 not in pieces
