"""Byte-level BPE by prefix dynamic programming: each byte prefix of a piece keeps the last token of its encoding.

The encoding of a prefix is that of a shorter prefix followed by one token, and the last token is unique: of the tokens
that end there, only one can follow the last token of the rest without a merge across the border. So appending bytes
computes the new prefixes alone, and an edit leaves all prefixes before it as they are.
"""

from __future__ import annotations

import base64
import gc
from collections.abc import Iterator
from hashlib import sha256
from operator import itemgetter

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm.shared import bound_batches

#: Bytes of pieces and their encodings that a worker remembers, pairs of tokens, and what a piece takes besides its characters, about.
REMEMBERED, PAIRS, ENTRY = 224 << 20, 600_000, 300
#: Bytes up to which a piece's prefixes are filled in from its end, one call within another.
DEEPEST = 200


class Pieces(dict):
    """Encodings by piece: the decimal ids joined by commas, and the bytes that they stand for.

    Forgets its older half when it is full, and remembers again what is asked for.
    """

    def __init__(self, bpe: ByteBpe):
        super().__init__()
        self.bpe, self.old, self.bytes = bpe, {}, 0

    def __missing__(self, piece: str) -> tuple[str, bytes]:
        made = self.old.get(piece)
        if made is None:
            ids = self.bpe.encode(piece.encode())
            made = ",".join(map(str, ids)), self.bpe.decode(ids)
        size = ENTRY + 4 * len(piece) + len(made[0]) + len(made[1])
        if size < REMEMBERED // 100:
            if self.bytes >= REMEMBERED // 2:
                self.old, self.bytes = dict(self), 0
                self.clear()
            self[piece] = made
            self.bytes += size
        return made


def check_bytes(ranks: dict[bytes, int]) -> None:
    if lacking := [b for b in range(256) if bytes([b]) not in ranks]:
        raise ValueError(f"the vocabulary has no token for {len(lacking)} of the 256 bytes")


class ByteBpe:
    """Encodes pieces by ranks: token bytes to id, where a smaller id merges first."""

    def __init__(self, ranks: dict[bytes, int], loose: frozenset[int] | None = None):
        check_bytes(ranks)
        self.ranks, self.bytes_of = ranks, {i: b for b, i in ranks.items()}
        self.parts: dict[int, tuple[int, int] | None] = {}
        self.pairs: dict[int, bool] = {}
        #: Tokens that are not the encoding of their own bytes, and so are in none.
        self.loose = frozenset(i for i in ranks.values() if not self.stands(i)) if loose is None else loose
        self.standing = {b: i for b, i in ranks.items() if i not in self.loose} if self.loose else ranks
        # By its last three bytes, the lengths of the tokens that can end there, the longest first.
        lengths: dict[bytes, set[int]] = {}
        for b in ranks:
            lengths.setdefault(b[-3:], set()).add(len(b))
        self.lengths = {b: tuple(sorted(n | {2, 1} if len(b) == 3 else n | {1}, reverse=True)) for b, n in lengths.items()}

    def merged(self, data: bytes) -> list[int]:
        """The encoding by its definition: merge the pair of least rank, the leftmost first. For a few bytes."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None of a byte, and of a token that no merges reach."""
        if token not in self.parts:
            data, made = self.bytes_of[token], None
            if len(data) > 1 and self.merged(data) == [token]:
                last = [data[i : i + 1] for i in range(len(data))]
                while len(last) > 2:
                    at = min((self.ranks.get(last[i] + last[i + 1], 1 << 60), i) for i in range(len(last) - 1))[1]
                    last[at : at + 2] = [last[at] + last[at + 1]]
                made = self.ranks[last[0]], self.ranks[last[1]]
            self.parts[token] = made
        return self.parts[token]

    def stands(self, token: int) -> bool:
        """Whether a token is the encoding of its own bytes."""
        return len(self.bytes_of[token]) == 1 or self.halves(token) is not None

    def follows(self, before: int, token: int) -> bool:
        """Whether no merge crosses the border of two tokens that each stand.

        A merge across would join an end of the first with a beginning of the second, at a moment when both are there: after
        they were made, and before the merges that take them into larger parts. So the two are taken apart, the
        part that was made last first, and at each step the merge of what meets at the border must come too late.
        """
        key = before << 32 | token
        known = self.pairs.get(key)
        if known is None:
            left, right, end = before, token, 1 << 60
            while True:
                crossing = self.ranks.get(self.bytes_of[left] + self.bytes_of[right])
                if crossing is not None and crossing < end:
                    known = False
                    break
                # Of two merges of one rank, the one further left comes first.
                first, second = self.halves(left), self.halves(right)
                if first is None and second is None:
                    known = True
                    break
                if second is None or (first is not None and left > right):
                    end, left = left, first[1]
                else:
                    end, right = right + 1, second[0]
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            self.pairs[key] = known
        return known

    def last_tokens(self, piece: bytes, last: list[int] | None = None) -> list[int]:
        """last[i]: the last token of the encoding of the first i + 1 bytes; goes on where ``last`` ends."""
        last = last if last is not None else []
        rank_of, lengths_of, pairs, follows, found = self.standing.get, self.lengths.get, self.pairs.get, self.follows, last.append
        for end in range(len(last) + 1, len(piece) + 1):
            for n in lengths_of(piece[end - 3 if end > 3 else 0 : end], (2, 1)):
                if n > end:
                    continue
                begin = end - n
                token = rank_of(piece[begin:end])
                if token is None:
                    continue
                if not begin:
                    found(token)
                    break
                before = last[begin - 1]
                known = pairs(before << 32 | token)
                if known or (known is None and follows(before, token)):
                    found(token)
                    break
        return last

    def walk(self, last: list[int]) -> list[int]:
        out, end = [], len(last)
        while end:
            out.append(last[end - 1])
            end -= len(self.bytes_of[last[end - 1]])
        return out[::-1]

    def fill(self, piece: bytes, last: list[int], end: int) -> int:
        """last[end - 1], and those of shorter prefixes that it depends on, where they are not known (-1) yet."""
        rank_of, pairs = self.standing.get, self.pairs.get
        for n in self.lengths.get(piece[end - 3 if end > 3 else 0 : end], (2, 1)):
            if n > end:
                continue
            begin = end - n
            token = rank_of(piece[begin:end])
            if token is None:
                continue
            if not begin:
                break
            before = last[begin - 1]
            if before < 0:
                before = self.fill(piece, last, begin)
            known = pairs(before << 32 | token)
            if known or (known is None and self.follows(before, token)):
                break
        last[end - 1] = token
        return token

    def encode(self, piece: bytes) -> list[int]:
        """The encoding of a piece; of a short one only those prefixes are looked at that its last tokens lead to."""
        token = self.ranks.get(piece)
        if token is not None:
            return [token]
        if len(piece) > DEEPEST:
            return self.walk(self.last_tokens(piece))
        last, end, out, bytes_of = [-1] * len(piece), len(piece), [], self.bytes_of
        while end:
            token = last[end - 1]
            if token < 0:
                token = self.fill(piece, last, end)
            out.append(token)
            end -= len(bytes_of[token])
        out.reverse()
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


class EditableEncoding:
    """The encoding of one text that grows or changes: pieces, and for each its bytes' last tokens."""

    def __init__(self, bpe: ByteBpe, pattern: str, text: str = ""):
        self.bpe, self.pattern, self.text, self.reused = bpe, regex.compile(pattern), "", 0
        self.spans: list[tuple[int, int]] = []
        self.lasts: list[list[int]] = []
        self.replace(0, 0, text)

    def append(self, text: str) -> None:
        self.replace(len(self.text), 0, text)

    def replace(self, at: int, length: int, new: str) -> None:
        """Encode again from the last piece that ends before ``at``, until an old piece begins where a new one would."""
        old_text, old = self.text, list(zip(self.spans, self.lasts, strict=True))
        self.text = old_text[:at] + new + old_text[at + length :]
        shift, edited = len(new) - length, at + len(new)
        keep = next((i for i, ((_, end), _) in enumerate(old) if end >= at), len(old))
        later = {begin + shift: i for i, ((begin, _), _) in enumerate(old) if begin >= at + length}
        spans, lasts = [s for s, _ in old[:keep]], [x for _, x in old[:keep]]
        begin, first, self.reused = spans[-1][1] if spans else 0, True, keep
        while begin < len(self.text):
            if begin >= edited and begin in later:
                rest = old[later[begin] :]
                spans += [(a + shift, b + shift) for (a, b), _ in rest]
                lasts += [x for _, x in rest]
                self.reused += len(rest)
                break
            end = self.pattern.match(self.text, begin).end()
            piece, known = self.text[begin:end].encode(), None
            if first and keep < len(old) and old[keep][0][0] == begin:
                before = old_text[begin : old[keep][0][1]].encode()
                same = next((i for i, (x, y) in enumerate(zip(before, piece, strict=False)) if x != y), min(len(before), len(piece)))
                known = old[keep][1][:same]
            spans.append((begin, end))
            lasts.append(self.bpe.last_tokens(piece, known))
            begin, first = end, False
        self.spans, self.lasts = spans, lasts

    def ids(self) -> list[int]:
        out = []
        for (a, b), last in zip(self.spans, self.lasts, strict=True):
            whole = self.bpe.ranks.get(self.text[a:b].encode())
            out += [whole] if whole is not None else self.bpe.walk(last)
        return out


def read_ranks(spark: SparkSession, path: str) -> dict[bytes, int]:
    """The ranks of a file of base64 tokens and ids on the driver (its size is that of a vocabulary)."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}


#: Of the vocabulary that this worker used last; it lives as long as the worker, which Spark reuses for task after task.
_made: dict[str, Pieces] = {}


def encode_documents(docs: DataFrame, ranks: dict[bytes, int], pattern: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 for every row of ``docs`` (doc_id, text); with_ids adds ids and decoded.

    Each match of ``pattern`` is encoded by itself; special tokens have no part. ids_sha256 is of the decimal ids joined
    by commas, decoded_sha256 of the bytes that the ids stand for. A null text counts as an empty one, which has no
    tokens. A row never waits for another, so order, ties, repeated rows and long texts change nothing, further columns are
    ignored, an empty table gives no rows, and no shuffle is needed. A vocabulary without all 256 bytes is an error.
    """
    check_bytes(ranks)
    spark = docs.sparkSession
    bound_batches(spark)
    shared = spark.sparkContext.broadcast((ranks, ByteBpe(ranks).loose))  # a vocabulary: its size does not depend on the documents
    digest = sha256(repr(pattern).encode())
    for token, rank in sorted(ranks.items()):
        digest.update(b"%d %d " % (rank, len(token)) + token)
    key = digest.hexdigest()

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _made:
            _made.clear()
            _made[key] = Pieces(ByteBpe(*shared.value))
        split, of = regex.compile(pattern).findall, _made[key].__getitem__
        # What is remembered grows by many small objects and has no cycles: looking for some among them again and again costs a tenth of the time.
        gc.disable()
        for batch in batches:
            n, sums, decoded_sums, all_ids, all_decoded = [], [], [], [], []
            for text in batch.column(1).to_pylist():
                got = list(map(of, split(text or "")))
                ids, decoded = ",".join(map(itemgetter(0), got)), b"".join(map(itemgetter(1), got))
                n.append(ids.count(",") + 1 if ids else 0)
                sums.append(sha256(ids.encode()).hexdigest())
                decoded_sums.append(sha256(decoded).hexdigest())
                if with_ids:
                    all_ids.append([int(i) for i in ids.split(",")] if ids else [])
                    all_decoded.append(decoded.decode())
            more = [pa.array(all_ids, pa.list_(pa.int32())), pa.array(all_decoded, pa.string())] if with_ids else []
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(sums, pa.string()), pa.array(decoded_sums, pa.string()), *more], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids", "decoded"][: len(more)]])
        gc.enable()

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(encoded, schema)
