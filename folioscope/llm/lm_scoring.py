"""Cross-entropy difference between a target and a background language model."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.shared import Scratch, bound_batches
from folioscope.llm.words import Words, chunks, mix

#: Smoothing takes the vocabulary to have at least 2**WORD_BITS words; with more distinct words it has those.
WORD_BITS = 16
#: Bytes of text in a block (a longer text is a block of its own size).
BLOCK = 8 << 20
#: The word before a row's first. Keys of words are even and keys of pairs odd.
START, ODD = np.uint64(0x5851F42D4C957F2C), np.uint64(1)


def _slots(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each word its own key, that of the word before it in its row (START at a row's start), and that of the two."""
    own = words.hash & ~ODD
    before = np.full(len(own), START, np.uint64)
    if len(own) > 1:
        same = words.row[1:] == words.row[:-1]
        before[1:][same] = own[:-1][same]
    return own, before, mix(before * np.uint64(0xD6E8FEB86659FD93) ^ words.hash) | ODD


def _pack(values: np.ndarray) -> bytes:
    """Numbers as compressed planes of bytes."""
    return pa.compress(np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T), "zstd", asbytes=True) if len(values) else b""


def _unpack(data: bytes, n: int, dtype: type) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    if not n:
        return np.zeros(0, dtype)
    return np.ascontiguousarray(np.frombuffer(pa.decompress(data, n * size, "zstd"), np.uint8).reshape(size, n).T).view(dtype).ravel()


def _blocks(docs: DataFrame) -> DataFrame:
    """block, ids, lengths and texts (compressed): the rows of a partition in blocks of about BLOCK bytes of text, one row each."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, ids, sizes, texts = TaskContext.get().partitionId() << 32, [], [], []

        def flush() -> pa.RecordBatch:
            n, data = np.concatenate(sizes), pa.compress(b"".join(texts), "zstd", asbytes=True)
            row = [pa.array([block]), pa.array([pa.concat_arrays(ids).to_pylist()], pa.list_(pa.int64())), pa.array([n], pa.list_(pa.int64())), pa.array([data], pa.binary())]
            ids.clear(), sizes.clear(), texts.clear()
            return pa.RecordBatch.from_arrays(row, names=["block", "ids", "lengths", "texts"])

        for batch in batches:
            for first, data, at in chunks(batch.column(1)):
                ids.append(batch.column(0).slice(first, len(at) - 1)), sizes.append(np.diff(at)), texts.append(data.tobytes())
                if sum(map(len, texts)) >= BLOCK:
                    yield flush()
                    block += 1
        if ids:
            yield flush()

    bound_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(made, "block long, ids array<long>, lengths array<long>, texts binary")


class _Block:
    """The words of one block: n of each row, the sorted keys, and which of them each word, the one before it and the two are."""

    def __init__(self, table: pa.Table):
        self.block, self.ids = table["block"][0].as_py(), table["ids"][0].values
        sizes = table["lengths"][0].values.to_numpy()
        at, total = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), int(sizes.sum())
        data = pa.decompress(table["texts"][0].as_py(), total, "zstd") if total else b""
        column = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(at), pa.py_buffer(data)])
        own, before, pair, n = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for _, part, begin in chunks(column):
            words = Words(part, begin)
            for out, made in zip((own, before, pair), _slots(words), strict=True):
                out.append(made)
            n.append(np.diff(words.first))
        self.n, before = np.concatenate(n), np.concatenate(before)
        words, word = np.unique(np.concatenate([*own, [START]]), return_inverse=True)
        pairs, pair = np.unique(np.concatenate(pair), return_inverse=True)
        head = np.where(before == START, word[-1], np.concatenate([[0], word[:-2]])[: len(before)])
        keys = np.concatenate([words, pairs])
        order = np.argsort(keys)
        rank = np.empty(len(keys), np.int64)
        rank[order] = np.arange(len(keys))
        self.keys, self.word, self.head, self.pair = keys[order], rank[word[:-1]], rank[head], rank[len(words) + pair]


_COUNTS = "bucket long, block long, n long, keys binary, counts binary"
_TOTALS = "bucket long, block long, n long, counts binary, words long, target long, background long"
_SCORES = "doc_id long, n_tokens long, target_loss double, background_loss double"


def _table(schema: str, rows: list[tuple]) -> pa.Table:
    fields = [f.split() for f in schema.split(", ")]
    types = {"long": pa.int64(), "binary": pa.binary()}
    return pa.Table.from_arrays([pa.array(c, types[t]) for c, (_, t) in zip(zip(*rows, strict=True), fields, strict=True)], names=[f[0] for f in fields])


def _own(rows: np.ndarray, keys: np.ndarray, size: int) -> np.ndarray:
    """Of each word how often its key occurs in its row."""
    _, which, n = np.unique(rows * size + keys, return_inverse=True, return_counts=True)
    return n[which]


def score_documents(docs: DataFrame, target_ids: DataFrame, weight: float = 200.0) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss (nats per word) and difference for every row of ``docs``.

    docs has doc_id and text, target_ids the doc_id of known good rows (both may repeat, further columns are ignored). Two
    word-pair models with one vocabulary and one smoothing, one of the good rows and one of all rows, are matched in that neither has seen
    the row that it scores: the row's own words and pairs are taken out of the counts of every model that holds it (a copy of
    the row stays). Each model smooths a pair by its word's share: (pairs + weight * share) / (heads + weight). difference is
    target_loss - background_loss: low values are close to the target. A text without words has null losses and difference
    and no tokens; an empty table gives no rows; without good rows the target model knows the vocabulary's size alone. Equal rows tie.
    A very long text is a block of its own.

    Words and pairs have 63-bit keys of their own, counted over all rows and whole texts, and nothing but a block's own counts is
    held at once: a block counts each of its keys once and deals them to buckets by their value; a bucket adds up what all blocks
    have, and answers each block with the totals of its keys. Blocks and buckets grow in number, not in size, with the corpus.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scratch = Scratch(docs.sparkSession, "lm")
    blocks = scratch.keep(_blocks(docs))
    bits = max(1, (blocks.count() // 2).bit_length())
    good = scratch.keep(target_ids.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct())
    # Places of the known rows in their blocks. They grow with the corpus: while they are few, the blocks need not move to meet them.
    known = blocks.select("block", F.posexplode("ids").alias("pos", "doc_id")).join(scratch.hinted(good), "doc_id")
    known = scratch.keep(known.groupBy("block").agg(F.sort_array(F.collect_list("pos")).alias("known")))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                yield from of_block(pa.Table.from_batches([batch.slice(i, 1)])).to_batches()

    def of_block(table: pa.Table) -> pa.Table:
        b, places = _Block(table), table["known"][0].as_py()
        wanted, size = np.zeros(len(b.n), bool), len(b.keys)
        wanted[np.array(places or [], np.int64)] = True
        of = np.repeat(wanted, b.n)
        counts = [np.bincount(np.concatenate([b.word[m], b.pair[m]]), minlength=size) for m in (of, slice(None))] + [np.bincount(b.head[m], minlength=size) for m in (of, slice(None))]
        counts = np.stack(counts, 1).astype(np.uint32)
        ends = np.searchsorted(b.keys >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
        # The known rows travel as a bucket of their own, for the block alone.
        cells = [(-1 - b.block, b.block, 0, b"", np.packbits(wanted).tobytes())]
        for i, (lo, hi) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
            steps = np.diff(b.keys[lo:hi], prepend=np.uint64(0))
            cells.append((i, b.block, hi - lo, _pack(steps), _pack(counts[lo:hi].T.ravel())))
        return _table(_COUNTS, cells)

    def added(table: pa.Table) -> pa.Table:
        bucket = table["bucket"][0].as_py()
        if bucket < 0:
            return _table(_TOTALS, [(bucket, table["block"][0].as_py(), 0, table["counts"][0].as_py(), 0, 0, 0)])
        n = table["n"].to_numpy()
        keys = np.concatenate([np.cumsum(_unpack(k.as_py(), m, np.uint64), dtype=np.uint64) for k, m in zip(table["keys"], n, strict=True)])
        found, which = np.unique(keys, return_inverse=True)
        del keys
        sums = np.zeros((4, len(found)), np.int64)
        for c, m, lo in zip(table["counts"], n, np.cumsum(n) - n, strict=True):
            sums[:, which[lo : lo + m]] += _unpack(c.as_py(), 4 * m, np.uint32).reshape(4, m)
        words = (found & ODD) == 0
        whole = (int((sums[1][words] > 0).sum()), int(sums[0][words].sum()), int(sums[1][words].sum()))
        return _table(_TOTALS, [(bucket, b.as_py(), m, _pack(sums[:, which[lo : lo + m]].ravel()), *whole) for b, m, lo in zip(table["block"], n, np.cumsum(n) - n, strict=True)])

    def scored(table: pa.Table, totals: pa.Table) -> pa.Table:
        b, totals = _Block(table), totals.sort_by("bucket")
        flags, totals = totals["counts"][0].as_py(), totals.slice(1)
        known = np.unpackbits(np.frombuffer(flags, np.uint8), count=len(b.n)).astype(bool)
        counts = np.concatenate([_unpack(c.as_py(), 4 * m.as_py(), np.int64).reshape(4, -1) for c, m in zip(totals["counts"], totals["n"], strict=True)], 1)
        vocabulary = max(1 << WORD_BITS, sum(totals["words"].to_pylist()))
        row, size = np.repeat(np.arange(len(b.n)), b.n), max(1, len(b.keys))
        own_word, own_pair, own_head = (_own(row, keys, size) for keys in (b.word, b.pair, b.head))
        first, means = np.concatenate([[0], np.cumsum(b.n)]), []
        for name, pairs, heads, seen in (("target", counts[0], counts[2], known[row]), ("background", counts[1], counts[3], np.ones(len(row), bool))):
            share = (pairs[b.word] - own_word * seen + 0.5) / (sum(totals[name].to_pylist()) - b.n[row] * seen + 0.5 * vocabulary)
            loss = -np.log((pairs[b.pair] - own_pair * seen + weight * share) / (heads[b.head] - own_head * seen + weight))
            with np.errstate(invalid="ignore"):
                means.append(pa.array(np.diff(np.concatenate([[0.0], np.cumsum(loss)])[first]) / b.n, mask=b.n == 0))
        return pa.Table.from_arrays([b.ids, pa.array(b.n.astype(np.int64)), *means], names=["doc_id", "n_tokens", "target_loss", "background_loss"])

    cells = blocks.join(scratch.hinted(known), "block", "left").mapInArrow(counted, _COUNTS)
    totals = cells.groupBy("bucket").applyInArrow(added, _TOTALS)
    out = blocks.groupBy("block").cogroup(totals.groupBy("block")).applyInArrow(scored, _SCORES)
    return out.withColumn("difference", F.col("target_loss") - F.col("background_loss"))
