"""Passages that repeat, within and across documents, from suffix arrays of content-defined pieces."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.shared import Scratch, bound_batches
from folioscope.llm.suffixes import SuffixArray, column_anchors, merged
from folioscope.llm.words import mix

#: Anchors with more different pieces than this are crowded: their pieces are compared window by window.
CROWD = 1024
#: Bytes of pieces whose suffixes are sorted together.
PART = 256 << 10
#: One document in so many tells which anchors are crowded beforehand. It changes how rows are dealt, not the result.
SAMPLE = 16
#: At most so many such anchors, the most crowded ones.
MOST_CROWDED = 1000

_ROWS = "kind int, deal long, h long, p long, doc long, tie long, start long, n long, crowded boolean"
_FOUND = "kind int, doc long, tie long, start long, n long, h long, crowded boolean"
_SPAN, _PIECE = 0, 1


def _batch(schema: str, *columns) -> pa.RecordBatch:
    types = {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, types[t]) for c, (_, t) in zip(columns, fields, strict=True)], names=[f for f, _ in fields])


def _of_spans(schema: str, doc: np.ndarray, tie: np.ndarray, start: np.ndarray, size: np.ndarray) -> pa.RecordBatch:
    """Rows of kind _SPAN, in maximal runs."""
    _, order = np.unique(np.stack([doc, tie], 1), axis=0, return_inverse=True) if len(doc) else (None, np.zeros(0, np.int64))
    order = order.ravel()
    one = np.zeros(int(order.max(initial=-1)) + 1, np.int64)
    one[order] = np.arange(len(order))
    of, start, size = merged(order, start, size)
    doc, tie, none = doc[one[of]], tie[one[of]], np.zeros(len(of), np.int64)
    if schema == _FOUND:
        return _batch(schema, none, doc, tie, start, size, none, none.astype(bool))
    # They need no task of their own choice, so they are spread.
    deal = mix(doc.astype(np.uint64) * np.uint64(31) + start.astype(np.uint64)).view(np.int64)
    return _batch(schema, none, deal, deal, none, doc, tie, start, size, none.astype(bool))


def _pieces(length: int, gram: int, crowded: np.ndarray | None = None):
    """From rows (doc, tie, start, text): the pieces of each text, and spans of those that have an equal and earlier one in the same batch."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, tie, base = (c.to_numpy(zero_copy_only=False) for c in batch.columns[:3])
            parts = list(column_anchors(batch.column(3), length, gram))
            if not parts:
                continue
            h, p, row, start, n = (np.concatenate(x) for x in zip(*parts, strict=True))
            doc, tie, start = doc[row], tie[row], start + base[row]
            by = np.lexsort((start, tie, doc, p, h))
            h, p, doc, tie, start, n = (x[by] for x in (h, p, doc, tie, start, n))
            again = np.zeros(len(h), bool)
            again[1:] = (h[1:] == h[:-1]) & (p[1:] == p[:-1])
            yield _of_spans(_ROWS, doc[again], tie[again], start[again], n[again] + (length - 1))
            h, p, doc, tie, start, n = (x[~again] for x in (h, p, doc, tie, start, n))
            full = np.isin(h, crowded) if crowded is not None else np.ones(len(h), bool)
            deal = np.where(full, mix((h ^ (p >> 1)).view(np.uint64)).view(np.int64), h)
            yield _batch(_ROWS, np.full(len(h), _PIECE), deal, h, p, doc, tie, start, n, full)

    return made


def _told(length: int):
    """From rows in the order (h, p, doc, tie, start): spans of all pieces but the first of equal ones, and the first ones of anchors with several, or crowded, pieces.

    Nothing is held but a batch, and one piece whose anchor may go on in the next.
    """

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, shared, waiting = None, None, None
        for batch in batches:
            kind, h, p, doc, tie, start, n, full = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            spans = kind == _SPAN
            yield _of_spans(_FOUND, doc[spans], tie[spans], start[spans], n[spans])
            h, p, doc, tie, start, n, full = (c[~spans] for c in (h, p, doc, tie, start, n, full))
            if not len(h):
                continue
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (p[1:] != p[:-1])
            new[0] = last != (h[0], p[0])
            last = (h[-1], p[-1])
            yield _of_spans(_FOUND, doc[~new], tie[~new], start[~new], n[~new] + (length - 1))
            firsts = [c[new] for c in (h, doc, tie, start, n, full)]
            if waiting is not None:
                firsts = [np.append(w, c) for w, c in zip(waiting, firsts, strict=True)]
            h, doc, tie, start, n, full = firsts
            if not len(h):
                continue
            _, which, counts = np.unique(h, return_inverse=True, return_counts=True)
            wanted = (counts[which] > 1) | full | (h == shared if shared is not None else False)
            waiting = None if wanted[-1] else [c[-1:] for c in firsts]
            shared = h[-1] if wanted[-1] else None
            yield _batch(_FOUND, np.full(int(wanted.sum()), _PIECE), doc[wanted], tie[wanted], start[wanted], n[wanted], h[wanted], full[wanted])

    return made


def _compared(rows: DataFrame, length: int) -> DataFrame:
    """Rows of ``_pieces`` dealt by anchor (crowded ones by piece) and told apart."""
    order = ["h", "p", "doc", "tie", "start"]
    return rows.repartition("deal").sortWithinPartitions(*order).select("kind", *order, "n", "crowded").mapInArrow(_told(length), _FOUND)


def _crowded(docs: DataFrame, length: int, gram: int) -> np.ndarray:
    """Anchors with CROWD / SAMPLE different pieces in a sample of one document in SAMPLE; at most MOST_CROWDED numbers."""
    some = docs.where(F.pmod(F.xxhash64("doc", "tie"), F.lit(SAMPLE)) == 0)
    pieces = some.mapInArrow(_pieces(length, gram, np.zeros(0, np.int64)), _ROWS).where(F.col("kind") == _PIECE)
    seen = pieces.groupBy("h", "p").agg(F.lit(1).alias("one")).groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= CROWD // SAMPLE)
    return np.array([r[0] for r in seen.orderBy(F.desc("n"), "h").limit(MOST_CROWDED).collect()], np.int64)


def _cut(length: int):
    """From rows (doc, tie, text, wanted): the bytes of the wanted pieces."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).cast(pa.large_binary())
            for i in range(len(batch)):
                text, wanted = texts[i].as_py(), pa.Table.from_struct_array(batch.column(3)[i].values)
                start, n, h, full = (wanted[c].to_numpy() for c in ("start", "n", "h", "crowded"))
                data = [text[a:b] for a, b in zip(start.tolist(), (start + n + (length - 1)).tolist(), strict=True)]
                own = [pa.array(np.full(len(start), batch.column(c)[i].as_py()), pa.int64()) for c in (0, 1)]
                yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(full), *own, pa.array(start, pa.int64()), pa.array(n, pa.int64()), pa.array(data, pa.binary())], names=["h", "crowded", "doc", "tie", "start", "n", "piece"])

    return made


_GROUPS = "kind int, doc long, tie long, start long, n long, part long, place long, upto long"
_SUFFIX, _GROUP = 2, 3


def _sorted(length: int, groups: bool):
    """A part's pieces by their suffix array: spans of all occurrences of repeats but the first, and the maximal repeats themselves if asked for."""

    def made(key: tuple, table: pa.Table) -> pa.Table:
        doc, tie, start, n = (table[c].to_numpy() for c in ("doc", "tie", "start", "n"))
        array = SuffixArray(table["piece"].to_pylist(), n, length)
        doc, tie, start = doc[array.piece], tie[array.piece], start[array.piece] + array.place
        position = np.empty(len(start), np.int64)
        position[np.lexsort((start, tie, doc))] = np.arange(len(start))
        found, beaten = array.scan(position)
        at = np.flatnonzero(beaten)
        spans = _of_spans(_FOUND, doc[at], tie[at], start[at], beaten[at])
        none = np.zeros(len(spans), np.int64)
        out = [_batch(_GROUPS, *(spans.column(c).to_numpy() for c in range(5)), none, none, none)]
        if groups:
            part, none = np.full(len(start), key[0].as_py()), np.zeros(len(start), np.int64)
            out.append(_batch(_GROUPS, none + _SUFFIX, doc, tie, start, none, part, np.arange(len(start)), none))
            size, lo, hi = (np.array(c, np.int64) for c in zip(*found, strict=True)) if found else np.zeros((3, 0), np.int64)
            none = np.zeros(len(size), np.int64)
            out.append(_batch(_GROUPS, none + _GROUP, none, none, none, size, none + key[0].as_py(), lo, hi))
        return pa.Table.from_batches(out)

    return made


class Repeats:
    """The repeated passages of ``length`` bytes or more in the texts of ``docs`` (doc_id, text).

    Every window of ``length`` bytes belongs to the piece of its anchor, which its own bytes decide; so equal windows lie in pieces of equal
    anchors, and texts are compared piece by piece:

    1. Pieces (one for each 30 bytes or so) are dealt by the hash of their anchor, without their bytes. Of pieces with the same
       128 bits of hashes and the same length all but the first are repeated as a whole; a batch leaves all but its first itself.
    2. What is left of anchors with several different pieces, the edges of repeats, is read from the texts. The suffixes of these pieces are sorted in
       parts of bounded size, and a scan with a stack over their common-prefix intervals gives the maximal repeats with
       all occurrences (``groups``): all but the first of each are spans.
    3. Anchors with more than CROWD different pieces would fill a part. Their pieces are cut into windows, which are dealt by their own hashes.

    Texts are read three times where they are, and move twice, to the lists of wanted pieces and to the spans, which grow with them.

    docs keeps the row of each document: doc (the doc_id; a null is the smallest), tie (0, or for a doc_id that several rows have a hash of the
    text, which orders them) and text; equal rows are one here.
    """

    def __init__(self, docs: DataFrame, length: int = 100):
        if length < 2:
            raise ValueError("repeats have two bytes at least")
        self.length, self.spark, self.scratch = length, docs.sparkSession, Scratch(docs.sparkSession, "repeats")
        bound_batches(self.spark)
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
        rows = rows.withColumn("doc", F.coalesce("doc_id", F.lit(-(2**63)).cast("long")))
        self.often = often = self.scratch.keep(rows.groupBy("doc").agg(F.count("*").alias("m")).where("m > 1").select("doc", F.lit(True).alias("often")))
        if often.limit(1).count():
            rows = rows.join(self.scratch.hinted(often), "doc", "left")
            rows = rows.withColumn("tie", F.when(F.col("often"), F.xxhash64("text").bitwiseOR(F.lit(1))).otherwise(0).cast("long")).drop("often")
            alike = rows.where("tie <> 0")
            self.copies = self.scratch.keep(alike.groupBy("doc", "tie").agg(F.count("*").alias("m")).where("m > 1"))
            rows = rows.where("tie = 0").union(alike.dropDuplicates(["doc", "tie"]).select(*rows.columns))
        else:
            rows, self.copies = rows.withColumn("tie", F.lit(0).cast("long")), None
        self.docs, self._groups = rows, None

    def _found(self, groups: bool) -> tuple[DataFrame, DataFrame]:
        """doc, tie, start and n (bytes) of all spans; and the rows of the parts."""
        length, keep = self.length, self.scratch.keep
        gram = max(1, length // 3)
        texts = self.docs.select("doc", "tie", F.lit(0).cast("long").alias("start"), "text")
        crowded = _crowded(texts, length, gram)
        found = keep(_compared(texts.mapInArrow(_pieces(length, gram, crowded), _ROWS), length))
        wanted = found.where(F.col("kind") == _PIECE).select("doc", "tie", "start", "n", "h", "crowded")
        sizes = keep(wanted.groupBy("h").agg(F.count("*").alias("m"), F.sum(F.col("n") + (length - 1)).alias("bytes")))
        more = keep(sizes.where(F.col("m") > CROWD).select("h", F.lit(True).alias("more")))
        parts = 1 + (sizes.where(F.col("m") <= CROWD).agg(F.sum("bytes")).first()[0] or 0) // PART
        wanted = wanted.join(self.scratch.hinted(more), "h", "left").withColumn("crowded", F.col("crowded") | F.coalesce("more", F.lit(False)))
        lists = keep(wanted.groupBy("doc", "tie").agg(F.collect_list(F.struct("start", "n", "h", "crowded")).alias("wanted")))
        pieces = keep(self.docs.select("doc", "tie", "text").join(lists.hint("merge"), ["doc", "tie"]).select("doc", "tie", "text", "wanted").mapInArrow(_cut(length), "h long, crowded boolean, doc long, tie long, start long, n long, piece binary"))
        dealt = pieces.where("not crowded").withColumn("part", F.pmod("h", F.lit(parts)))
        repeats = keep(dealt.groupBy("part").applyInArrow(_sorted(length, groups), _GROUPS))
        windows = pieces.where("crowded").select("doc", "tie", "start", "piece").mapInArrow(_pieces(length, length), _ROWS)
        windows = _compared(windows, length)
        spans = [t.where(F.col("kind") == _SPAN).select("doc", "tie", "start", "n") for t in (found, repeats, windows)]
        return spans[0].union(spans[1]).union(spans[2]), repeats

    def removed(self) -> DataFrame:
        """doc, tie and spans (of start and n, in bytes; they may overlap) of each document with repeated bytes, written once."""
        spans, _ = self._found(groups=False)
        out = self.scratch.keep(spans.groupBy("doc", "tie").agg(F.collect_list(F.struct("start", "n")).alias("spans")))
        self.scratch.drop_all_but(out, self.copies, self.often)
        return out

    def groups(self) -> tuple[DataFrame, DataFrame]:
        """The maximal repeats of the pieces that were sorted: (part, length, place, upto), and the suffixes (part, place, doc, tie, start).

        A repeat's occurrences are all the suffixes of its part from place to upto - 1; of equal pieces the first stands for all. A repeat
        that is longer than a piece is one in each of the pieces that it runs through.
        """
        _, rows = self._found(groups=True)
        repeats = rows.where(F.col("kind") == _GROUP).select("part", F.col("n").alias("length"), "place", "upto")
        return repeats, rows.where(F.col("kind") == _SUFFIX).select("part", "place", "doc", "tie", "start")


def _kept(length: int):
    """From rows (doc_id, doc, tie, text, spans): what is left of each text."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, spans = batch.column(3).cast(pa.large_binary()), batch.column(4)
            sizes, removed, runs, digests = [], [], [], []
            for text, own in zip(texts, spans, strict=True):
                text, start, n = text.as_py(), np.zeros(0, np.int64), np.zeros(0, np.int64)
                if own.is_valid:
                    start, n = (own.values.field(c).to_numpy() for c in ("start", "n"))
                    _, start, n = merged(np.zeros(len(start), np.int64), start, n)
                ends = zip([0, *(start + n).tolist()], [*start.tolist(), len(text)], strict=True)
                sizes.append(len(text)), removed.append(int(n.sum())), runs.append(len(n))
                digests.append(sha256(b"".join(text[a:b] for a, b in ends)).hexdigest())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.array(c, pa.int64()) for c in (sizes, removed, runs)), pa.array(digests, pa.string())], names=["doc_id", "doc", "tie", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return made


def remove_repeats(docs: DataFrame, length: int = 100) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 for every row of ``docs`` (doc_id, text; further columns are ignored).

    A byte goes if a string of ``length`` bytes that covers it also begins earlier: in the same text, or in one of a smaller doc_id. Texts are
    UTF-8 bytes, a null is empty, and no string spans two texts; what is removed elsewhere changes nothing. n_spans counts maximal removed
    runs, kept_sha256 is of the bytes that are left. A null doc_id is the smallest. Of different texts under one doc_id that with the smaller hash comes first;
    of equal rows one is the first, and the others go as a whole if they have ``length`` bytes. Texts shorter than that stay. A long text is anchored
    in stretches; an empty table gives no rows.
    """
    repeats = Repeats(docs, length)
    spans = repeats.removed()
    rows = repeats.docs.select("doc_id", "doc", "tie", "text").join(spans.hint("merge"), ["doc", "tie"], "left").select("doc_id", "doc", "tie", "text", "spans")
    out = rows.mapInArrow(_kept(length), "doc_id long, doc long, tie long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    result = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    if repeats.copies is None:
        return out.select(*result)
    out = out.join(repeats.scratch.hinted(repeats.copies), ["doc", "tie"], "left")
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.coalesce("m", F.lit(1).cast("long")))))
    gone = (F.col("copy") > 1) & (F.col("n_bytes") >= length)
    whole = {"n_removed": F.col("n_bytes"), "n_spans": F.lit(1).cast("long"), "kept_sha256": F.lit(sha256(b"").hexdigest())}
    return out.select("doc_id", "n_bytes", *[F.when(gone, v).otherwise(F.col(c)).alias(c) for c, v in whole.items()])
