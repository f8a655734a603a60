"""Words with positions (doc_id, page, x0, y0, x1, y1, text) to rows, blocks and label values."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def clustered_rows(words: DataFrame, tolerance: float = 3.0) -> DataFrame:
    """words with row: a word opens a row if it lies more than ``tolerance`` below the first word of the row before, so no lag can find it.

    A page's words are folded in order in one array; a page bounds its size.
    """
    ordered = words.groupBy("doc_id", "page").agg(F.sort_array(F.collect_list(F.struct("y0", "x0", "x1", "y1", "text"))).alias("w"))
    start = F.struct(F.lit(-1).alias("row"), F.lit(None).cast("double").alias("top"), F.array().cast("array<int>").alias("rows"))

    def step(s: Column, w: Column) -> Column:
        opens = s["top"].isNull() | (w["y0"] - s["top"] > tolerance)
        row = F.when(opens, s["row"] + 1).otherwise(s["row"])
        return F.struct(row.alias("row"), F.when(opens, w["y0"]).otherwise(s["top"]).alias("top"), F.concat(s["rows"], F.array(row)).alias("rows"))

    folded = ordered.withColumn("r", F.aggregate("w", start, step)["rows"])
    each = folded.select("doc_id", "page", F.explode(F.arrays_zip("w", "r")).alias("z"))
    return each.select("doc_id", "page", F.col("z.r").alias("row"), "z.w.*")


def cells(rows: DataFrame, ranges: Mapping[str, tuple[float, float]], above: float = 817.0) -> DataFrame:
    """(doc_id, page, row, one text for each named range of x): words above the footer, joined by x in half-open ranges."""
    bucket = F.coalesce(*[F.when((F.col("x0") >= a) & (F.col("x0") < b), F.lit(n)) for n, (a, b) in ranges.items()])
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("x0", "text"))), lambda x: x["text"]), " ")
    return rows.where(F.col("y0") < above).withColumn("bucket", bucket).where("bucket is not null").groupBy("doc_id", "page", "row").pivot("bucket", list(ranges)).agg(text)


def last_number(text: Column) -> Column:
    """The last word that is a number."""
    return F.element_at(F.concat(F.array(F.lit(None).cast("int")), F.transform(F.regexp_extract_all(text, F.lit(r"(?<!\S)(\d{1,9})(?!\S)"), F.lit(1)), lambda x: x.cast("int"))), -1)


def duration_rows(table: DataFrame, label: str, years: str, months: str, days: str) -> DataFrame:
    """Rows with a label and all three numbers; others go."""
    out = table.select("doc_id", "page", "row", F.nullif(F.trim(label), F.lit("")).alias("label"), *[last_number(F.col(c)).alias(n) for c, n in ((years, "years"), (months, "months"), (days, "days"))])
    return out.where("label is not null and years is not null and months is not null and days is not null")


def nearest_number(labels: DataFrame, words: DataFrame, dx: float = 8.0, dy: float = 1.0, rise: float = 2.39) -> DataFrame:
    """labels (doc_id, page, label_id, x0, x1, y0) with the number whose middle is within dx, and whose y is within dy of ``rise`` above.

    The nearest in y wins, then the leftmost; none: null. Words of a page meet labels of that page alone.
    """
    numbers = words.where(F.col("text").rlike(r"^\d+$")).select("doc_id", "page", ((F.col("x0") + F.col("x1")) / 2).alias("nx"), F.col("x0").alias("n0"), F.col("y0").alias("ny"), F.col("text").cast("int").alias("number"))
    off = F.abs(F.col("ny") - (F.col("y0") - rise))
    near = labels.join(numbers, ["doc_id", "page"]).where((F.abs(F.col("nx") - (F.col("x0") + F.col("x1")) / 2) <= dx) & (off <= dy))
    best = near.groupBy("doc_id", "page", "label_id").agg(F.min_by("number", F.struct(off.alias("off"), "n0", "number")).alias("number"))
    return labels.join(best, ["doc_id", "page", "label_id"], "left")


def continued(anchors: DataFrame, words: DataFrame, right: float = 520.0, dy: float = 3.0) -> DataFrame:
    """anchors (doc_id, page, anchor_id, x1, y0) with the words to their right on the same line, in order, as ``rest``."""
    w = words.select("doc_id", "page", F.col("x0").alias("wx"), F.col("y0").alias("wy"), F.col("text").alias("word"))
    near = anchors.join(w, ["doc_id", "page"]).where((F.col("wx") > F.col("x1")) & (F.col("wx") < right) & (F.abs(F.col("wy") - F.col("y0")) <= dy))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("wx", "word"))), lambda x: x["word"]), " ")
    return anchors.join(near.groupBy("doc_id", "page", "anchor_id").agg(text.alias("rest")), ["doc_id", "page", "anchor_id"], "left")


def block_bounds(anchors: DataFrame, markers: DataFrame, above: float = 3.0) -> DataFrame:
    """anchors (doc_id, page, y) with top and bottom: bottom is the first marker below before the next anchor, else that anchor, else infinity."""
    w = Window.partitionBy("doc_id", "page").orderBy(F.asc_nulls_last("y"))  # an anchor without a place is before none
    spans = anchors.withColumn("next", F.coalesce(F.lead("y").over(w), F.lit(float("inf"))))
    m = markers.select("doc_id", "page", F.col("y").alias("my"))
    first = spans.join(m, ["doc_id", "page"]).where((F.col("my") > F.col("y")) & (F.col("my") < F.col("next"))).groupBy("doc_id", "page", "y").agg(F.min("my").alias("my"))
    return spans.join(first, ["doc_id", "page", "y"], "left").select("doc_id", "page", "y", (F.col("y") - above).alias("top"), F.coalesce("my", "next").alias("bottom"))


def wrapped(labels: DataFrame, step: float = 9.0, tolerance: float = 1.5) -> DataFrame:
    """labels (doc_id, page, y, text) with group: a line joins the one above if it lies one line step below it."""
    w = Window.partitionBy("doc_id", "page").orderBy("y", "text")
    opens = F.coalesce((F.abs(F.col("y") - F.lag("y").over(w) - step) > tolerance).cast("int"), F.lit(1))
    return labels.withColumn("opens", opens).withColumn("group", F.sum("opens").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).drop("opens")


def duty_blocks(words: DataFrame, anchors: Sequence[str], markers: Sequence[str], above: float = 3.0) -> DataFrame:
    """(doc_id, page, block, top, bottom, period_start, period_end, reject_reason): the blocks of a page, from 0 in the order of their anchors.

    An anchor is a word of ``anchors`` by itself. Its block reaches from ``above`` over it to the first word of ``markers`` below it, to the next
    anchor, or to the page's end, whichever is first. The first two dates (dd/mm/yyyy, by y and x) are the period. A block with fewer has
    the reason ``dates``, one with an impossible date (31/02) ``date``; their periods are null.
    """
    word = F.trim("text")
    order = Window.partitionBy("doc_id", "page").orderBy("y0", "x0", "text")
    spans = words.where(word.isin(*anchors)).select("doc_id", "page", "y0", (F.row_number().over(order) - 1).alias("block"), F.coalesce(F.lead("y0").over(order), F.lit(float("inf"))).alias("next"))
    ends = words.where(word.isin(*markers)).select("doc_id", "page", F.col("y0").alias("end"))
    inside = (F.col("end") > F.col("y0")) & (F.col("end") < F.col("next"))
    spans = spans.join(ends, ["doc_id", "page"], "left").groupBy("doc_id", "page", "block", "y0", "next").agg(F.min(F.when(inside, F.col("end"))).alias("end"))
    spans = spans.select("doc_id", "page", "block", (F.col("y0") - above).alias("top"), F.coalesce("end", "next").alias("bottom"))
    dates = words.where(word.rlike("^[0-9]{2}/[0-9]{2}/[0-9]{4}$"))
    found = within_blocks(dates, spans).groupBy("doc_id", "page", "block").agg(F.array_sort(F.collect_list(F.struct("y0", "x0", F.trim("text").alias("text")))).alias("d"))
    out = spans.join(found, ["doc_id", "page", "block"], "left")
    start, end = (F.try_to_date(F.get("d", F.lit(i))["text"], "dd/MM/yyyy") for i in (0, 1))
    few, odd = F.coalesce(F.size("d"), F.lit(0)) < 2, start.isNull() | end.isNull()
    reason = F.when(few, "dates").when(odd, "date")
    return out.select("doc_id", "page", "block", "top", "bottom", F.when(reason.isNull(), start).alias("period_start"), F.when(reason.isNull(), end).alias("period_end"), reason.alias("reject_reason"))


def within_blocks(words: DataFrame, blocks: DataFrame) -> DataFrame:
    """words with the ``block`` that they lie in: top <= y0 < bottom. Blocks may share words, as one begins a little above its anchor.

    The page is the key of the join, and its size bounds what meets; y only decides among a page's few blocks.
    """
    on = ["doc_id", "page"]
    met = words.join(blocks.select(*on, "block", "top", "bottom"), on).where((F.col("y0") >= F.col("top")) & (F.col("y0") < F.col("bottom")))
    return met.drop("top", "bottom")


def positional_duties(words: DataFrame, anchors: Sequence[str], markers: Sequence[str], label_x: float = 418.56, label_dx: float = 2.0, number_x: float = 530.8, number_dx: float = 8.0, rise: float = 2.39, number_dy: float = 1.0, line_dy: float = 3.0, right: float = 520.0, step: float = 9.0, step_dy: float = 1.5) -> DataFrame:
    """(doc_id, page, period_start, period_end, duties: array of (label, days)) of every block with a period (see ``duty_blocks``).

    words: doc_id, page, x0, y0, x1, y1, text. A word at ``label_x`` begins a line of a label, which goes on with the words to its right before ``right`` on the same
    line; a line that lies one ``step`` below the last line of a label goes on with that label. A label's days are the digits whose middle is at ``number_x``
    and that lie ``rise`` above its first line, the nearest if there are several, and null if there are none. Duties are in the order of y. A block without
    labels has an empty array. Two blocks of a page with the same period end the query with an error, as nothing tells which evaluation they belong to.

    A page's words come together by one sort, and tasks read whole pages in Arrow batches; words and blocks meet by binary search in the order of y, so
    the work grows with the words and not with blocks times words.
    """
    word, x0 = F.trim("text"), F.coalesce("x0", F.lit(float("-inf")))
    used = words.where("doc_id is not null and page is not null and y0 is not null and not isnan(y0) and text is not null")
    used = used.where(word.isin(*anchors, *markers) | (F.substring(word, 3, 1) == "/") | (x0 >= label_x - label_dx))
    used = used.select("doc_id", "page", x0.alias("x0"), F.coalesce("x1", F.lit(float("nan"))).alias("x1"), "y0", word.alias("word"))
    used = used.withColumn("place", F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("page")))  # brings pages together; tasks order their words
    form = _Form(list(anchors), list(markers), label_x, label_dx, number_x, number_dx, right, line_dy, rise, number_dy, line_dy, step, step_dy)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_pages(batches):
            yield from _duties(t, form).to_batches()

    keys = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in used.select("doc_id", "page").schema)
    blocks = used.mapInArrow(found, f"{keys}, first string, second string, alike boolean, duties array<struct<label:string,days:int>>")
    start, end = (F.try_to_date(c, "dd/MM/yyyy") for c in ("first", "second"))
    whole = blocks.select("doc_id", "page", start.alias("period_start"), end.alias("period_end"), "alike", "duties").where("period_start is not null and period_end is not null")
    said = F.concat(F.lit("two blocks with the period "), F.col("period_start").cast("string"), F.lit(".."), F.col("period_end").cast("string"), F.lit(" on page "), F.col("page").cast("string"), F.lit(" of "), F.col("doc_id").cast("string"))
    return whole.withColumn("period_start", F.when(F.col("alike"), F.raise_error(said).cast("date")).otherwise(F.col("period_start"))).drop("alike")


#: Words that a task looks at together; a page is never parted.
_WORDS_AT_ONCE = 65536


class _Form(NamedTuple):
    anchors: list[str]
    markers: list[str]
    label_x: float
    label_dx: float
    number_x: float
    number_dx: float
    right: float
    above: float
    rise: float
    number_dy: float
    line_dy: float
    step: float
    step_dy: float


def _whole_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole pages from batches in the order of pages; place is 1 in a page's first row."""
    held, n = [], 0
    for b in batches:
        firsts = np.flatnonzero(b["place"].to_numpy() == 1)
        if n >= _WORDS_AT_ONCE and len(firsts):
            yield pa.Table.from_batches([*held, b.slice(0, firsts[-1])])
            b = b.slice(firsts[-1])
            held, n = [], 0
        held.append(b)
        n += b.num_rows
    if n:
        yield pa.Table.from_batches(held)


def _in_order(major: np.ndarray, minor: np.ndarray) -> np.ndarray:
    """Numbers that compare by major, then by minor, as complex ones do."""
    out = np.empty(len(major), complex)
    out.real, out.imag = major, minor
    return out


def _ranges(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(i, place) for each place from low[i] to before high[i]."""
    n = np.maximum(high - low, 0)
    i = np.repeat(np.arange(len(n)), n)
    return i, np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + low[i]


def _level(block: np.ndarray, y: np.ndarray, other_block: np.ndarray, other_y: np.ndarray, dy: float) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) of the same block with abs(other_y[j] - y[i]) <= dy. The search is a little wider than dy, and the difference decides."""
    order = np.lexsort((other_y, other_block))
    among = _in_order(other_block[order], other_y[order])
    wide = dy + 1e-6 * (1 + np.abs(y))
    i, j = _ranges(np.searchsorted(among, _in_order(block, y - wide)), np.searchsorted(among, _in_order(block, y + wide), "right"))
    j = order[j]
    same = np.abs(other_y[j] - y[i]) <= dy
    return i[same], j[same]


def _duties(t: pa.Table, z: _Sizes) -> pa.Table:
    """The blocks with two dates of a table of whole pages; alike: another block of the page has the same dates."""
    coded = t["word"].combine_chunks().dictionary_encode()
    vocabulary, code = coded.dictionary, coded.indices.to_numpy()
    x, x1, y, place = (t[c].to_numpy() for c in ("x0", "x1", "y0", "place"))
    page = np.cumsum(place == 1)
    by_y = np.lexsort((y, page))
    x, x1, y, page, code = x[by_y], x1[by_y], y[by_y], page[by_y], code[by_y]

    def spelled(of_word: pa.Array) -> np.ndarray:
        """What holds for a word's text, for each row."""
        return of_word.to_numpy(zero_copy_only=False)[code]

    text = np.empty(len(vocabulary), np.int64)
    text[pc.array_sort_indices(vocabulary).to_numpy()] = np.arange(len(text))
    text = text[code]
    is_number = pc.match_substring_regex(vocabulary, r"^[0-9]{1,9}(?:\r?\n|\r)?$")
    number = spelled(pc.cast(pc.utf8_trim_whitespace(pc.if_else(is_number, vocabulary, "0")), pa.int32()))
    beside = (x >= z.label_x - z.label_dx) & spelled(pc.not_equal(vocabulary, ""))
    middle = np.abs((x + x1) / 2 - z.number_x) <= z.number_dx

    anchor, marker = (np.flatnonzero(spelled(pc.is_in(vocabulary, pa.array(w, pa.string())))) for w in (z.anchors, z.markers))
    next_y = np.full(len(anchor), np.inf)
    same_page = page[anchor[1:]] == page[anchor[:-1]]
    next_y[:-1][same_page] = y[anchor[1:]][same_page]
    m = np.searchsorted(_in_order(page[marker], y[marker]), _in_order(page[anchor], y[anchor]), "right")
    has = np.flatnonzero(m < len(marker))
    end = marker[m[has]]
    has, end = (v[(page[end] == page[anchor[has]]) & (y[end] < next_y[has])] for v in (has, end))
    bottom = next_y.copy()
    bottom[has] = y[end]
    tops, bottoms = _in_order(page[anchor], y[anchor] - z.above), _in_order(page[anchor], bottom)

    def inside(some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(block, row) of some rows: top <= y < bottom, and both rise along a page."""
        rows = np.flatnonzero(some)
        at = _in_order(page[rows], y[rows])
        i, block = _ranges(np.searchsorted(bottoms, at, "right"), np.searchsorted(tops, at, "right"))
        return block, rows[i]

    block, row = inside(spelled(pc.match_substring_regex(vocabulary, r"^[0-9]{2}/[0-9]{2}/[0-9]{4}(?:\r?\n|\r)?$")))
    order = np.lexsort((text[row], x[row], y[row], block))
    dated = row[order]
    dates = np.bincount(block, minlength=len(anchor))
    whole = np.flatnonzero(dates >= 2)
    first = (np.cumsum(dates) - dates)[whole]
    first, second = dated[first], dated[first + 1]
    order = np.lexsort((text[second], text[first], page[first]))
    a, b = order[:-1], order[1:]
    twice = (page[first[a]] == page[first[b]]) & (text[first[a]] == text[first[b]]) & (text[second[a]] == text[second[b]])
    alike = np.zeros(len(whole), bool)
    alike[a[twice]] = alike[b[twice]] = True

    head_block, head = inside(beside & (np.abs(x - z.label_x) <= z.label_dx))
    kept = dates[head_block] >= 2
    head_block, head = head_block[kept], head[kept]
    order = np.lexsort((text[head], x[head], y[head], head_block))
    head_block, head = head_block[order], head[order]
    opens = np.ones(len(head), bool)
    opens[1:] = (head_block[1:] != head_block[:-1]) | (np.abs(y[head[1:]] - y[head[:-1]] - z.step) > z.step_dy)
    label = np.cumsum(opens) - 1
    label_block, label_y = head_block[opens], y[head[opens]]

    more_block, more = inside(beside & (x < z.right))
    i, j = _level(head_block, y[head], more_block, y[more], z.line_dy)
    j = more[j]
    right_of = x[j] > x[head[i]]
    i, j = i[right_of], j[right_of]
    line, spoken = np.concatenate((np.arange(len(head)), i)), np.concatenate((head, j))
    after = np.repeat([0, 1], (len(head), len(i)))
    order = np.lexsort((text[spoken], y[spoken], x[spoken], after, line))
    said = vocabulary.take(pa.array(code[spoken[order]]))
    lengths = np.bincount(label[line], minlength=len(label_y))
    texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(lengths))), pa.int32()), said), " ")

    number_block, digits = inside(beside & middle & spelled(is_number))
    i, j = _level(label_block, label_y - z.rise, number_block, y[digits], z.number_dy)
    j = digits[j]
    off = np.abs(y[j] - (label_y - z.rise)[i])
    order = np.lexsort((number[j], x[j], off, i))
    i, at = np.unique(i[order], return_index=True)
    days, known = np.zeros(len(label_y), np.int32), np.zeros(len(label_y), bool)
    days[i], known[i] = number[j[order[at]]], True
    each = pa.StructArray.from_arrays([texts, pa.array(days, mask=~known)], ["label", "days"])
    labels = np.bincount(label_block, minlength=len(anchor))[whole]
    duties = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(labels))), pa.int32()), each)
    keys = t.select(["doc_id", "page"]).take(pa.array(by_y[anchor[whole]]))
    values = {"first": vocabulary.take(pa.array(code[first])), "second": vocabulary.take(pa.array(code[second])), "alike": pa.array(alike), "duties": duties}
    return pa.Table.from_arrays([*keys.columns, *values.values()], [*keys.column_names, *values])
