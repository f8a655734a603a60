"""Long texts in pieces, cut at the coarsest separator that serves: paragraphs, then lines, then words, then characters."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

#: From coarse to fine; the empty one stands for every character.
SEPARATORS = ("\n\n", "\n", " ", "")


def _cut(text: str, separator: str) -> list[str]:
    """Parts that begin with the separator, but for the first; together they are the text."""
    if not separator:
        return list(text)
    at, begins = 0, [0]
    while (at := text.find(separator, at)) >= 0:
        begins.append(at)
        at += len(separator)
    return [part for a, b in zip(begins, [*begins[1:], len(text)], strict=True) if (part := text[a:b])]


def _packed(parts: Sequence[str], size: int, overlap: int) -> Iterator[str]:
    """Runs of parts of at most ``size`` characters; the next run begins with the last parts of the one before, of at most ``overlap`` characters."""
    run, long = deque(), 0
    for part in parts:
        if run and long + len(part) > size:
            yield "".join(run)
            while long > overlap or long and long + len(part) > size:
                long -= len(run.popleft())
        run.append(part)
        long += len(part)
    if run:
        yield "".join(run)


def pieces(text: str, size: int = 1000, overlap: int = 100, separators: Sequence[str] = SEPARATORS) -> Iterator[str]:
    """A text's pieces, without white space at their ends and without blank ones.

    The text is cut at the first separator that occurs in it. Parts shorter than ``size`` are packed together; one that is not is cut by the separators after that one, and
    stays whole where there is none. So a piece is at most ``size`` long if the last separator is empty, and packing never reaches over a part that was cut again.
    """
    if not 0 <= overlap <= size or size < 1:
        raise ValueError("pieces need a size, and an overlap within it")
    for packed in _recursive(text, size, overlap, tuple(separators)):
        if piece := packed.strip():
            yield piece


def _recursive(text: str, size: int, overlap: int, separators: tuple[str, ...]) -> Iterator[str]:
    which = next((i for i, s in enumerate(separators) if s in text), len(separators) - 1)
    finer, short = separators[which + 1 :], []
    for part in _cut(text, separators[which]):
        if len(part) < size:
            short.append(part)
            continue
        yield from _packed(short, size, overlap)
        short = []
        if finer:
            yield from _recursive(part, size, overlap, finer)
        else:
            yield part
    yield from _packed(short, size, overlap)


@udtf(returnType="piece int, piece_text string", useArrow=True)
class SplitText:
    """A table of a text's pieces, numbered from 0; a text of at most ``beyond`` characters is one piece as it is, a null has none."""

    def eval(self, text: str, beyond: int, size: int, overlap: int) -> Iterator[tuple[int, str]]:
        if text is not None:
            found = [text] if len(text) <= beyond else pieces(text, size, overlap)
            yield from enumerate(found)


def split_long(chunks: DataFrame, beyond: int = 1500, size: int = 1000, overlap: int = 100) -> DataFrame:
    """chunks (text, further columns) with their texts in pieces, by a lateral join with the table function; ``piece`` counts from 0.

    Only texts of more than ``beyond`` characters are cut. A text of white space alone that is longer has no piece. Rows never wait for each other, and nothing is shuffled.
    """
    rest = [c for c in chunks.columns if c != "text"]
    table = SplitText(F.col("text").outer(), F.lit(beyond), F.lit(size), F.lit(overlap))
    return chunks.lateralJoin(table).select(*rest, "piece", F.col("piece_text").alias("text"))
