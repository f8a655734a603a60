"""A set of words as a filter of fixed size, in built-in functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Slots of a filter, a byte each: what reaches the driver, and goes into plans and (as hexadecimal digits) their descriptions, has this size at most.
SLOTS = 1 << 17


class WordSet:
    """Whether a word may be among the words of a table: never no for one that is; a join on the word decides in the end.

    A word's hash names a slot. With few words in the table nearly all others are ruled out; with many millions, few are, and the
    join does more of the work. The bytes of the slots are one constant, however many words there are.
    """

    def __init__(self, table: DataFrame, column: str, slots: int | None = None):
        self.n = slots or SLOTS
        found = table.select(self._slot(F.col(column)).alias("slot")).distinct().toArrow()["slot"].to_pylist()
        marks = bytearray(self.n)
        for slot in found:
            marks[slot] = 1
        self.marks = F.lit(bytes(marks)) if found else None

    def _slot(self, word: Column) -> Column:
        return F.pmod(F.xxhash64(word), F.lit(self.n)).cast("int")

    def may_have(self, word: Column) -> Column:
        if self.marks is None:
            return F.lit(False)
        return F.substring(self.marks, self._slot(word) + 1, F.lit(1)) == F.lit(b"\x01")
