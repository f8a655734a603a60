"""Scopes: the subject and period that every scoped read is restricted to."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CAREER = "career"


@dataclass(frozen=True)
class Scope:
    """One subject's rows of one period; ``doc_id`` narrows it where a table has that column."""

    person_id: str
    period: str
    doc_id: str | None = None

    def __post_init__(self):
        if not self.person_id or not self.period:
            raise ValueError("a scope needs a subject and a period")

    def rows(self, table: DataFrame) -> DataFrame:
        """Exactly this period's rows."""
        return table.where(self._person() & (F.col("period") == self.period) & self._doc(table))

    def chunks(self, table: DataFrame) -> DataFrame:
        """This period's and the career's rows: what a search may see. The subject always holds."""
        return table.where(self._person() & F.col("period").isin(*dict.fromkeys((self.period, CAREER))) & self._doc(table))

    def _person(self) -> Column:
        return F.col("person_id") == self.person_id

    def _doc(self, table: DataFrame) -> Column:
        return F.col("doc_id") == self.doc_id if self.doc_id is not None and "doc_id" in table.columns else F.lit(True)


class ScopedStore:
    """Tables that can be read through a scope alone."""

    def __init__(self, tables: dict[str, DataFrame]):
        self._tables = tables

    def table(self, name: str, scope: Scope) -> DataFrame:
        return scope.rows(self._tables[name])

    def career(self, name: str, scope: Scope) -> DataFrame:
        """Tables of a whole career: those of the subject, of any period."""
        return self._tables[name].where(F.col("person_id") == scope.person_id)

    def chunks(self, scope: Scope) -> DataFrame:
        return scope.chunks(self._tables["chunks"])


def persons(table: DataFrame) -> DataFrame:
    return table.select("person_id", "name").orderBy("person_id")


def periods(evaluations: DataFrame, person_id: str) -> DataFrame:
    """The periods that a subject has evaluations of, newest first."""
    return evaluations.where(F.col("person_id") == person_id).select("period").distinct().orderBy(F.desc("period"))
