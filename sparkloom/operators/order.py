"""Ordering, paging and keyset predicates. NULLs come first ascending and last descending."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import BuildError


@dataclass(frozen=True)
class Order:
    name: str
    descending: bool = False

    def over(self, column: Column) -> Column:
        return column.desc_nulls_last() if self.descending else column.asc_nulls_first()


def Asc(name: str) -> Order:
    return Order(name)


def Desc(name: str) -> Order:
    return Order(name, True)


def check_orders(orders: tuple[Order, ...]) -> None:
    names = [o.name for o in orders]
    if len(set(names)) < len(names):
        raise BuildError("a field is ordered by twice")


def check_page(limit: int | None, offset: int) -> None:
    if limit is not None and limit < 0 or offset < 0:
        raise BuildError("Limit and Offset can't be negative")
    if offset and limit is None:
        raise BuildError("Offset needs Limit")


def page(df: DataFrame, limit: int | None, offset: int) -> DataFrame:
    """Skips, then takes."""
    df = df.offset(offset) if offset else df
    return df if limit is None else df.limit(limit)


def seek(terms: list[tuple[Column, bool, bool, object]]) -> Column:
    """Rows strictly after a cursor. terms: (column, descending, nullable, value) in order."""
    (column, descending, nullable, value), rest = terms[0], terms[1:]
    if value is None:
        if descending:
            return column.isNull() & seek(rest) if rest else F.lit(False)
        return column.isNotNull() | (column.isNull() & seek(rest)) if rest else column.isNotNull()
    beyond = column < value if descending else column > value
    if descending and nullable:
        beyond = beyond | column.isNull()
    return beyond | ((column == value) & seek(rest)) if rest else beyond
