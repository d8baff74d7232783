"""Sort, limit, offset, top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def order(*terms: str) -> list[Column]:
    """``"name"`` or ``"name DESC"``: NULLs first ascending, last descending."""
    out = []
    for t in terms:
        name, _, way = t.partition(" ")
        out.append(F.col(name).desc_nulls_last() if way.upper() == "DESC" else F.col(name).asc_nulls_first())
    return out


def sort(rows: DataFrame, *terms: str) -> DataFrame:
    return rows.orderBy(*order(*terms))


def limit(rows: DataFrame, n: int | None = None, offset: int = 0) -> DataFrame:
    out = rows.offset(offset) if offset else rows
    return out.limit(n) if n is not None else out


def top(rows: DataFrame, n: int, *terms: str, offset: int = 0) -> DataFrame:
    """Top-k: Spark keeps n rows of each partition, never sorting the whole."""
    return limit(sort(rows, *terms), n, offset)


def sorted_within(rows: DataFrame, *columns: str) -> DataFrame:
    """Range-partitioned and sorted rows: a total order over files for later merges."""
    return rows.repartitionByRange(*columns).sortWithinPartitions(*columns)
