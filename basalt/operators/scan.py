"""Scans: whole tables, key ranges, covering projections and bitmap conditions.

A condition is all that an index scan, an index intersection or a bitmap heap
scan needs here: Catalyst pushes it to the Parquet reader, which prunes row
groups by their footers and reads only the columns asked for.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str, alias: str | None = None) -> DataFrame:
    rows = spark.read.parquet(f"{folder}/{name}.parquet")
    return rows.alias(alias) if alias else rows


def between(column: str, low=None, high=None, low_open: bool = False, high_open: bool = False) -> Column:
    """Range condition; bounds that are None are open-ended."""
    c = F.col(column)
    parts = []
    if low is not None:
        parts.append(c > low if low_open else c >= low)
    if high is not None:
        parts.append(c < high if high_open else c <= high)
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def index_range(rows: DataFrame, column: str, low=None, high=None, residual: Column | None = None, **ends: bool) -> DataFrame:
    """Rows in a key range that also meet a residual condition."""
    found = rows.filter(between(column, low, high, **ends))
    return found.filter(residual) if residual is not None else found


def composite_prefix(rows: DataFrame, equal: dict[str, object], ranged: str | None = None, low=None, high=None) -> DataFrame:
    """Equalities on leading columns, then a range on the next."""
    condition = reduce(lambda a, b: a & b, (F.col(c) == v for c, v in equal.items()), F.lit(True))
    return rows.filter(condition & between(ranged, low, high)) if ranged else rows.filter(condition)


def covering(rows: DataFrame, columns: list[str], condition: Column) -> DataFrame:
    """Only the columns an index covers are read."""
    return rows.filter(condition).select(*columns)


def bitmap_and(*conditions: Column) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def bitmap_or(*conditions: Column) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def values(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Constant rows; no rows and no columns are a single empty row's dummy."""
    return spark.createDataFrame(rows, schema) if schema else spark.range(1).select(F.lit(0).alias("dummy"))
