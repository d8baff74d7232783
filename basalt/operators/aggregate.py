"""Grouped and global aggregation, HAVING, DISTINCT."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sum_double(column: Column | str) -> Column:
    """SUM accumulates in double precision, as the dialect has it."""
    return F.sum((F.col(column) if isinstance(column, str) else column).cast("double"))


def stddev(column: Column | str) -> Column:
    """STDDEV is the population's."""
    return F.stddev_pop(column)


def aggregate(rows: DataFrame, by: list[Column | str], aggs: dict[str, Column], having: Column | None = None) -> DataFrame:
    """Hash aggregate with partial sums before the shuffle; without keys there
    is one row, also over no input.  ``having`` may use the results' names."""
    made = [c.alias(name) for name, c in aggs.items()]
    out = rows.groupBy(*by).agg(*made) if by else rows.agg(*made)
    return out.filter(having) if having is not None else out


def salted_sum(rows: DataFrame, by: list[str], column: str, salts: int = 16) -> DataFrame:
    """Sums of hot keys in two steps, where partial aggregation is not enough
    (for instance after an exchange on the same key)."""
    part = rows.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)))
    return part.groupBy(*by, "_salt").agg(F.sum(column).alias(column)).groupBy(*by).agg(F.sum(column).alias(column))


def distinct(rows: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return rows.select(*columns).distinct() if columns else rows.distinct()
