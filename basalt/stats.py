"""ANALYZE: statistics of a table's columns in one pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def column_statistics(rows: DataFrame, columns: list[str] | None = None, buckets: int = 10, exact: bool = False) -> DataFrame:
    """``column_name, row_count, null_count, distinct_count, min_value,
    max_value, bounds``: one aggregate over all rows, turned to one row for each
    column.  ``bounds`` are the edges of an equi-height histogram (numbers
    only); the distinct count is approximate unless ``exact``.
    """
    names = columns or rows.columns
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    points = [i / buckets for i in range(buckets + 1)]
    aggs = [F.count("*").alias("n")]
    for i, c in enumerate(names):
        col = F.col(f"`{c}`")
        orderable = not isinstance(kinds[c], (T.MapType, T.ArrayType, T.BinaryType))
        aggs += [
            F.count(col).alias(f"k{i}"), (F.count_distinct(col) if exact else F.approx_count_distinct(col)).alias(f"d{i}"),
            (F.min(col) if orderable else F.lit(None)).cast("string").alias(f"a{i}"), (F.max(col) if orderable else F.lit(None)).cast("string").alias(f"z{i}"),
            (F.percentile_approx(col.cast("double"), points) if isinstance(kinds[c], T.NumericType) else F.lit(None)).cast("array<double>").alias(f"h{i}"),
        ]
    one = rows.agg(*aggs)
    entries = [
        F.struct(
            F.lit(c).alias("column_name"), F.col("n").alias("row_count"), (F.col("n") - F.col(f"k{i}")).alias("null_count"), F.col(f"d{i}").alias("distinct_count"),
            F.col(f"a{i}").alias("min_value"), F.col(f"z{i}").alias("max_value"), F.col(f"h{i}").alias("bounds"),
        )
        for i, c in enumerate(names)
    ]
    return one.select(F.inline(F.array(*entries)))


def selectivity(bounds: list[float], low: float | None, high: float | None) -> float:
    """Share of rows between two values by an equi-height histogram."""
    if not bounds or len(bounds) < 2:
        return 1.0

    def below(x: float) -> float:
        if x <= bounds[0]:
            return 0.0
        for i, (a, b) in enumerate(zip(bounds, bounds[1:])):
            if x < b:
                return (i + ((x - a) / (b - a) if b > a else 0.0)) / (len(bounds) - 1)
        return 1.0

    return max(0.0, (1.0 if high is None else below(high)) - (0.0 if low is None else below(low)))
