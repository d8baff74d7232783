"""Joins of all kinds, with broadcast only behind a size check."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A side is broadcast on request only if its plan's size estimate is below this.
BROADCAST_BYTES = 64 << 20


def keys(left: DataFrame, right: DataFrame, pairs: dict[str, str]) -> Column:
    """Conjunction of equalities between columns of the two sides."""
    return reduce(lambda a, b: a & b, (left[l] == right[r] for l, r in pairs.items()))


def join(left: DataFrame, right: DataFrame, pairs: dict[str, str] | None = None, how: str = "inner", residual: Column | None = None) -> DataFrame:
    """Equi join with a residual condition that belongs to the join (rows that
    fail it are unmatched, not dropped, in outer joins)."""
    if how == "cross" and not pairs and residual is None:
        return left.crossJoin(right)
    condition = keys(left, right, pairs) if pairs else F.lit(True)
    return left.join(right, condition & residual if residual is not None else condition, how)


def estimated_bytes(rows: DataFrame) -> int:
    return int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def small_side(rows: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """The rows, marked for broadcast if their estimated size is under the limit;
    otherwise Spark's own choice among shuffled joins stands."""
    return F.broadcast(rows) if estimated_bytes(rows) <= limit else rows


def merge_join(left: DataFrame, right: DataFrame, pairs: dict[str, str], how: str = "inner") -> DataFrame:
    """Sort-merge join."""
    return left.join(right.hint("merge"), keys(left, right, pairs), how)


def semi(left: DataFrame, right: DataFrame, pairs: dict[str, str] | None = None, residual: Column | None = None) -> DataFrame:
    return join(left, right, pairs, "left_semi", residual)


def anti(left: DataFrame, right: DataFrame, pairs: dict[str, str] | None = None, residual: Column | None = None) -> DataFrame:
    return join(left, right, pairs, "left_anti", residual)


def null_aware_anti(left: DataFrame, right: DataFrame, column: str, other: str) -> DataFrame:
    """NOT IN (subquery): no rows if the subquery has a NULL, and none with a
    NULL of their own unless the subquery is empty."""
    sides = right.agg(F.count("*").alias("_n"), F.sum(F.col(other).isNull().cast("int")).alias("_nulls"))
    kept = left.join(right, left[column] == right[other], "left_anti").crossJoin(F.broadcast(sides))  # one row
    passes = (F.col("_n") == 0) | ((F.coalesce(F.col("_nulls"), F.lit(0)) == 0) & F.col(column).isNotNull())
    return kept.filter(passes).drop("_n", "_nulls")


def salted(left: DataFrame, right: DataFrame, pairs: dict[str, str], salts: int, how: str = "inner") -> DataFrame:
    """Equi join whose left side has hot keys: its rows are dealt over ``salts``
    parts of a key, and the right side's rows go to every part."""
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError("a salted join keeps or drops rows of the left side only")
    a = left.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int"))
    b = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    out = a.join(b, keys(a, b, pairs) & (a["_salt"] == b["_salt"]), how)
    return out.drop("_salt")
