"""Scalar functions with the dialect's semantics, as Column expressions.

All stay inside whole-stage code generation: no Python runs for a row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACES = " \t\n\r"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def length(s, in_bytes: bool = False) -> Column:
    """Characters of a string, or its UTF-8 bytes."""
    return (F.octet_length(_col(s)) if in_bytes else F.length(_col(s))).cast("bigint")


def upper(s) -> Column:
    return F.upper(_col(s))


def lower(s) -> Column:
    return F.lower(_col(s))


def substring(s, start, n=None) -> Column:
    """One-based; start 0 counts as 1, a negative start counts from the end."""
    at = _lit(start)
    at = F.when(at == 0, 1).otherwise(at)
    if n is None:
        return F.substr(_col(s), at)
    size = F.greatest(_lit(n), F.lit(0))
    return F.substr(_col(s), at, size)


def _lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def trim(s) -> Column:
    """Strips Unicode white space from both ends."""
    return F.regexp_replace(_col(s), r"(?U)^\s+|(?U)\s+$", "")


def ltrim(s) -> Column:
    return F.regexp_replace(_col(s), r"^[ \t\n\r]+", "")


def rtrim(s) -> Column:
    return F.regexp_replace(_col(s), r"[ \t\n\r]+$", "")


def concat(*parts) -> Column:
    """NULL if any part is NULL; two parts at least."""
    if len(parts) < 2:
        raise ValueError("CONCAT takes two arguments at least")
    return F.concat(*map(_col, parts))


def absolute(x) -> Column:
    return F.abs(_col(x))


def round_(x, places: int = 0) -> Column:
    """Half away from zero, as a double."""
    return F.round(_col(x), places).cast("double")


def floor(x) -> Column:
    return F.floor(_col(x)).cast("double")


def ceil(x) -> Column:
    return F.ceil(_col(x)).cast("double")


def mod(x, y) -> Column:
    """Remainder with the sign of ``x``; an error if ``y`` is 0."""
    return _col(x) % _lit(y)


def power(x, y) -> Column:
    """An error where the result is no finite number."""
    out = F.pow(_col(x), _lit(y))
    bad = F.isnan(out) | (F.abs(out) == float("inf"))
    return F.when(bad, F.raise_error(F.lit("POWER has no finite result")).cast("double")).otherwise(out)


def sqrt(x) -> Column:
    """An error for negative numbers."""
    c = _col(x).cast("double")
    return F.when(c < 0, F.raise_error(F.lit("SQRT of a negative number")).cast("double")).otherwise(F.sqrt(c))


def coalesce(*cs) -> Column:
    return F.coalesce(*map(_col, cs))


def nullif(a, b) -> Column:
    return F.nullif(_col(a), _lit(b))


def extract(field: str, x) -> Column:
    """YEAR, MONTH, DAY, HOUR, MINUTE or SECOND (whole) as an integer."""
    take = {"YEAR": F.year, "MONTH": F.month, "DAY": F.dayofmonth, "HOUR": F.hour, "MINUTE": F.minute, "SECOND": F.second}
    if field.upper() not in take:
        raise ValueError(f"cannot extract {field}")
    return take[field.upper()](_col(x)).cast("int")


def add_interval(x, months: int = 0, days: int = 0, seconds: float = 0) -> Column:
    """Date or timestamp plus an interval; a month's end is clamped.  A date
    stays a date unless seconds are added."""
    c = _col(x)
    if months or days:
        c = c + F.make_interval(months=F.lit(months), days=F.lit(days))
    if seconds:
        c = c.cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(seconds))
    return c


def days_between(later, earlier) -> Column:
    return F.datediff(_col(later), _col(earlier))


def case(*branches, otherwise=None) -> Column:
    """Searched CASE: ``(condition, value)`` pairs; the first that holds wins."""
    out = None
    for condition, value in branches:
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return out.otherwise(otherwise)


def simple_case(operand, *branches, otherwise=None) -> Column:
    """CASE operand WHEN value: a NULL operand takes the ELSE value."""
    return case(*((_col(operand) == v, r) for v, r in branches), otherwise=otherwise)
