"""SQL type names and their Spark types."""

from __future__ import annotations

import re

from pyspark.sql import types as T

_PLAIN = {
    "SMALLINT": T.ShortType(), "INTEGER": T.IntegerType(), "INT": T.IntegerType(), "BIGINT": T.LongType(), "REAL": T.FloatType(), "FLOAT": T.FloatType(),
    "DOUBLE": T.DoubleType(), "DOUBLE PRECISION": T.DoubleType(), "BOOLEAN": T.BooleanType(), "BOOL": T.BooleanType(), "TEXT": T.StringType(),
    "VARCHAR": T.StringType(), "DATE": T.DateType(), "TIMESTAMP": T.TimestampNTZType(), "BYTEA": T.BinaryType(),
    "SERIAL": T.IntegerType(), "BIGSERIAL": T.LongType(),
}
SERIALS = {"SERIAL", "BIGSERIAL"}


def spark_type(name: str) -> T.DataType:
    """Spark type of a SQL type name such as ``DECIMAL(12,2)`` or ``VARCHAR(20)``.

    Lengths of VARCHAR and CHAR are kept; DECIMAL is (10,0) without arguments
    and CHAR is CHAR(1).
    """
    text = re.sub(r"\s+", " ", name.strip().upper())
    m = re.fullmatch(r"(VARCHAR|CHAR|CHARACTER|DECIMAL|NUMERIC|CHARACTER VARYING) ?(?:\( ?(\d+) ?(?:, ?(\d+) ?)?\))?", text)
    if m and m[1] in ("DECIMAL", "NUMERIC"):
        return T.DecimalType(int(m[2] or 10), int(m[3] or 0))
    if m and m[1] in ("CHAR", "CHARACTER"):
        return T.CharType(int(m[2] or 1))
    if m and m[2]:
        return T.VarcharType(int(m[2]))
    if m:
        return T.StringType()
    if text not in _PLAIN:
        raise ValueError(f"unknown type {name}")
    return _PLAIN[text]


def stored_type(kind: T.DataType) -> T.DataType:
    """Type in data files: strings carry no length there."""
    return T.StringType() if isinstance(kind, (T.CharType, T.VarcharType)) else kind


def sql_name(kind: T.DataType) -> str:
    return stored_type(kind).simpleString()
