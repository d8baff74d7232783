"""COPY between files and tables: TEXT, CSV and BINARY (Parquet)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basalt.types import stored_type

#: Escapes of the TEXT format, in the order in which they are undone.
ESCAPES = (("\\t", "\t"), ("\\n", "\n"), ("\\r", "\r"), ("\\b", "\b"), ("\\f", "\f"), ("\\v", "\v"))


def _typed(rows: DataFrame, schema: T.StructType) -> DataFrame:
    return rows.select(*[F.col(f.name).cast(stored_type(f.dataType)).alias(f.name) for f in schema.fields])


def read_text(spark: SparkSession, path: str, schema: T.StructType, delimiter: str = "\t", null: str = "\\N") -> DataFrame:
    r"""Lines of delimited fields; ``\N`` is NULL, ``\.`` alone ends the data."""
    lines = spark.read.text(path).filter(F.col("value") != "\\.")
    parts = F.split("value", "(?<!\\\\)" + "".join("\\" + c if not c.isalnum() and c != "\t" else c for c in delimiter), -1)
    columns = []
    for i, f in enumerate(schema.fields):
        raw = F.get(parts, F.lit(i))
        text = F.replace(raw, F.lit("\\\\"), F.lit("\x00"))
        for old, new in ESCAPES:
            text = F.replace(text, F.lit(old), F.lit(new))
        text = F.replace(F.replace(text, F.lit("\\" + delimiter), F.lit(delimiter)), F.lit("\x00"), F.lit("\\"))
        columns.append(F.when(raw != null, text).alias(f.name))
    width = F.size(parts)
    checked = lines.withColumn("value", F.when(width == len(schema), F.col("value")).otherwise(F.raise_error(F.concat(F.lit(f"a line needs {len(schema)} fields: "), "value")).cast("string")))
    return _typed(checked.select(*columns), schema)


def read_csv(spark: SparkSession, path: str, schema: T.StructType, delimiter: str = ",", header: bool = False, null: str = "") -> DataFrame:
    """CSV with quotes; an empty field is NULL."""
    texts = T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])
    rows = spark.read.csv(path, schema=texts, sep=delimiter, header=header, quote='"', escape='"', nullValue=null, mode="FAILFAST", multiLine=False)
    return _typed(rows, schema)


def read_binary(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return _typed(spark.read.parquet(path), schema)


def write_text(rows: DataFrame, path: str, delimiter: str = "\t", null: str = "\\N") -> None:
    fields = []
    for c in rows.columns:
        text = F.replace(F.col(f"`{c}`").cast("string"), F.lit("\\"), F.lit("\\\\"))
        for old, new in ESCAPES:
            text = F.replace(text, F.lit(new), F.lit(old))
        if delimiter != "\t":
            text = F.replace(text, F.lit(delimiter), F.lit("\\" + delimiter))
        fields.append(F.coalesce(text, F.lit(null)))
    rows.select(F.concat_ws(delimiter, *fields).alias("value")).write.text(path)


def write_csv(rows: DataFrame, path: str, delimiter: str = ",", header: bool = False) -> None:
    texts = rows.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in rows.columns])
    texts.write.csv(path, sep=delimiter, header=header, quote='"', escape='"', nullValue="", emptyValue='""')


def write_binary(rows: DataFrame, path: str) -> None:
    rows.write.parquet(path)
