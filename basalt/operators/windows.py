"""Window calculations that must not gather all rows in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basalt.sources.folders import fresh


def running_total(rows: DataFrame, order: str, value: str, name: str) -> DataFrame:
    """Running sum of integers over a total order of unique keys.

    Rows are range-partitioned by key; each part sums up on its own, and one
    row for each part carries the sums before it.
    """
    spark = rows.sparkSession
    place = fresh(spark, "running-total")
    rows.repartitionByRange(order).withColumn("_part", F.spark_partition_id()).write.parquet(place)
    parts = spark.read.parquet(place)
    sums = parts.groupBy("_part").agg(F.sum(value).alias("_held"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    starts = sums.select("_part", F.coalesce(F.sum("_held").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return parts.join(starts, "_part").withColumn(name, F.sum(value).over(inside) + F.col("_start")).drop("_part", "_start")
