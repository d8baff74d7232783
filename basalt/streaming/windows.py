"""Structured Streaming over event tables (an extension of the dialect)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basalt.sources.folders import fresh


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """The files of a table as a stream; a table may be one file or a folder."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    if fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(fs_path).isFile():
        return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)
    return spark.readStream.schema(schema).parquet(path)


def _drain(stream: DataFrame, mode: str) -> DataFrame:
    """Runs a stream until its input is used up and returns what it wrote."""
    spark = stream.sparkSession
    place = fresh(spark, "stream")
    name = f"stream_{uuid.uuid4().hex[:8]}"
    if mode == "append":
        stream.writeStream.format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{place}/out")
    # the newest full result of each batch replaces the last one
    batches: list[int] = []

    def keep(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{place}/{name}-{number}")
        batches.append(number)

    stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{place}/state").outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    if not batches:
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(f"{place}/{name}-{max(batches)}")


def tumbling_counts(spark: SparkSession, path: str, width: str) -> DataFrame:
    """``hour, event_type, n, total`` for event-time windows of a width."""
    events = read_events(spark, path).withColumn("at", F.col("ts").cast("timestamp"))
    counted = events.groupBy(F.window("at", width), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return _drain(counted.select(F.col("window.start").cast("timestamp_ntz").alias("hour"), "event_type", "n", "total"), "complete")


def late_filtered(spark: SparkSession, path: str, width: str, lateness: str) -> DataFrame:
    """Windows as they close: rows later than ``lateness`` behind the newest are dropped."""
    events = read_events(spark, path).withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", lateness)
    counted = events.groupBy(F.window("at", width), "event_type").agg(F.count("*").alias("n"))
    return _drain(counted.select(F.col("window.start").cast("timestamp_ntz").alias("hour"), "event_type", "n"), "append")
