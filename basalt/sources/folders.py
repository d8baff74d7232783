"""Fresh folders that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def fresh(spark: SparkSession, prefix: str) -> str:
    """A new path under ``spark.checkpoint.dir``, or, where that is unset on a
    single machine, under a local temporary folder."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        base = "file://" + tempfile.mkdtemp(prefix="basalt-")
    if base.startswith("/"):
        base = "file://" + base
    return f"{base.rstrip('/')}/{prefix}-{uuid.uuid4().hex}"
