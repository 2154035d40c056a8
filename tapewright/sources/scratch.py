"""A folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_own_folder: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path under spark.checkpoint.dir; where that is unset, as in tests on one machine, under a folder of our own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not _own_folder:
            _own_folder.append(tempfile.mkdtemp(prefix="spark-"))
        root = _own_folder[0]
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table there, read again: it is computed once, however often it is used."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
