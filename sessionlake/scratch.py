"""Tables between steps, in the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only where the session names no checkpoint folder and runs on one machine.
LOCAL = "file:///tmp/sessionlake-scratch"


def folder(spark: SparkSession, name: str) -> str:
    """A new path below ``spark.checkpoint.dir``."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if not given and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{(given or LOCAL).rstrip('/')}/sessionlake/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: it is computed once, and lost executors cost nothing."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
