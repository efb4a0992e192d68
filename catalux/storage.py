"""Tables in the folder that driver and executors share: cuts of lineage that survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder only where it is unset, as in tests."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    return path.rstrip("/") if path else "file://" + tempfile.mkdtemp(prefix="catalux-")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/catalux/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
