"""Writers. What replaces something older is a new version in a folder of its own, published by a marker that is written last.

A version is never written over, so readers (``readers.published``) see whole versions only, and a job that fails
before its marker leaves the version before it in place.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.details import sanitized


def publish(tables: dict[str, DataFrame], folder: str, version: str, kind: str = "parquet") -> None:
    """Write tables that belong together, and then the marker that makes them the version that readers see."""
    place = f"{version}-{uuid.uuid4().hex}"
    for name, df in tables.items():
        df.write.mode("errorifexists").format(kind).save(f"{folder}/{place}/{name}")
    one = next(iter(tables.values())).sparkSession.range(1)
    one.select(F.lit(version).alias("version"), F.lit(place).alias("folder"), F.current_timestamp().alias("at")).coalesce(1).write.mode("append").json(f"{folder}/_published")


def report(df: DataFrame, path: str, version: str = "report") -> None:
    """A JSON report that takes the place of the one before."""
    publish({"report": df}, path, version, "json")


def scan_report(df: DataFrame, folder: str) -> None:
    """JSON and CSV side by side, never over an older pair."""
    df.write.mode("errorifexists").json(f"{folder}/json")
    flat = [F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in df.dtypes]
    df.select(*flat).write.mode("errorifexists").option("header", True).csv(f"{folder}/csv")


def staging(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def events(df: DataFrame, path: str, details: str = "details") -> None:
    """Append events without the secrets in their details (``details.sanitized``)."""
    df.withColumn(details, sanitized(details)).write.mode("append").parquet(path)


def snapshot(df: DataFrame, path: str, version: str = "snapshot") -> None:
    """A new version of a table; ``df`` may read the version before it."""
    publish({"table": df}, path, version)


def completed(index: DataFrame, embeddings: DataFrame, folder: str, version: str) -> None:
    """Two tables that belong together, published at once."""
    publish({"index": index, "embeddings": embeddings}, folder, version)
