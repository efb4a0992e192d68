"""Snapshots in buckets by key: an upsert rewrites the buckets it touches, a comparison reads the buckets that differ.

A version is a manifest of at most ``number`` rows (bucket, folder, rows, digest), published by its marker (``writers.publish``). Data files are never
written over: a new version names new folders for rewritten buckets and the old ones for the rest. The digest of a bucket is the sum of
its rows' digests (``hashing.row_digest``) over ``digested`` columns, so equal buckets of two tables are known without reading either.
Choose ``number`` so that a bucket is some hundred MB; a larger one is several files. One writer is assumed.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..functions import hashing
from ..operators import sync
from . import readers, writers

MANIFEST = "bucket int, folder string, rows long, digest string"


@dataclass(frozen=True)
class Buckets:
    spark: SparkSession
    folder: str
    key: str
    digested: tuple[str, ...]
    number: int = 64

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.number)).cast("int")

    def manifest(self, version: str | None = None) -> dict[int, Row]:
        """The rows of a version's manifest by bucket; buckets without rows have none."""
        return {r.bucket: r for r in readers.published(self.spark, self.folder, "manifest", version).collect()}

    def read(self, version: str | None = None, only: set[int] | None = None) -> DataFrame:
        """The rows of a version, or of some of its buckets: others aren't listed."""
        schema = readers.published(self.spark, self.folder, "schema", version).schema
        rows = [r for b, r in self.manifest(version).items() if only is None or b in only]
        return self.spark.read.schema(schema).parquet(*[f"{r.folder}/bucket={r.bucket}" for r in rows]) if rows else self.spark.createDataFrame([], schema)

    def _stored(self, df: DataFrame) -> DataFrame:
        """Write rows to a folder of their own; their part of a manifest."""
        place = f"{self.folder}/data-{uuid.uuid4().hex}"
        df.withColumn("bucket", self.bucket()).hint("rebalance", F.col("bucket")).write.partitionBy("bucket").parquet(place)
        written = self.spark.read.schema(df.withColumn("bucket", F.lit(0)).schema).parquet(place)
        return written.groupBy("bucket").agg(F.count("*").alias("rows"), F.sum(hashing.row_digest(*self.digested)).cast("string").alias("digest")).select("bucket", F.lit(place).alias("folder"), "rows", "digest")

    def write(self, df: DataFrame, version: str) -> None:
        """A version of all rows."""
        writers.publish({"manifest": self._stored(df), "schema": df.limit(0)}, self.folder, version)

    def upsert(self, incoming: DataFrame, version: str, seen: str = "observed_at") -> set[int]:
        """A new version with ``sync.upsert`` applied; the buckets that were rewritten."""
        touched = {r.bucket for r in incoming.select(self.bucket().alias("bucket")).distinct().collect()}  # number at most
        merged = sync.upsert(self.read(only=touched), incoming, self.key, seen)
        old = self.manifest()
        rest = self.spark.createDataFrame([tuple(r) for b, r in old.items() if b not in touched], MANIFEST)
        writers.publish({"manifest": rest.unionByName(self._stored(merged)), "schema": merged.limit(0)}, self.folder, version)
        return touched

    def differing(self, other: Buckets) -> set[int]:
        """Buckets whose rows or digests differ; both tables need the same key, number and digested columns."""
        if (self.key, self.number, self.digested) != (other.key, other.number, other.digested):
            raise ValueError("tables in different buckets")
        mine, theirs = self.manifest(), other.manifest()
        same = lambda b: b in mine and b in theirs and (mine[b].rows, mine[b].digest) == (theirs[b].rows, theirs[b].digest)
        return {b for b in mine.keys() | theirs.keys() if not same(b)}


#: What decides whether a file is unchanged. ``state``: ok, or what keeps it from being so on its side (inaccessible or missing).
COMPARED = ("file_id", "modified_at", "size_bytes", "mime_type", "checksum", "state")


def comparable(files: DataFrame) -> DataFrame:
    """Discovered (with accessible) or stored files (with is_missing), instants in one form: digests are equal where nothing has changed and all is well."""
    state = F.when(F.col("accessible"), "ok").otherwise("inaccessible") if "accessible" in files.columns else F.when(F.coalesce("is_missing", F.lit(False)), "missing").otherwise("ok")
    return files.withColumns({"modified_at": sync.instant("modified_at"), "state": state}).select(*COMPARED)


def changes(discovered: Buckets, stored: Buckets) -> DataFrame:
    """``sync.classify`` of two tables of ``comparable`` files, without the unchanged files of buckets that are equal."""
    only = discovered.differing(stored)
    d = discovered.read(only=only).withColumn("accessible", F.col("state") == "ok")
    return sync.classify(d, stored.read(only=only).withColumn("is_missing", F.col("state") == "missing"))


def classified(discovered: Buckets, stored: Buckets) -> DataFrame:
    """The class of every file: of equal buckets only the ids are read. Files of an equal bucket are all ok: other states differ by side."""
    every = set(discovered.manifest()) - discovered.differing(stored)
    return changes(discovered, stored).unionByName(discovered.read(only=every).select("file_id", F.lit("UNCHANGED").alias("classification")))
