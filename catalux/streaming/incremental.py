"""New files as streams: what is there is processed once, and a checkpoint remembers it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from .. import storage
from ..operators import rules, sync, sync_run
from ..sources import readers, writers


def arrived(spark: SparkSession, path: str, schema: StructType, kind: str = "json") -> DataFrame:
    return spark.readStream.schema(schema).format(kind).load(path)


def process_available(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Run ``each`` on the batches of what has arrived, then stop. A batch that is repeated has the same number."""
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_available(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append what has arrived to a table, each row once."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def sync_batches(stored: Callable[[], DataFrame], publish: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: classify a discovered snapshot against what is stored, and publish the classes."""

    def each(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            publish(sync.classify(batch, stored()).withColumn("batch", F.lit(number)), number)

    return each


def enqueue(stored: Callable[[], DataFrame], publish: Callable[[DataFrame, int], None], key: str = "asset_id") -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: jobs for keys that have none yet; unsupported MIME types are skipped for good."""

    def each(batch: DataFrame, number: int) -> None:
        m = F.lower(F.coalesce("mime_type", F.lit("")))
        status = F.when(m.startswith("image/") | m.startswith("video/"), "PENDING").otherwise("SKIPPED")
        publish(batch.dropDuplicates([key]).join(stored().select(key), key, "left_anti").withColumn("status", status), number)

    return each


class Overlap(RuntimeError):
    """Another run has published since this one read the tables."""


def synchronize(folder: str, destination: str, version: str = "v1", policy: rules.Rules = rules.Rules()) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: a whole incremental run for each batch of discovered files, published at once.

    All tables of a run lie in one folder, which one marker publishes under the number of the batch. A batch whose marker is there
    is left alone, so a replay after a crash changes nothing: before the marker nothing is visible, after it all is. A run
    that finds another version than the one it read raises ``Overlap`` and publishes nothing.
    """

    def each(batch: DataFrame, number: int) -> None:
        spark, name = batch.sparkSession, f"batch-{number}"
        seen = readers.versions(spark, folder)
        if name in seen:
            return
        state = {t: readers.published(spark, folder, t) if seen else df for t, df in sync_run.empty(spark).items()}
        judged = storage.materialize(sync_run.judge(batch, state, policy), "judged")
        out = sync_run.tables(judged, state, destination, version)
        expected = judged.count()
        out["report"] = sync.reconcile(out["outcomes"], expected).crossJoin(F.broadcast(out["totals"])).withColumn("batch", F.lit(number).cast("long"))  # one row each
        if readers.versions(spark, folder) != seen:
            raise Overlap(f"{folder} has changed while batch {number} ran")
        writers.publish(out, folder, name)

    return each
