"""Inventory rows: strict checks, folder trees, payloads, onboarding."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..schemas import SUMMARY_FIELDS
from ..storage import materialize

ZONED = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})$"


def errors_of(*rules: tuple[str, Column]) -> Column:
    """Names of the rules that hold, in order; a null condition holds."""
    return F.filter(F.array(*[F.when(F.coalesce(c, F.lit(True)), F.lit(n)) for n, c in rules]), lambda x: x.isNotNull())


def item_errors() -> Column:
    """What is wrong with an inventory item."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    status = F.col("accessibility_status")
    return errors_of(
        ("file_id", blank("file_id")), ("name", blank("name")), ("size", F.coalesce(F.col("size") < 0, F.lit(False))),
        ("modified_time", F.col("modified_time").isNotNull() & ~F.coalesce(F.col("modified_time").rlike(ZONED) & F.try_to_timestamp("modified_time").isNotNull(), F.lit(False))),
        ("accessibility_status", ~status.isin("accessible", "inaccessible")), ("classification", ~F.col("classification").isin("folder", "supported_media", "unsupported", "inaccessible")),
        ("accessibility_mismatch", (status == "inaccessible") != (F.col("classification") == "inaccessible")),
    )


def summary_of(items: DataFrame) -> DataFrame:
    """One row of totals, as a report's summary should have them; scanned folders count the root."""
    kind = lambda k: F.count_if(F.col("classification") == k)
    return items.agg(
        F.count("*").alias("total_items"), (kind("folder") + 1).alias("folders_scanned"), kind("folder").alias("folders"), (F.count("*") - kind("folder")).alias("files"),
        kind("supported_media").alias("supported_media"), kind("unsupported").alias("unsupported_files"), kind("inaccessible").alias("inaccessible_items"),
    )


def summary_mismatches(report: DataFrame) -> DataFrame:
    """(field, stated, counted) of the totals that differ, from a report read with ``schemas.INVENTORY_REPORT``."""
    counted = summary_of(report.select(F.explode("items").alias("i")).select("i.*"))
    fields = [f for f in SUMMARY_FIELDS if f != "errors"]
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"summary.{f}").alias("stated"), F.col(f).alias("counted")) for f in fields])
    both = report.select("summary").crossJoin(F.broadcast(counted))  # one row each
    return both.select(F.explode(pairs).alias("p")).select("p.*").where("not (stated <=> counted)")


def positional_mismatches(a: DataFrame, b: DataFrame, index: str, columns: list[str]) -> DataFrame:
    """Positions at which two readings of the same rows differ or one has none."""
    x = a.select(index, F.struct(*columns).alias("x"), F.lit(1).alias("a"))
    y = b.select(index, F.struct(*columns).alias("y"), F.lit(1).alias("b"))
    return x.join(y, index, "full").where("a is null or b is null or not (x <=> y)").select(index)


def folder_paths(edges: DataFrame, root: str) -> DataFrame:
    """(node, depth, path) of what hangs below ``root`` in ``edges`` (parent, node, name), breadth first.

    A level is a join of the last one with the edges; nodes seen before are left out, so cycles end. The loop ends with the
    first empty level.
    """
    spark = edges.sparkSession
    level = seen = spark.createDataFrame([(root, 0, "")], "node string, depth int, path string")
    for d in count(1):
        step = level.select(F.col("node").alias("parent"), "path").join(edges, "parent").select("node", F.lit(d).alias("depth"), F.concat_ws("/", F.nullif("path", F.lit("")), "name").alias("path"))
        level = materialize(step.join(seen.select("node"), "node", "left_anti").groupBy("node", "depth").agg(F.min("path").alias("path")), "tree-level")
        if level.isEmpty():
            break
        seen = seen.unionByName(level)
    return seen


def onboarding_rows(rows: DataFrame) -> DataFrame:
    """Accepted and rejected rows of a manifest: folder_id, active and the reason of a rejection, null for accepted ones."""
    fid, active = text.folder_id("folder_url"), F.coalesce(text.boolean("active"), F.when(F.trim(F.coalesce("active", F.lit(""))) == "", True))
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    reason = F.when(blank("source_name"), "MISSING_SOURCE_NAME").when(fid.isNull(), "INVALID_FOLDER_URL").when(active.isNull(), "INVALID_ACTIVE")
    if "expected_folder_id" in rows.columns:
        reason = reason.when(~blank("expected_folder_id") & (F.trim("expected_folder_id") != fid), "FOLDER_ID_MISMATCH")
    return rows.withColumns({"folder_id": fid, "is_active": active, "reason": reason})
