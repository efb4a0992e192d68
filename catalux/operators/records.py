"""Rows that are built for other tables, joins and reports over them, and the slot for models."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import hashing
from .checks import route
from .rules import media_category
from .sync import instant

CLASSES = {"supported_media": ("TAKE", "READY"), "unsupported": ("SKIP", "SKIPPED"), "inaccessible": ("PENDING", "INACCESSIBLE")}


def source_file_rows(items: DataFrame, folder: str, run: str, report_sha256: str, seen_at: Column) -> DataFrame:
    """Rows of source files from inventory items; folders give none."""
    of = lambda n: F.create_map(*[F.lit(x) for k, v in CLASSES.items() for x in (k, v[n])])[F.col("classification")]
    none = F.lit(None).cast("string")
    meta = F.to_json(F.struct(F.col("classification").alias("classification"), F.col("accessibility_status").alias("accessibility_status"), F.lit("INVENTORY").alias("import_type"), F.lit(report_sha256).alias("report_sha256")))
    return items.where(F.col("classification").isin(*CLASSES)).select(
        F.lit(folder).alias("source_folder_id"), F.lit(run).alias("last_scan_run_id"), "file_id", F.col("name").alias("file_name"), "mime_type", "file_extension", F.col("size").alias("size_bytes"), none.alias("md5_checksum"), "modified_time", "relative_folder_path",
        of(0).alias("decision"), of(1).alias("processing_status"), F.when(F.col("classification") == "unsupported", "Unsupported by inventory classification").alias("skip_reason"), F.lit(False).alias("trashed"), F.lit(False).alias("is_missing"), seen_at.alias("last_seen_at"), meta.alias("metadata"),
    )


def scan_run_row(items: DataFrame, folder: str, errors: int, started_at: Column) -> DataFrame:
    """The row of a run that has just begun, from its items."""
    kind = lambda k: F.count_if(F.col("classification") == k)
    zero = F.lit(0).cast("long")
    return items.agg(F.count_if(F.col("classification") != "folder").alias("files_discovered"), kind("supported_media").alias("files_taken"), kind("unsupported").alias("files_skipped"), kind("inaccessible").alias("inaccessible_items"), (kind("folder") + 1).alias("folders_scanned")).select(
        F.lit(folder).alias("source_folder_id"), F.lit("DRY_RUN").alias("run_mode"), F.lit("RUNNING").alias("status"), started_at.alias("started_at"), "*", zero.alias("files_uploaded"), zero.alias("duplicates_found"), F.lit(errors).cast("long").alias("files_failed")
    )


def canonical_source(links: DataFrame) -> DataFrame:
    """(asset_id, file_id, preferred): of an asset's valid sources (asset_id, folder_id, file_id, preferred_id) the preferred one, else the least."""
    wanted = F.coalesce(F.col("file_id") == F.col("preferred_id"), F.lit(False))
    best = links.groupBy("asset_id").agg(F.min(F.struct((~wanted).alias("other"), "folder_id", "file_id")).alias("x"))
    return best.select("asset_id", F.col("x.file_id").alias("file_id"), (~F.col("x.other")).alias("preferred"))


def asset_rows(groups: DataFrame, files: DataFrame) -> DataFrame:
    """Rows of new assets from canonical groups (content_hash, canonical_file_id) and the files they name."""
    meta = F.to_json(F.struct(F.lit("SHA-256").alias("hash_algorithm"), F.col("canonical_file_id"), media_category("mime_type", "file_extension").alias("media_category")))
    both = groups.join(files.withColumnRenamed("file_id", "canonical_file_id").drop("content_hash", "folder_id"), "canonical_file_id")
    pending = F.lit("PENDING")
    return both.select("content_hash", F.col("content_hash").alias("checksum_sha256"), "file_name", F.col("file_name").alias("original_file_name"), "mime_type", "file_extension", "size_bytes", pending.alias("upload_status"), pending.alias("migration_status"), F.lit(0).alias("upload_attempts"), meta.alias("metadata"))


def lifecycle_rows(assets: DataFrame, folder: str, version: str) -> DataFrame:
    """First rows of destinations: assets of an approved format with a digest; the others are left out."""
    to = route("file_extension", "mime_type")
    ok = assets.withColumn("category_folder", to).where(F.col("category_folder").isNotNull() & F.col("content_hash").rlike("^[0-9a-f]{64}$"))
    return ok.select("content_hash", F.lit(folder).alias("destination_folder_id"), "category_folder", hashing.idempotency_key(F.col("content_hash"), F.lit(folder), F.lit(version), "asset-destination").alias("idempotency_key"), F.lit("NOT_STARTED").alias("upload_status"), F.lit(0).alias("attempts"), F.lit("SOURCE_HASH_VERIFIED").alias("verification_level"))


def staging_rows(jobs: DataFrame, results: DataFrame) -> DataFrame:
    """A record for each job; without a result the fields of results are null."""
    r = results.withColumn("_done", F.lit(True))
    df = jobs.join(r, "asset_id", "left")
    provenance = F.to_json(F.struct(F.col("content_hash").alias("content_sha256"), F.when(F.col("_done"), "prepared local media and trusted metadata").alias("evidence")))
    return df.select("job_id", "asset_id", "file_name", "media_type", *[c for c in results.columns if c != "asset_id"], provenance.alias("provenance"), F.when(F.col("_done"), "STAGED").otherwise("FAILED").alias("result_state"))


#: Fields of an import that a report owns; the times among them are compared as instants.
IMPORT_FIELDS = (
    "file_id", "file_name", "mime_type", "file_extension", "size_bytes", "checksum", "created_at", "modified_at", "view_link",
    "thumbnail_link", "parent_folder_id", "relative_path", "decision", "processing_status", "processing_error", "skip_reason", "trashed", "is_missing",
)
IMPORT_TIMES = ("created_at", "modified_at")


def import_changes(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """``changed_fields`` over all fields of an import but the key. The stored rows may have further columns."""
    times = {c: instant(c) for c in IMPORT_TIMES}
    return changed_fields(existing.withColumns(times), incoming.withColumns(times), "file_id", [c for c in IMPORT_FIELDS if c != "file_id"])


def changed_fields(existing: DataFrame, incoming: DataFrame, key: str, compared: list[str]) -> DataFrame:
    """(key, action, changed): INSERT, UPDATE with the names of the fields that differ, or UNCHANGED."""
    old = existing.select(key, F.struct(*compared).alias("_old"))
    diff = F.filter(F.array(*[F.when(~F.col(f"_old.{c}").eqNullSafe(F.col(c)), F.lit(c)) for c in compared]), lambda x: x.isNotNull())
    action = F.when(F.col("_old").isNull(), "INSERT").when(F.size("_d") > 0, "UPDATE").otherwise("UNCHANGED")
    df = incoming.join(old, key, "left").withColumn("_d", diff)
    return df.select(key, action.alias("action"), F.when(F.col("_old").isNotNull(), F.array_join("_d", ",")).otherwise("").alias("changed"))


def update_from(target: DataFrame, source: DataFrame, key: str, *columns: str) -> DataFrame:
    """``target`` with ``columns`` of the row of ``source`` with its key, if there is one; keys of ``source`` are unique."""
    new = source.select(key, F.struct(*columns).alias("_new"))
    df = target.join(new, key, "left")
    return df.select(*[F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in target.columns])


def linked(left: DataFrame, right: DataFrame, key: str, condition: Column | None = None) -> DataFrame:
    """Left join; with a condition on the right side an inner one, as rows without it can't meet the condition."""
    return left.join(right, key, "left") if condition is None else left.join(right.where(condition), key)


SORTS = {"newest": ("updated_at", False), "oldest": ("updated_at", True), "smallest": ("size_bytes", True), "largest": ("size_bytes", False)}


def page(df: DataFrame, sort: str, number: int, size: int, key: str = "id") -> DataFrame:
    """A page in one of four orders, nulls last, ties by id, each row with total, total_pages (1 at least) and the page's number.

    A page beyond the last has no rows. The offset is the feature: Spark keeps offset + size rows of each task.
    """
    c, up = SORTS.get(sort, SORTS["newest"])
    rows = df.orderBy(F.col(c).asc_nulls_last() if up else F.col(c).desc_nulls_last(), key).offset((number - 1) * size).limit(size)
    n = df.agg(F.count("*").alias("total")).withColumn("total_pages", F.greatest(F.lit(1), F.ceil(F.col("total") / size)).cast("long"))
    return rows.crossJoin(F.broadcast(n)).withColumn("page", F.least(F.lit(number), "total_pages").cast("long"))  # one row


def ordered_json(df: DataFrame, by: str, columns: tuple[str, ...], *order: str) -> DataFrame:
    """(by, n, doc): the rows of each key as a JSON array in a stated order; a key's rows are one value."""
    rows = F.array_sort(F.collect_list(F.struct(*order, *[c for c in columns if c not in order])))
    return df.groupBy(by).agg(F.count("*").alias("n"), F.to_json(F.transform(rows, lambda x: F.struct(*[x[c].alias(c) for c in columns]))).alias("doc"))


def surplus(df: DataFrame, *keys: str) -> DataFrame:
    """One row: keys that repeat and how many rows are more than one a key."""
    g = df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
    return g.agg(F.count("*").alias("groups"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long").alias("surplus"))


def together(jobs: DataFrame, valid: Column, embedding: Column, metadata: Column) -> DataFrame:
    """Both outputs of a job and its new status, or neither."""
    ok = F.coalesce(valid, F.lit(False))
    return jobs.select("asset_id", F.when(ok, embedding).alias("embedding"), F.when(ok, metadata).alias("metadata"), F.when(ok, "INDEXED").otherwise("FAILED_RETRYABLE").alias("status"))


def cached(requests: DataFrame, cache: DataFrame, now: Column, minutes: int = 15) -> DataFrame:
    """``requests`` (text, model) with ``hit``: whether a stored vector of the same text and model is young enough."""
    young = cache.where(F.col("created_at") > now - F.make_dt_interval(mins=F.lit(minutes))).select("text", "model").distinct().withColumn("hit", F.lit(True))
    return requests.join(young, ["text", "model"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def with_model(df: DataFrame, model: Callable[[], Callable[[pd.Series], pd.Series]], text: str, out: str, kind: str) -> DataFrame:
    """``df`` with a column that a model makes of texts, batch by batch; ``model`` loads it, once in a worker's task."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = model()
        for b in batches:
            yield known(b)

    return df.withColumn(out, F.pandas_udf(run, kind)(F.col(text)))
