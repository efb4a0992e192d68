"""Where assets go and where they are: first destination rows with their names, and the location that serves an asset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import hashing, text
from .checks import route
from .records import canonical_source


def valid_source(sources: DataFrame) -> Column:
    """A source row that may stand for its asset: taken, ready, hashed like the asset, there, and of an approved format."""
    there = ~F.coalesce("trashed", F.lit(False)) & ~F.coalesce("is_missing", F.lit(False)) & ~F.coalesce(F.col("accessibility_status").isin("INACCESSIBLE", "ERROR"), F.lit(False))
    known = (F.col("decision") == "TAKE") & (F.col("processing_status") == "READY") & (F.lower("content_hash") == F.col("asset_hash"))
    return F.coalesce(known & there & (F.col("size_bytes") >= 0) & route("file_extension", "mime_type").isNotNull(), F.lit(False))


def plan(assets: DataFrame, links: DataFrame, sources: DataFrame, folder: str, version: str, original_names: bool = False) -> DataFrame:
    """A first destination row for each asset (asset_id, content_hash) with a valid source; others have none.

    ``links``: asset_id, file_id; ``sources``: a row for each file. Of an asset's valid sources the least by folder and file is taken.
    Names are made of the asset, or with ``original_names`` of the source's name where that is safe.
    """
    linked = links.join(assets.select("asset_id", F.lower("content_hash").alias("asset_hash")), "asset_id").join(sources, "file_id")
    valid = linked.where(valid_source(linked))
    chosen = canonical_source(valid.select("asset_id", "folder_id", "file_id", F.lit(None).cast("long").alias("preferred_id"))).select("asset_id", "file_id")
    df = valid.dropDuplicates(["asset_id", "file_id"]).join(chosen, ["asset_id", "file_id"])
    ext = text.destination_extension("file_extension")
    name = text.destination_name(F.md5(F.col("asset_id").cast("string")), ext, F.col("file_name") if original_names else None)
    key = lambda label: hashing.idempotency_key(F.col("asset_id").cast("string"), F.lit(folder), F.lit(version), label)
    snapshot = F.to_json(F.struct("file_id", "folder_id", F.lit("SHA-256").alias("hash_algorithm"), F.col("size_bytes").alias("expected_bytes"), F.lower("mime_type").alias("mime_type"), ext.alias("file_extension")))
    out = df.withColumns({"category": route("file_extension", "mime_type"), "filename": name})
    return out.select(
        key("destination-record").alias("id"), "asset_id", F.col("file_id").alias("selected_file_id"), F.lit(folder).alias("destination_folder_id"), "filename", F.concat_ws("/", "category", "filename").alias("relative_path"),
        F.lit(version).alias("migration_version"), key("asset-destination").alias("idempotency_key"), F.lit("NOT_STARTED").alias("upload_status"), F.lit("SOURCE_HASH_VERIFIED").alias("verification_level"),
        F.col("size_bytes").alias("expected_bytes"), F.lit(0).cast("long").alias("transferred_bytes"), F.col("asset_hash").alias("source_sha256"), F.lit(0).alias("attempts"), snapshot.alias("source_snapshot"),
    )


def located(assets: DataFrame, destinations: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """asset_id, reason, and where an asset is served from: file_id, filename, mime_type, extension, size_bytes, version_tag.

    ``assets``: asset_id, active, file_name, mime_type, file_extension, size_bytes. The first verified destination by id serves
    (destination_file_id, destination_filename, verified_at); without one, and only if ``sources`` are given, the least file that is
    neither trashed nor missing. What a row doesn't say is the asset's. Inactive assets are nowhere.
    """
    verified = (F.col("upload_status") == "VERIFIED") & (F.col("destination_file_id") != "")
    d = destinations.groupBy("asset_id").agg(F.count("*").alias("n"), F.min(F.when(verified, F.struct("id", "destination_file_id", "destination_filename", "verified_at"))).alias("d"))
    df = assets.join(d, "asset_id", "left")
    if sources is None:
        df = df.withColumn("s", F.lit(None).cast("struct<file_id: string, file_name: string, mime_type: string, file_extension: string, size_bytes: bigint>"))
    else:
        usable = sources.where("not coalesce(trashed, false) and not coalesce(is_missing, false) and file_id is not null")
        first = F.min_by(F.struct(F.col("file_id").cast("string").alias("file_id"), "file_name", "mime_type", "file_extension", "size_bytes"), F.col("file_id"))
        df = df.join(usable.groupBy("asset_id").agg(first.alias("s")), "asset_id", "left")
    said = lambda *columns: F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in columns])
    reason = F.when(~F.col("active"), "inactive_asset").when(F.col("d").isNotNull(), "destination").when(F.col("s").isNotNull(), "source_fallback").when(F.col("n").isNotNull(), "no_verified_destination_or_fallback").otherwise("no_destination")
    df = df.withColumn("reason", reason)
    pick = lambda there, source: F.when(F.col("reason") == "destination", there).when(F.col("reason") == "source_fallback", source)
    return df.select(
        "asset_id", "reason", pick(F.col("d.destination_file_id"), F.col("s.file_id")).alias("file_id"),
        pick(F.coalesce(said("d.destination_filename", "file_name"), F.lit("download")), F.coalesce(said("s.file_name", "file_name"), F.lit("download"))).alias("filename"),
        pick(F.coalesce(said("mime_type"), F.lit("application/octet-stream")), F.coalesce(said("s.mime_type", "mime_type"), F.lit("application/octet-stream"))).alias("mime_type"),
        pick(F.col("file_extension"), said("s.file_extension", "file_extension")).alias("extension"),
        pick(F.col("size_bytes"), F.coalesce(F.nullif("s.size_bytes", F.lit(0)), "size_bytes")).alias("size_bytes"),
        pick(F.coalesce(F.col("d.verified_at").cast("string"), F.col("d.id").cast("string")), F.lit("source")).alias("version_tag"),
    )
