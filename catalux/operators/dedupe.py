"""Exact duplicates and canonical groups. Keys are content hashes; no group is ever gathered."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def canonical_groups(files: DataFrame, keys: tuple[str, ...] = ("content_hash",)) -> DataFrame:
    """One row per content: members, least (folder, file), and whether all sizes agree."""
    least = F.min(F.struct("folder_id", "file_id"))
    return files.where(F.col(keys[-1]).isNotNull()).groupBy(*keys).agg(
        F.count("*").alias("members"), least.alias("least"), F.min("size_bytes").alias("size_bytes"), (F.min("size_bytes").eqNullSafe(F.max("size_bytes"))).alias("sizes_agree")
    ).select(*keys, "members", F.col("least.folder_id").alias("canonical_folder_id"), F.col("least.file_id").alias("canonical_file_id"), "size_bytes", "sizes_agree")


def canonical_links(files: DataFrame, keys: tuple[str, ...] = ("content_hash",)) -> DataFrame:
    """ORIGINAL or DUPLICATE of each hashed file, beside its representative; groups whose sizes differ are left out."""
    groups = canonical_groups(files, keys).where("sizes_agree").select(*keys, "canonical_file_id")
    kind = F.when(F.col("file_id") == F.col("canonical_file_id"), "ORIGINAL").otherwise("DUPLICATE")
    return files.join(groups, list(keys)).select("file_id", "canonical_file_id", kind.alias("relationship_type"))


def exact_duplicates(files: DataFrame, candidates: DataFrame | None = None) -> DataFrame:
    """Each file with the least other file of equal checksum and size among ``candidates``; none: no row.

    The two least ids of a key are enough to leave out the file itself, so a key's files never meet in pairs.
    """
    other = files if candidates is None else candidates
    key = ["checksum", "size_bytes"]
    first = other.where("checksum is not null and size_bytes is not null").groupBy(*key).agg(F.min("file_id").alias("first"))
    rest = other.join(first, key).where("file_id <> first").groupBy(*key).agg(F.min("file_id").alias("second"))
    both = first.join(rest, key, "left")
    match = F.when(F.col("first") != F.col("file_id"), F.col("first")).otherwise(F.col("second"))
    return files.join(both, key).select("file_id", match.alias("duplicate_of")).where("duplicate_of is not null")


def duplicate_groups(df: DataFrame, *keys: str) -> DataFrame:
    """Keys of more than one row; nulls are no key."""
    return df.where(" and ".join(f"{k} is not null" for k in keys)).groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def duplicate_trace(links: DataFrame) -> DataFrame:
    """Sources and folders of each asset."""
    return links.groupBy("asset_id").agg(F.count_distinct("file_id").alias("source_count"), F.count_distinct("folder_id").alias("folder_count")).withColumn("is_duplicate", F.col("source_count") > 1)


def first_in_order(df: DataFrame, key: str, *order) -> DataFrame:
    """The first row of each key in a stated order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")
