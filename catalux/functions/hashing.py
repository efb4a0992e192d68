"""Digests, name-based ids, and order-independent table digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NAMESPACE_URL = "6ba7b8119dad11d180b400c04fd430c8"


def uuid5(name: Column, namespace: str = NAMESPACE_URL) -> Column:
    """Version-5 UUID of ``name``, from the hexadecimal SHA-1."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab89ab89ab89ab"), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") + 1, F.lit(1))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def idempotency_key(asset: Column, folder: Column, version: Column, label: str) -> Column:
    return uuid5(F.concat(F.lit(f"{label}:"), F.concat_ws("|", asset, folder, version)))


def fingerprint(content_hash: Column, updated_at: Column, *identity: str) -> Column:
    """SHA-256 over content identity and model identity; ``updated_at`` counts only where there is no hash."""
    h = F.coalesce(content_hash, F.lit(""))
    return F.sha2(F.concat_ws("|", h, F.when(h == "", F.coalesce(updated_at, F.lit(""))).otherwise(""), *map(F.lit, identity)), 256)


def review_fingerprint(base: Column, searchable: Column, reviewer: Column, at: Column) -> Column:
    """SHA-256 over a fingerprint, the digest of the searchable text, and who reviewed it when."""
    return F.sha2(F.concat_ws("|", base, F.sha2(searchable, 256), reviewer, at), 256)


def row_digest(*columns: str) -> Column:
    """First 64 bits of the SHA-256 of a row as an integer; null differs from every value."""
    parts = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("~")) for c in columns]
    return F.conv(F.left(F.sha2(F.concat_ws("\x1f", *parts), 256), F.lit(15)), 16, 10).cast("decimal(38,0)")


def table_digest(df: DataFrame, *columns: str) -> DataFrame:
    """rows and digest, whatever the order of rows: a sum of row digests, so nothing is gathered or sorted."""
    return df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(row_digest(*columns)), F.lit(0)).cast("string").alias("digest"))
