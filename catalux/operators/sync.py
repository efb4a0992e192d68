"""Snapshots: incremental classification, upserts, plans, reconciliation. Snapshot in, snapshot out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import OUTCOMES, TRUSTED_STATES, UNRESOLVED


def instant(c: str) -> Column:
    """Strings as UTC instants where they parse, else as they are."""
    t = F.try_to_timestamp(F.trim(F.col(c)))
    return F.when(t.isNotNull(), F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")).otherwise(F.col(c))


def classify(discovered: DataFrame, stored: DataFrame, failed_folders: DataFrame | None = None) -> DataFrame:
    """(file_id, classification) by a full outer join on the id.

    Both have file_id, modified_at, size_bytes, mime_type, checksum; ``discovered`` has accessible, ``stored`` is_missing. A stored
    file that was not discovered is REMOVED_FROM_SOURCE, unless its folder is in ``failed_folders`` (folder_id), if that is given.
    """
    fields = ("modified_at", "size_bytes", "mime_type", "checksum")
    d = discovered.select("file_id", *[F.col(c).alias(f"d_{c}") for c in fields], F.col("accessible"), F.lit(True).alias("in_d"))
    s = stored.select("file_id", *[F.col(c).alias(f"s_{c}") for c in fields], F.coalesce("is_missing", F.lit(False)).alias("missing"), F.lit(True).alias("in_s"), *(["folder_id"] if failed_folders is not None else []))
    df = d.join(s, "file_id", "full")
    differs = F.lit(False)
    for c in fields[:3]:
        x, y = (instant(f"d_{c}"), instant(f"s_{c}")) if c == "modified_at" else (F.col(f"d_{c}"), F.col(f"s_{c}"))
        differs = differs | ~x.eqNullSafe(y)
    differs = differs | F.coalesce(F.col("d_checksum") != F.col("s_checksum"), F.lit(False))
    removed = F.col("in_d").isNull()
    out = F.when(removed, "REMOVED_FROM_SOURCE").when(~F.coalesce("accessible", F.lit(False)), "INACCESSIBLE").when(F.col("in_s").isNull(), "NEW").when(F.col("missing") | differs, "CHANGED").otherwise("UNCHANGED")
    if failed_folders is not None:
        df = df.join(failed_folders.select("folder_id", F.lit(True).alias("failed")).distinct(), "folder_id", "left").where(~(removed & F.coalesce("failed", F.lit(False))))
    return df.select("file_id", out.alias("classification"))


def trusted_unchanged(classified: DataFrame, stored: DataFrame) -> DataFrame:
    """Unchanged files whose stored state and digest can be relied on."""
    state = F.coalesce("hash_status", "processing_status")
    proof = F.coalesce(F.nullif("content_hash", F.lit("")), F.nullif("destination_file_id", F.lit("")))
    return classified.where("classification = 'UNCHANGED'").join(stored.where(state.isin(*TRUSTED_STATES) & proof.isNotNull()), "file_id", "left_semi")


CLASSES = ("NEW", "CHANGED", "UNCHANGED", "REMOVED_FROM_SOURCE", "INACCESSIBLE")


def class_counts(classified: DataFrame) -> DataFrame:
    """(classification, files) of every class, absent ones with 0."""
    n = classified.groupBy("classification").agg(F.count("*").alias("n"))
    names = classified.sparkSession.createDataFrame([(c,) for c in CLASSES], "classification string")
    return names.join(n, "classification", "left").select("classification", F.coalesce("n", F.lit(0)).cast("long").alias("files"))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(relation, rows) of each table."""
    return reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("relation"), "rows") for name, df in tables.items()])


def count_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(relation, rows_before, rows_after) of the relations whose counts differ; one that a side lacks has null there."""
    b, a = before.withColumnRenamed("rows", "rows_before"), after.withColumnRenamed("rows", "rows_after")
    return b.join(a, "relation", "full").where("not (rows_before <=> rows_after)").select("relation", "rows_before", "rows_after")


def upsert(existing: DataFrame, incoming: DataFrame, key: str, seen: str = "observed_at") -> DataFrame:
    """New snapshot: incoming values win, ``first_seen`` stays, ``last_seen`` is the latest of first_seen and the observation."""
    values = [c for c in incoming.columns if c not in (key, seen)]
    e = existing.select(key, *[F.col(c).alias(f"e_{c}") for c in values], "first_seen", F.col("last_seen").alias("e_last"), F.lit(True).alias("in_e"))
    i = incoming.select(key, *values, seen, F.lit(True).alias("in_i"))
    df = e.join(i, key, "full")
    pick = [F.when(F.col("in_i"), F.col(c)).otherwise(F.col(f"e_{c}")).alias(c) for c in values]
    first = F.coalesce("first_seen", seen)
    return df.select(key, *pick, first.alias("first_seen"), F.when(F.col("in_i"), F.greatest(first, seen)).otherwise(F.col("e_last")).alias("last_seen"))


def insert_missing(existing: DataFrame, incoming: DataFrame, *keys: str) -> DataFrame:
    """Existing rows and the incoming ones of new keys."""
    return existing.unionByName(incoming.join(existing, list(keys), "left_anti"), allowMissingColumns=True)


def plan(existing: DataFrame, incoming: DataFrame, key: str, compared: list[str]) -> DataFrame:
    """(key, action): INSERT, UPDATE or UNCHANGED of each incoming row, by null-safe comparison."""
    e = existing.select(key, F.struct(*compared).alias("old"), F.lit(True).alias("known"))
    same = F.struct(*[F.col(c) for c in compared]).eqNullSafe(F.col("old"))
    return incoming.join(e, key, "left").select(key, F.when(F.col("known").isNull(), "INSERT").when(same, "UNCHANGED").otherwise("UPDATE").alias("action"))


def reconcile(outcomes: DataFrame, expected: int) -> DataFrame:
    """One row: recorded, unresolved, invalid outcomes, repeated ids, and whether the run is clean."""
    a = outcomes.agg(
        F.count("*").alias("recorded"), F.count_if(F.col("outcome").isin(*UNRESOLVED)).alias("unresolved"),
        F.count_if(~F.coalesce(F.col("outcome").isin(*OUTCOMES), F.lit(False))).alias("invalid"), (F.count("file_id") - F.count_distinct("file_id")).alias("repeated"),
    )
    clean = (F.col("invalid") == 0) & (F.col("repeated") == 0) & (F.col("recorded") == expected) & (F.col("unresolved") == 0)
    return a.select(F.lit(expected).cast("long").alias("expected"), "*", clean.alias("clean"), F.when(clean, "RECONCILED").otherwise("CONTRADICTION_OR_EXCEPTION").alias("status"))


def unrelated_fields_unchanged(before: DataFrame, after: DataFrame, key: str, touched: list[str]) -> DataFrame:
    """Keys whose other columns differ between two snapshots, or that only one has."""
    rest = [c for c in before.columns if c != key and c not in touched]
    x = before.select(key, F.struct(*rest).alias("x"), F.lit(1).alias("b"))
    y = after.select(key, F.struct(*rest).alias("y"), F.lit(1).alias("a"))
    return x.join(y, key, "full").where("a is null or b is null or not (x <=> y)").select(key)
