"""One incremental run as a plan: classes of files, decisions, canonical assets, links, destination rows, events and totals.

``judge`` says of every file what the run makes of it; ``tables`` derives the new snapshot of each table from that. Snapshot in,
snapshot out, so a run can be repeated. Reading files is the work of others: ``discovered`` carries their results, a content_hash
or a failure with whether it may be retried; new assets get a destination row that waits for its transfer (outcome PLANNED).

A batch holds whole folders: stored files of a folder in the batch that weren't discovered are removed, other folders are left alone.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import records, rules, sync

SEEN = "folder_id long, file_name string, mime_type string, file_extension string, size_bytes long, relative_path string, modified_at string, checksum string"
FILES = f"file_id long, {SEEN}, content_hash string, is_missing boolean, decision string, skip_reason string, hash_status string, sync_classification string, sync_status string, attempts int, failure_reason string"
DISCOVERED = f"file_id long, {SEEN}, accessible boolean, content_hash string, failure string, retryable boolean"
ASSETS = "content_hash string, first_file_id long, mime_type string, file_extension string, size_bytes long"
LINKS = "content_hash string, file_id long, relationship_type string"
DESTINATIONS = "content_hash string, destination_folder_id string, category_folder string, idempotency_key string, upload_status string, attempts int, verification_level string"
MOST_ATTEMPTS = 5
UNFINISHED = ("FAILED", "AWAITING_RETRY", "PROCESSING")
_SEEN = [x.split()[0] for x in SEEN.split(", ")]
_KEPT = [x.split()[0] for x in FILES.split(", ")[1:]]


def empty(spark: SparkSession) -> dict[str, DataFrame]:
    """The tables before the first run."""
    return {n: spark.createDataFrame([], s) for n, s in (("files", FILES), ("assets", ASSETS), ("links", LINKS), ("destinations", DESTINATIONS))}


def judge(discovered: DataFrame, state: dict[str, DataFrame], policy: rules.Rules = rules.Rules(), failed_folders: DataFrame | None = None) -> DataFrame:
    """A row for each file in scope: classification, outcome, reason, and what its row, asset and link become."""
    folders = discovered.select("folder_id").distinct()
    if failed_folders is not None:
        folders = folders.unionByName(failed_folders.select("folder_id")).distinct()
    stored = state["files"].join(folders, "folder_id", "left_semi")
    classes = sync.classify(discovered, stored, failed_folders)
    new = discovered.select("file_id", *[F.col(c).alias(f"d_{c}") for c in (*_SEEN, "content_hash", "failure", "retryable")])
    old = stored.select("file_id", *[F.col(c).alias(f"s_{c}") for c in _KEPT])
    df = classes.join(new, "file_id", "left").join(old, "file_id", "left")
    again = (F.col("classification") == "UNCHANGED") & F.col("s_sync_status").isin(*UNFINISHED) & F.col("s_sync_classification").isin("NEW", "CHANGED")
    again = F.coalesce(again, F.lit(False))
    df = df.withColumn("work", F.when(again, F.col("s_sync_classification")).when(F.col("classification").isin("NEW", "CHANGED"), F.col("classification")))
    flags = {"accessibility_status": F.lit("accessible"), "trashed": F.lit(False), "is_missing": F.lit(False), "is_folder": F.lit(False)}
    asked = df.select("file_id", "classification", "work", *[F.col(f"d_{c}").alias(c) for c in ("file_name", "mime_type", "file_extension", "size_bytes", "relative_path")]).withColumns(flags)
    decided = rules.decide(asked, policy).select("file_id", F.col("decision").alias("ruled"), "reason_code")
    df = df.join(decided, "file_id")
    taken = F.col("work").isNotNull() & (F.col("ruled") == "TAKE")
    df = df.withColumns({"taken": taken, "hash": F.when(taken & F.col("d_failure").isNull(), F.col("d_content_hash"))})
    # the first file of a content that no asset has yet makes the asset: two counts a content, no group is gathered
    first = df.where("hash is not null").groupBy("hash").agg(F.min("file_id").alias("first"))
    known = state["assets"].select(F.col("content_hash").alias("hash"), F.lit(True).alias("known"))
    df = df.join(first.join(known, "hash", "left"), "hash", "left").withColumn("creates", F.col("hash").isNotNull() & F.col("known").isNull() & (F.col("first") == F.col("file_id")))
    attempts = F.least(F.lit(MOST_ATTEMPTS), F.coalesce("s_attempts", F.lit(0)) + 1)
    failed = F.col("taken") & F.col("hash").isNull()
    retry = F.coalesce("d_retryable", F.lit(False)) & (attempts < MOST_ATTEMPTS)
    outcome = (
        F.when(F.col("work").isNull(), F.col("classification")).when(~F.col("taken"), "SKIPPED").when(failed & retry, "AWAITING_RETRY").when(failed, "FAILED").when(F.col("creates"), "PLANNED").otherwise("LINKED_DUPLICATE")
    )
    reason = F.when(F.col("work").isNotNull() & ~F.col("taken"), F.col("reason_code")).when(failed, F.coalesce("d_failure", F.lit("Hashing did not complete")))
    return df.withColumns({"outcome": outcome, "reason": reason, "now_attempts": F.when(failed, attempts)})


def _file_rows(judged: DataFrame) -> DataFrame:
    """The row of each judged file; a file that can't be read and isn't known has none."""
    work, o = F.col("work").isNotNull(), F.col("outcome")
    seen = work & F.col("d_folder_id").isNotNull()
    failed = o.isin("AWAITING_RETRY", "FAILED")
    pick = {c: F.when(seen, F.col(f"d_{c}")).otherwise(F.col(f"s_{c}")) for c in _SEEN}
    pick["content_hash"] = F.when(F.col("hash").isNotNull(), F.col("hash")).when(failed, F.lit(None)).otherwise(F.col("s_content_hash"))
    pick["is_missing"] = F.when(o == "REMOVED_FROM_SOURCE", True).when(work, False).otherwise(F.col("s_is_missing"))
    pick["decision"] = F.when(work, F.col("ruled")).otherwise(F.col("s_decision"))
    pick["skip_reason"] = F.when(o == "SKIPPED", F.col("reason")).when(work, F.lit(None)).otherwise(F.col("s_skip_reason"))
    pick["hash_status"] = F.when(F.col("hash").isNotNull(), "HASHED").when(o == "AWAITING_RETRY", "FAILED_RETRYABLE").when(o == "FAILED", "FAILED_PERMANENT").otherwise(F.col("s_hash_status"))
    pick["sync_classification"] = F.when(o == "INACCESSIBLE", F.col("s_sync_classification")).otherwise(F.coalesce("work", "classification"))
    pick["sync_status"] = F.when(o == "INACCESSIBLE", F.col("s_sync_status")).when(failed, o).otherwise("COMPLETED")
    pick["attempts"] = F.coalesce("now_attempts", "s_attempts", F.lit(0)).cast("int")
    pick["failure_reason"] = F.when(failed, F.col("reason")).when(work, F.lit(None)).otherwise(F.col("s_failure_reason"))
    return judged.where((o != "INACCESSIBLE") | F.col("s_folder_id").isNotNull()).select("file_id", *[pick[c].alias(c) for c in _KEPT])


def _details(columns: Iterable[Column | str]) -> Column:
    return F.to_json(F.struct(*columns))


def events(judged: DataFrame) -> DataFrame:
    """file_id, event_type, event_status, details: changed versions taken, failures, new and reused assets."""
    e = lambda rows, kind, status, *d: rows.select("file_id", F.lit(kind).alias("event_type"), status.alias("event_status"), _details(d).alias("details"))
    failed = judged.where("outcome in ('AWAITING_RETRY', 'FAILED')")
    changed = e(judged.where("work = 'CHANGED' and taken"), "SOURCE_CHANGED", F.lit("INFO"), F.col("s_content_hash").alias("prior_sha256"), F.col("s_modified_at").alias("prior_modified_at"), F.col("d_modified_at").alias("modified_at"))
    lost = e(failed, "UPLOAD_FAILED", F.when(F.col("outcome") == "FAILED", "ERROR").otherwise("WARNING"), (F.col("outcome") == "AWAITING_RETRY").alias("retryable"), F.col("now_attempts").alias("attempt"), "reason")
    made = e(judged.where("creates"), "LIFECYCLE_INITIALIZED", F.lit("SUCCESS"), F.col("hash").alias("content_hash"))
    reused = e(judged.where("outcome = 'LINKED_DUPLICATE'"), "UPLOAD_VERIFIED", F.lit("SUCCESS"), F.lit("REUSED_EXISTING_ASSET").alias("adapter_outcome"))
    return changed.unionByName(lost).unionByName(made).unionByName(reused)


def totals(judged: DataFrame) -> DataFrame:
    """One row of a run's counters."""
    c, o = F.col("classification"), F.col("outcome")
    n = lambda x: F.count_if(x)
    return judged.agg(
        F.count_distinct(F.coalesce("d_folder_id", "s_folder_id")).alias("sources_checked"), F.count("d_folder_id").alias("files_discovered"),
        n(c == "NEW").alias("new_files_detected"), n(c == "CHANGED").alias("changed_files_detected"), n(c == "UNCHANGED").alias("unchanged_files_ignored"),
        n(o == "SKIPPED").alias("files_skipped"), F.count("hash").alias("files_hashed"), n(o == "LINKED_DUPLICATE").alias("exact_duplicates_found"), n("creates").alias("unique_assets_created"),
        F.count("hash").alias("relationships_created_or_reused"), n(o == "LINKED_DUPLICATE").alias("existing_assets_reused"), n(o == "FAILED").alias("failed_files"), n(o == "AWAITING_RETRY").alias("retried_files"),
        n(o.isin("FAILED", "AWAITING_RETRY")).alias("unresolved_exceptions"), n(c == "REMOVED_FROM_SOURCE").alias("removed_from_source"), n(c == "INACCESSIBLE").alias("inaccessible"),
    )


def tables(judged: DataFrame, state: dict[str, DataFrame], destination: str, version: str) -> dict[str, DataFrame]:
    """New snapshots of files, assets, links and destinations, and the run's outcomes and events. ``judged`` should be stored: all read it."""
    files = state["files"].join(judged.select("file_id"), "file_id", "left_anti").unionByName(_file_rows(judged))
    made = judged.where("creates").select(F.col("hash").alias("content_hash"), F.col("file_id").alias("first_file_id"), *[F.col(f"d_{c}").alias(c) for c in ("mime_type", "file_extension", "size_bytes")])
    hashed = judged.where("hash is not null").select(F.col("hash").alias("content_hash"), "file_id", F.when(F.col("creates"), "ORIGINAL").otherwise("DUPLICATE").alias("relationship_type"))
    moved = state["links"].join(hashed.select("file_id", F.col("content_hash").alias("_to")), "file_id", "left").where("_to is null or _to = content_hash").drop("_to")
    links = moved.unionByName(hashed.join(moved.select("file_id", "content_hash"), ["file_id", "content_hash"], "left_anti"))
    return {
        "files": files, "assets": state["assets"].unionByName(made), "links": links,
        "destinations": state["destinations"].unionByName(records.lifecycle_rows(made, destination, version).withColumn("attempts", F.col("attempts").cast("int"))),
        "outcomes": judged.select("file_id", "classification", "outcome", "reason"), "events": events(judged), "totals": totals(judged),
    }
