"""Queries of the engine over the driver's tables, each with SQL of the same meaning where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import storage
from ..functions import details, english, hashing, text, vectors
from ..operators import batchrank, conversation, dedupe, fulltext, inventory, lifecycle, quality, rules, search, shape, sync, termhits
from . import fixtures as fx

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


RULES = rules.Rules(excluded_names=("*3.mov", "f1?.png"), excluded_paths=("*/archive",))
_REASON = """reasons AS (SELECT *, CASE
 WHEN is_folder THEN 'FOLDER_ITEM' WHEN accessibility_status = 'inaccessible' THEN 'INACCESSIBLE' WHEN trashed THEN 'TRASHED_FILE' WHEN is_missing THEN 'MISSING_FILE'
 WHEN mime_type = 'application/vnd.google-apps.shortcut' THEN 'GOOGLE_DRIVE_SHORTCUT' WHEN file_name LIKE '~$%' THEN 'TEMPORARY_FILE' WHEN file_name LIKE '._%' AND file_name LIKE '.\\_%' ESCAPE '\\' THEN 'SYSTEM_FILE'
 WHEN lower(file_name) GLOB '*3.mov' OR lower(file_name) GLOB 'f1?.png' THEN 'EXCLUDED_FILENAME' WHEN lower(relative_path) LIKE '%/archive' THEN 'EXCLUDED_PATH'
 WHEN file_extension = 'heic' THEN 'UNSUPPORTED_EXTENSION' WHEN mime_type = 'application/octet-stream' THEN 'UNSUPPORTED_MIME_TYPE' WHEN size_bytes = 0 THEN 'ZERO_BYTE_FILE' ELSE 'SUPPORTED_FORMAT' END AS reason_code FROM files),
decisions AS (SELECT *, CASE WHEN reason_code IN ('FOLDER_ITEM', 'INACCESSIBLE') THEN 'PENDING' WHEN reason_code = 'SUPPORTED_FORMAT' THEN 'TAKE' ELSE 'SKIP' END AS decision FROM reasons)"""
RULE_COLUMNS = ("file_id", "folder_id", "file_name", "mime_type", "file_extension", "relative_path", "accessibility_status", "size_bytes", "trashed", "is_missing", "is_folder")


def _decided(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    return rules.decide(fx.files(spark, sf_dir, *RULE_COLUMNS, *more), RULES)


@query(fx.with_(fx.FILES, fx.FOLDERS, _REASON) + """, scans AS (SELECT user_id % 25 AS folder_id, max(struct_pack(ts := ts, event_id := event_id)) AS last FROM events GROUP BY 1),
t AS (SELECT folder_id, count(*) AS total_files, count(*) FILTER (WHERE decision = 'TAKE') AS take_files, count(*) FILTER (WHERE decision = 'SKIP') AS skip_files, count(DISTINCT content_hash) AS asset_count FROM decisions GROUP BY folder_id)
SELECT f.folder_id, name, active, CAST(coalesce(total_files, 0) AS BIGINT) AS total_files, CAST(coalesce(take_files, 0) AS BIGINT) AS take_files, CAST(coalesce(skip_files, 0) AS BIGINT) AS skip_files,
 CAST(coalesce(asset_count, 0) AS BIGINT) AS asset_count, s.last.event_id AS latest_scan_id, s.last.ts AS latest_scan_at FROM folders f LEFT JOIN t ON f.folder_id = t.folder_id LEFT JOIN scans s ON f.folder_id = s.folder_id""")
def folder_summary(spark, sf_dir):
    """Per folder: file counts by decision, distinct contents, and the latest scan."""
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    d = _decided(spark, sf_dir, "content_hash")
    totals = d.groupBy("folder_id").agg(F.count("*").alias("total_files"), F.count_if(F.col("decision") == "TAKE").alias("take_files"), F.count_if(F.col("decision") == "SKIP").alias("skip_files"), F.count_distinct("content_hash").alias("asset_count"))
    scans = fx.table(spark, sf_dir, "events").groupBy((F.col("user_id") % 25).alias("folder_id")).agg(F.max(F.struct("ts", "event_id")).alias("last"))
    df = fx.folders(spark, sf_dir).join(totals, "folder_id", "left").join(scans, "folder_id", "left")
    return df.select("folder_id", "name", "active", zero("total_files"), zero("take_files"), zero("skip_files"), zero("asset_count"), F.col("last.event_id").alias("latest_scan_id"), F.col("last.ts").alias("latest_scan_at"))


@query(fx.with_(fx.FILES, _REASON) + """SELECT file_id, decision, reason_code, CASE reason_code WHEN 'FOLDER_ITEM' THEN 'DISCOVERED' WHEN 'INACCESSIBLE' THEN 'INACCESSIBLE' WHEN 'SUPPORTED_FORMAT' THEN 'READY' ELSE 'SKIPPED' END AS target_status,
 CASE WHEN reason_code IN ('UNSUPPORTED_MIME_TYPE', 'ZERO_BYTE_FILE', 'SUPPORTED_FORMAT') THEN CASE WHEN file_extension IN ('mp4', 'mov') THEN 'video' WHEN file_extension IN ('pdf', 'pptx') THEN 'document' ELSE 'image' END END AS media_category FROM decisions""")
def file_decisions(spark, sf_dir):
    """TAKE/SKIP rules over every file."""
    return _decided(spark, sf_dir).select("file_id", "decision", "reason_code", "target_status", "media_category")


@query(fx.with_(fx.FILES, _REASON) + "SELECT decision, reason_code, file_extension, trashed, CAST(count(*) AS BIGINT) AS n FROM decisions GROUP BY ALL")
def decision_change_groups(spark, sf_dir):
    return _decided(spark, sf_dir).groupBy("decision", "reason_code", "file_extension", "trashed").agg(F.count("*").alias("n"))


@query(fx.with_(fx.FILES) + "SELECT file_id, lower(file_name) GLOB '*[13].p*' AS by_name, regexp_full_match(replace(lower(relative_path), chr(92), '/'), 'top/src1.*') AS by_path FROM files")
def glob_exclusions(spark, sf_dir):
    return fx.files(spark, sf_dir, "file_id", "file_name", "relative_path").select("file_id", text.matches_any(F.lower("file_name"), ("*[13].p*",)).alias("by_name"), text.matches_any(text.path("relative_path"), ("top/src1*",)).alias("by_path"))


@query(fx.with_(fx.FILES) + """SELECT folder_id, CASE WHEN mime_type LIKE 'image/%' THEN 'image' WHEN mime_type LIKE 'video/%' THEN 'video' WHEN mime_type = 'application/pdf' OR mime_type LIKE '%presentation%' THEN 'document'
 WHEN file_extension IN ('jpg', 'jpeg', 'png', 'webp') THEN 'image' WHEN file_extension IN ('mp4', 'mov') THEN 'video' WHEN file_extension IN ('pdf', 'pptx') THEN 'document' ELSE 'other' END AS category, CAST(count(*) AS BIGINT) AS n FROM files GROUP BY ALL""")
def media_category_counts(spark, sf_dir):
    return fx.files(spark, sf_dir, "folder_id", "mime_type", "file_extension").groupBy("folder_id", rules.media_category("mime_type", "file_extension").alias("category")).agg(F.count("*").alias("n"))


@query("SELECT CAST(k AS INT) AS status, CASE WHEN k = 404 THEN 'SOURCE_NOT_FOUND' WHEN k IN (401, 403) THEN 'SOURCE_ACCESS_DENIED' WHEN k = 429 THEN 'RATE_LIMITED' WHEN k >= 500 THEN 'FAILED_RETRYABLE' ELSE 'FAILED_PERMANENT' END AS error, k = 429 OR k >= 500 AS retryable, CAST(count(*) AS BIGINT) AS n FROM (SELECT 399 + event_id % 110 AS k FROM events) GROUP BY ALL")
def error_classes(spark, sf_dir):
    e = fx.table(spark, sf_dir, "events").selectExpr("CAST(399 + event_id % 110 AS INT) AS status").withColumn("e", rules.error_class("status"))
    return e.groupBy("status", "e.error", "e.retryable").agg(F.count("*").alias("n"))


@query(fx.with_(fx.FILES) + ", g AS (SELECT content_hash, CAST(count(*) AS BIGINT) AS members, min(struct_pack(folder_id := folder_id, file_id := file_id)) AS m, min(size_bytes) AS size_bytes, min(size_bytes) = max(size_bytes) AS sizes_agree FROM files GROUP BY 1) SELECT content_hash, members, m.folder_id AS canonical_folder_id, m.file_id AS canonical_file_id, size_bytes, sizes_agree FROM g")
def canonical_groups(spark, sf_dir):
    return dedupe.canonical_groups(fx.files(spark, sf_dir, "content_hash", "folder_id", "file_id", "size_bytes"))


@query(fx.with_(fx.FILES) + ", g AS (SELECT content_hash, min(struct_pack(folder_id := folder_id, file_id := file_id)).file_id AS c FROM files GROUP BY 1 HAVING min(size_bytes) = max(size_bytes)) SELECT file_id, c AS canonical_file_id, CASE WHEN file_id = c THEN 'ORIGINAL' ELSE 'DUPLICATE' END AS relationship_type FROM files JOIN g USING (content_hash)")
def canonical_links(spark, sf_dir):
    return dedupe.canonical_links(fx.files(spark, sf_dir, "content_hash", "folder_id", "file_id", "size_bytes"))


@query(fx.with_(fx.FILES) + "SELECT a.file_id, min(b.file_id) AS duplicate_of FROM files a JOIN files b ON a.checksum = b.checksum AND a.size_bytes = b.size_bytes AND a.file_id <> b.file_id WHERE b.file_extension <> 'heic' GROUP BY 1")
def exact_duplicates(spark, sf_dir):
    f = fx.files(spark, sf_dir, "file_id", "checksum", "size_bytes", "file_extension")
    return dedupe.exact_duplicates(f, f.where("file_extension <> 'heic'"))


@query(fx.with_(fx.FILES) + "SELECT checksum, size_bytes, CAST(count(*) AS BIGINT) AS n FROM files GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_groups(spark, sf_dir):
    return dedupe.duplicate_groups(fx.files(spark, sf_dir, "checksum", "size_bytes"), "checksum", "size_bytes")


@query(fx.with_(fx.FILES) + "SELECT content_hash AS asset_id, CAST(count(DISTINCT file_id) AS BIGINT) AS source_count, CAST(count(DISTINCT folder_id) AS BIGINT) AS folder_count, count(DISTINCT file_id) > 1 AS is_duplicate FROM files GROUP BY 1")
def duplicate_trace(spark, sf_dir):
    return dedupe.duplicate_trace(fx.files(spark, sf_dir, "content_hash", "file_id", "folder_id").withColumnRenamed("content_hash", "asset_id"))


@query(fx.with_(fx.DESTINATIONS) + "SELECT asset_id, destination_folder_id, CAST(count(*) AS BIGINT) AS n FROM destinations WHERE destination_file_id IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1")
def dup_key_violations(spark, sf_dir):
    """A partial unique key: broken keys among the rows that have a file."""
    return dedupe.duplicate_groups(fx.destinations(spark, sf_dir).where("destination_file_id is not null"), "asset_id", "destination_folder_id")


_SNAPSHOTS = """s AS (SELECT file_id, relative_path AS modified_at, size_bytes, mime_type, checksum, is_missing FROM files WHERE file_id % 10 <> 0),
d AS (SELECT file_id, relative_path AS modified_at, CASE WHEN file_id % 7 = 0 THEN size_bytes + 1 ELSE size_bytes END AS size_bytes, mime_type, CASE WHEN file_id % 3 = 0 THEN NULL ELSE checksum END AS checksum, accessibility_status = 'accessible' AS accessible FROM files WHERE file_id % 10 <> 1)"""


def _snapshots(spark, sf_dir):
    f = fx.files(spark, sf_dir, "file_id", "relative_path", "size_bytes", "mime_type", "checksum", "is_missing", "accessibility_status").withColumnRenamed("relative_path", "modified_at")
    d = f.where("file_id % 10 <> 1").withColumns({"size_bytes": F.expr("CASE WHEN file_id % 7 = 0 THEN size_bytes + 1 ELSE size_bytes END"), "checksum": F.expr("CASE WHEN file_id % 3 <> 0 THEN checksum END"), "accessible": F.col("accessibility_status") == "accessible"})
    return d, f.where("file_id % 10 <> 0")


_CLASSIFY = """c AS (SELECT coalesce(d.file_id, s.file_id) AS file_id, CASE WHEN d.file_id IS NULL THEN 'REMOVED_FROM_SOURCE' WHEN NOT accessible THEN 'INACCESSIBLE' WHEN s.file_id IS NULL THEN 'NEW'
 WHEN is_missing OR d.size_bytes <> s.size_bytes OR coalesce(d.checksum <> s.checksum, false) THEN 'CHANGED' ELSE 'UNCHANGED' END AS classification FROM d FULL JOIN s ON d.file_id = s.file_id)"""


@query(fx.with_(fx.FILES, _SNAPSHOTS, _CLASSIFY) + "SELECT * FROM c")
def snapshot_diff(spark, sf_dir):
    return sync.classify(*_snapshots(spark, sf_dir))


_OUTCOME = "CASE classification WHEN 'NEW' THEN 'UPLOADED_VERIFIED' WHEN 'CHANGED' THEN 'LINKED_DUPLICATE' ELSE classification END"


@query(fx.with_(fx.FILES, _SNAPSHOTS, _CLASSIFY) + f""", o AS (SELECT file_id, {_OUTCOME} AS outcome FROM c), a AS (SELECT CAST(count(*) AS BIGINT) AS recorded, CAST(count(*) FILTER (WHERE outcome IN ('FAILED', 'AWAITING_RETRY', 'INACCESSIBLE')) AS BIGINT) AS unresolved,
 CAST(count(*) FILTER (WHERE outcome IS NULL OR outcome NOT IN ('UNCHANGED', 'SKIPPED', 'LINKED_DUPLICATE', 'UPLOADED_VERIFIED', 'FAILED', 'AWAITING_RETRY', 'INACCESSIBLE', 'REMOVED_FROM_SOURCE', 'PLANNED')) AS BIGINT) AS invalid, CAST(count(*) - count(DISTINCT file_id) AS BIGINT) AS repeated FROM o)
SELECT CAST(1000 AS BIGINT) AS expected, a.*, invalid = 0 AND repeated = 0 AND recorded = 1000 AND unresolved = 0 AS clean, CASE WHEN invalid = 0 AND repeated = 0 AND recorded = 1000 AND unresolved = 0 THEN 'RECONCILED' ELSE 'CONTRADICTION_OR_EXCEPTION' END AS status FROM a""")
def reconcile_outcomes(spark, sf_dir):
    return sync.reconcile(sync.classify(*_snapshots(spark, sf_dir)).select("file_id", F.expr(_OUTCOME).alias("outcome")), 1000)


@query(fx.with_(fx.FILES, _SNAPSHOTS) + "SELECT d.file_id, CASE WHEN s.file_id IS NULL THEN 'INSERT' WHEN d.size_bytes = s.size_bytes AND d.checksum IS NOT DISTINCT FROM s.checksum THEN 'UNCHANGED' ELSE 'UPDATE' END AS action FROM d LEFT JOIN s ON d.file_id = s.file_id")
def import_plan(spark, sf_dir):
    d, s = _snapshots(spark, sf_dir)
    return sync.plan(s, d, "file_id", ["size_bytes", "checksum", "mime_type", "modified_at"])


@query("SELECT CAST(s_suppkey AS BIGINT) AS k, CASE WHEN s_suppkey % 3 = 0 THEN 'INSERT' WHEN s_suppkey % 5 = 0 THEN 'UPDATE' ELSE 'UNCHANGED' END AS action FROM supplier")
def onboarding_plan(spark, sf_dir):
    s = fx.table(spark, sf_dir, "supplier").selectExpr("CAST(s_suppkey AS BIGINT) AS k", "s_name AS name", "s_nationkey AS folder")
    return sync.plan(s.where("k % 3 <> 0"), s.withColumn("name", F.expr("CASE WHEN k % 5 = 0 THEN upper(concat(name, '!')) ELSE name END")), "k", ["name", "folder"])


@query(fx.with_(fx.FILES) + """SELECT file_id, size_bytes + CASE WHEN file_id % 4 = 0 THEN 5 ELSE 0 END AS size_bytes, TIMESTAMP '2024-01-01' AS first_seen, CASE WHEN file_id % 4 = 0 THEN TIMESTAMP '2024-02-01' ELSE TIMESTAMP '2024-01-01' END AS last_seen FROM files WHERE file_id % 3 <> 0 OR file_id % 4 = 0 AND false
UNION ALL SELECT file_id, size_bytes + 5, TIMESTAMP '2024-02-01', TIMESTAMP '2024-02-01' FROM files WHERE file_id % 3 = 0 AND file_id % 4 = 0""")
def upsert_snapshot(spark, sf_dir):
    """Upsert on a key: the first sighting stays, the last one moves."""
    f = fx.files(spark, sf_dir, "file_id", "size_bytes")
    old = f.where("file_id % 3 <> 0").withColumns({"first_seen": F.expr("TIMESTAMP '2024-01-01'"), "last_seen": F.expr("TIMESTAMP '2024-01-01'")})
    new = f.where("file_id % 4 = 0").withColumns({"size_bytes": F.col("size_bytes") + 5, "observed_at": F.expr("TIMESTAMP '2024-02-01'")})
    return sync.upsert(old, new, "file_id")


@query(fx.with_(fx.DESTINATIONS) + """, x AS (SELECT id, upload_status, destination_file_id, id % 3 AS matches, CASE WHEN id % 2 = 0 THEN destination_file_id ELSE 'other' END AS match_id FROM destinations)
SELECT id, CASE WHEN matches > 1 THEN 'MANUAL_REVIEW' WHEN upload_status = 'VERIFIED' THEN CASE WHEN destination_file_id IS NOT NULL AND matches = 1 THEN 'SKIP' ELSE 'MANUAL_REVIEW' END
 WHEN destination_file_id IS NOT NULL THEN CASE WHEN matches = 1 AND match_id = destination_file_id THEN 'RECOVER' ELSE 'MANUAL_REVIEW' END WHEN matches = 1 THEN 'RECOVER' WHEN upload_status = 'FAILED_RETRYABLE' THEN 'RETRY' WHEN upload_status = 'FAILED_PERMANENT' THEN 'MANUAL_REVIEW' ELSE 'CREATE' END AS action FROM x""")
def lifecycle_actions(spark, sf_dir):
    d = fx.destinations(spark, sf_dir).selectExpr("id", "upload_status", "destination_file_id AS destination_id", "id % 3 AS matches", "CASE WHEN id % 2 = 0 THEN destination_file_id ELSE 'other' END AS match_id")
    return d.select("id", lifecycle.destination_action().alias("action"))


_NOW = "TIMESTAMP '1997-01-01 00:00:00'"


@query(fx.with_(fx.DESTINATIONS) + f"""SELECT id, upload_status AS previous_status, CAST(attempts + 1 AS INT) AS attempts, {_NOW} + INTERVAL 600 SECOND AS claim_expires_at FROM destinations
WHERE attempts < 5 AND (upload_status IN ('NOT_STARTED', 'QUEUED', 'FAILED_RETRYABLE') OR upload_status IN ('CLAIMED', 'UPLOADING') AND claim_expires_at <= {_NOW}) AND (claim_expires_at IS NULL OR claim_expires_at <= {_NOW}) AND (next_retry_at IS NULL OR next_retry_at <= {_NOW})
ORDER BY CASE upload_status WHEN 'QUEUED' THEN 0 WHEN 'FAILED_RETRYABLE' THEN 1 ELSE 2 END, coalesce(next_retry_at, last_attempt_at, created_at), created_at, id LIMIT 50""")
def claim_candidates(spark, sf_dir):
    """The next 50 due rows of a work queue (the limit is the claim's)."""
    return lifecycle.claim(fx.destinations(spark, sf_dir), F.expr(_NOW), "worker", 50, 600).select("id", "previous_status", "attempts", "claim_expires_at")


@query(fx.with_(fx.DESTINATIONS) + f"SELECT id, CASE WHEN id % 2 = 0 AND attempts < 5 THEN 'RETRY' ELSE 'FAILED' END AS status, CASE WHEN id % 2 = 0 AND attempts < 5 THEN {_NOW} + INTERVAL 5 MINUTE END AS next_attempt_at FROM destinations WHERE upload_status = 'CLAIMED'")
def retry_transitions(spark, sf_dir):
    d = fx.destinations(spark, sf_dir).where("upload_status = 'CLAIMED'")
    return lifecycle.fail(d, F.expr(_NOW), F.col("id") % 2 == 0).select("id", "status", "next_attempt_at")


@query("SELECT DISTINCT CAST(event_id % 8 AS INT) AS attempt, CASE event_id % 8 WHEN 1 THEN 3 WHEN 2 THEN 3 WHEN 3 THEN 4 WHEN 4 THEN 8 WHEN 5 THEN 16 END AS delay FROM events")
def retry_schedule(spark, sf_dir):
    a = fx.table(spark, sf_dir, "events").selectExpr("CAST(event_id % 8 AS INT) AS attempt").distinct()
    return a.select("attempt", lifecycle.retry_delay(F.col("attempt"), F.lit(3)).alias("delay"))


@query("SELECT n_name AS lock_name, CAST(n_regionkey AS VARCHAR) AS owner, n_nationkey % 3 = 0 OR n_nationkey % 2 = 0 OR n_nationkey % 3 = 1 AND n_regionkey = 1 AS acquired FROM nation")
def lock_acquire(spark, sf_dir):
    n = fx.table(spark, sf_dir, "nation")
    locks = n.where("n_nationkey % 3 <> 0").selectExpr("n_name AS lock_name", "CASE WHEN n_nationkey % 3 = 1 THEN '1' ELSE 'x' END AS owner", "CASE WHEN n_nationkey % 2 = 0 THEN TIMESTAMP '2024-01-01' ELSE TIMESTAMP '2025-01-01' END AS expires_at")
    requests = n.selectExpr("concat(' ', n_name, ' ') AS lock_name", "CAST(n_regionkey AS STRING) AS owner", "7200 AS lease_seconds")
    return lifecycle.acquire_lock(locks, requests, F.expr("TIMESTAMP '2024-06-01'"))


@query("""WITH x AS (SELECT user_id, event_id, event_type = 'error' AS mismatch, event_type = 'view' AS exhausted, event_type = 'error' AS severe FROM events),
g AS (SELECT *, sum(CASE WHEN mismatch THEN 0 ELSE 1 END) OVER w AS gm, sum(CASE WHEN exhausted THEN 0 ELSE 1 END) OVER w AS ge, count(*) OVER w AS attempted, sum(severe::INT) OVER w AS severe_so_far FROM x WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)),
r AS (SELECT *, sum(mismatch::INT) OVER (PARTITION BY user_id, gm ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS mismatches, sum(exhausted::INT) OVER (PARTITION BY user_id, ge ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS exhaustions FROM g)
SELECT user_id, event_id, CAST(mismatches AS BIGINT) AS mismatches, CAST(exhaustions AS BIGINT) AS exhaustions, CASE WHEN mismatches >= 2 THEN 'TWO_CONSECUTIVE_BYTE_MISMATCHES' WHEN exhaustions >= 3 THEN 'THREE_CONSECUTIVE_RETRY_EXHAUSTIONS' WHEN severe_so_far * 100 >= attempted * 5 THEN 'SEVERE_RATE_5_PERCENT' END AS stop_reason FROM r""")
def stop_conditions(spark, sf_dir):
    e = fx.table(spark, sf_dir, "events").selectExpr("user_id", "event_id", "event_type = 'error' AS mismatch", "event_type = 'view' AS exhausted", "event_type = 'error' AS severe")
    return lifecycle.stop_conditions(e, "user_id", "event_id").select("user_id", "event_id", "mismatches", "exhaustions", "stop_reason")


@query(fx.with_(fx.DESTINATIONS) + """, d AS (SELECT asset_id, count(*) AS n, min(CASE WHEN upload_status = 'VERIFIED' AND destination_file_id IS NOT NULL THEN struct_pack(id := id, f := destination_file_id) END).f AS f FROM destinations GROUP BY 1)
SELECT c_custkey AS asset_id, CASE WHEN c_mktsegment <> 'BUILDING' THEN f END AS file_id, CASE WHEN c_mktsegment = 'BUILDING' THEN 'inactive_asset' WHEN f IS NOT NULL THEN 'destination' WHEN n IS NOT NULL THEN 'no_verified_destination_or_fallback' ELSE 'no_destination' END AS reason FROM customer LEFT JOIN d ON c_custkey = asset_id""")
def resolve_location(spark, sf_dir):
    assets = fx.table(spark, sf_dir, "customer").selectExpr("c_custkey AS asset_id", "c_mktsegment <> 'BUILDING' AS active")
    return lifecycle.resolve_location(assets, fx.destinations(spark, sf_dir))


@query(fx.with_(fx.DESTINATIONS) + """, a AS (SELECT CAST(count(*) AS BIGINT) AS asset_destinations, CAST(count(*) FILTER (WHERE upload_status = 'NOT_STARTED') AS BIGINT) AS not_started, CAST(count(claim_owner) AS BIGINT) AS active_claims, CAST(count(*) FILTER (WHERE upload_status = 'UPLOADED') AS BIGINT) AS uploaded_rows,
 CAST(count(*) FILTER (WHERE upload_status = 'VERIFIED') AS BIGINT) AS verified_rows, CAST(count(destination_file_id) AS BIGINT) AS destination_file_ids, CAST(count(next_retry_at) AS BIGINT) AS retry_scheduled, CAST(count(*) FILTER (WHERE upload_status IN ('FAILED_PERMANENT', 'DESTINATION_CONFLICT', 'MANUAL_REVIEW_REQUIRED')) AS BIGINT) AS terminal_failures,
 CAST(count(*) - count(DISTINCT (asset_id, destination_folder_id)) AS BIGINT) AS duplicate_lifecycle_rows, CAST(count(*) FILTER (WHERE destination_folder_id <> 'd0') AS BIGINT) AS outside_destination_scope FROM destinations)
SELECT *, CAST((SELECT count(DISTINCT asset_id) FROM destinations WHERE asset_id NOT IN (SELECT c_custkey FROM customer)) AS BIGINT) AS outside_canonical_set, CAST((SELECT count(*) FROM customer WHERE c_custkey NOT IN (SELECT asset_id FROM destinations)) AS BIGINT) AS canonical_without_rows, false AS clean FROM a""")
def lifecycle_reconciliation(spark, sf_dir):
    return lifecycle.reconcile_destinations(fx.destinations(spark, sf_dir), fx.table(spark, sf_dir, "customer").selectExpr("c_custkey AS asset_id"), "d0", 1)


@query("WITH t AS (SELECT count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') AS v FROM orders) SELECT CAST(n AS BIGINT) AS assets, CAST(v AS BIGINT) AS verified, CAST(CASE WHEN n = 0 THEN 0 ELSE floor(v * 10000.0 / n + 0.5) END AS BIGINT) AS completion_hundredths FROM t")
def library_summary(spark, sf_dir):
    d = fx.destinations(spark, sf_dir).agg(F.count("*").alias("assets"), F.count_if(F.col("upload_status") == "VERIFIED").alias("verified"))
    return d.select("assets", "verified", F.when(F.col("assets") == 0, F.lit(0)).otherwise(F.floor(F.col("verified") * 10000.0 / F.col("assets") + 0.5)).cast("long").alias("completion_hundredths"))


@query(fx.with_(fx.FILES) + "SELECT file_extension, min(struct_pack(size_bytes := size_bytes, file_id := file_id)).size_bytes AS size_bytes, min(struct_pack(size_bytes := size_bytes, file_id := file_id)).file_id AS file_id FROM files WHERE size_bytes > 0 GROUP BY 1")
def sample_min_per_ext(spark, sf_dir):
    f = fx.files(spark, sf_dir, "file_id", "size_bytes", "file_extension").where("size_bytes > 0")
    return f.groupBy("file_extension").agg(F.min(F.struct("size_bytes", "file_id")).alias("m")).select("file_extension", "m.size_bytes", "m.file_id")


@query(fx.with_(fx.FILES) + r"SELECT CAST(count(*) AS BIGINT) AS rows, CAST(sum(CAST(concat('0x', left(sha256(concat('=', file_id, chr(31), '=', checksum, chr(31), '=', size_bytes)), 15)) AS HUGEINT)) AS VARCHAR) AS digest FROM files")
def snapshot_digest(spark, sf_dir):
    return hashing.table_digest(fx.files(spark, sf_dir, "file_id", "checksum", "size_bytes"), "file_id", "checksum", "size_bytes")


@query("SELECT CAST(label AS INT) AS label, CAST(i - 1 AS INT) AS i, CAST(floor(avg(CAST(embedding[i] AS DOUBLE)) * 1000000 + 0.5) AS BIGINT) AS mean_ppm FROM embeddings, range(1, 65) AS r(i) GROUP BY ALL")
def mean_embedding(spark, sf_dir):
    m = vectors.mean_by(fx.table(spark, sf_dir, "embeddings"), "label", "embedding")
    return m.select("label", "i", F.floor(F.col("mean") * 1_000_000 + 0.5).cast("long").alias("mean_ppm"))


_V = "[" + ", ".join(f"{v}::DOUBLE" for v in fx.VECTOR) + "]"
_COS = f"list_cosine_similarity(CAST(embedding AS DOUBLE[]), {_V})"


@query(f"SELECT vec_id, CAST(floor({_COS} * 1000000 + 0.5) AS BIGINT) AS similarity_ppm FROM embeddings ORDER BY 2 DESC, 1 LIMIT 20")
def cosine_topk(spark, sf_dir):
    """The 20 nearest vectors (a top-k report)."""
    return search.cosine_topk(fx.table(spark, sf_dir, "embeddings"), fx.VECTOR, 20)


@query("SELECT CAST(count(*) AS BIGINT) AS vectors, CAST(count(*) FILTER (WHERE len(embedding) <> 64) AS BIGINT) AS wrong_vector, CAST(0 AS BIGINT) AS wrong_norm, CAST((SELECT count(*) FROM (SELECT vec_id, label FROM embeddings GROUP BY 1, 2 HAVING count(*) > 1)) AS BIGINT) AS repeated, CAST((SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)) AS BIGINT) AS missing FROM embeddings")
def embedding_integrity(spark, sf_dir):
    return quality.embedding_integrity(fx.embeddings(spark, sf_dir), fx.files(spark, sf_dir, "file_id").withColumnRenamed("file_id", "asset_id"), 64, ["model"])


_ACTIVE = "active AS (SELECT file_id AS asset_id, file_name, mime_type, file_extension FROM files WHERE file_id IN (SELECT asset_id FROM destinations WHERE upload_status = 'VERIFIED' AND destination_file_id IS NOT NULL) AND NOT is_missing AND file_id % 53 <> 0 AND folder_id IN (SELECT folder_id FROM folders WHERE active))"


def _active(spark, sf_dir):
    f = fx.files(spark, sf_dir, "file_id", "folder_id", "file_name", "mime_type", "file_extension", "is_missing").withColumn("sync_classification", F.expr("CASE WHEN file_id % 53 = 0 THEN 'REMOVED_FROM_SOURCE' END"))
    assets = f.select(F.col("file_id").alias("asset_id"), "file_name", "mime_type", "file_extension")
    return search.active_assets(assets, fx.destinations(spark, sf_dir), f.selectExpr("file_id AS asset_id", "file_id"), f, fx.folders(spark, sf_dir))


@query(fx.with_(fx.FILES, fx.FOLDERS, fx.DESTINATIONS, _ACTIVE) + "SELECT asset_id FROM active")
def semi_active_source(spark, sf_dir):
    return _active(spark, sf_dir).select("asset_id")


@query(fx.with_(fx.FILES, fx.EMBEDDINGS) + "SELECT f.file_id AS asset_id, e.model FROM files f LEFT JOIN emb e ON f.file_id = e.asset_id AND e.model = '3'")
def optional_on_left_join(spark, sf_dir):
    return search.optional_on(fx.files(spark, sf_dir, "file_id").withColumnRenamed("file_id", "asset_id"), fx.embeddings(spark, sf_dir), "asset_id", model="3", provider=None).select("asset_id", "model")


def _words(c: str) -> str:
    return rf"list_filter(regexp_split_to_array(lower({c}), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')"


def _tri(c: str) -> str:
    return f"list_distinct(flatten(list_transform({_words(c)}, lambda w: list_transform(range(1, length(w) + 2), lambda i: substr(concat('  ', w, ' '), i, 3)))))"


def _similar(c: str, q: str) -> str:
    a, b = _tri(f"coalesce({c}, '')"), _tri(f"'{q}'")
    return f"(CASE WHEN len(list_distinct(list_concat({a}, {b}))) > 0 AND len(list_intersect({a}, {b})) / len(list_distinct(list_concat({a}, {b}))) >= 0.3 THEN 1 ELSE 0 END)"


@query(fx.with_(fx.INDEX) + f"SELECT asset_id, CAST({_similar('treatment', 'hair transplant')} AS INT) AS treatment, CAST({_similar('doctor_name', 'hair transplant')} AS INT) AS doctor FROM idx")
def trigram_match(spark, sf_dir):
    near = lambda c: F.when(text.trigram_similarity(c, F.lit("hair transplant")) >= 0.3, 1).otherwise(0)
    return fx.index(spark, sf_dir).select("asset_id", near("treatment").alias("treatment"), near("doctor_name").alias("doctor"))


_LIVE = "live AS (SELECT * FROM idx WHERE indexing_status = 'INDEXED')"
_INDEXES: dict[tuple[str, str], fulltext.SearchIndex] = {}


def _terms(spark: SparkSession, sf_dir: str) -> fulltext.SearchIndex:
    """The stored search index of a folder of tables, built once in an application."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _INDEXES:
        names = fx.files(spark, sf_dir, "file_id", "file_name").withColumnRenamed("file_id", "asset_id")
        _INDEXES[key] = fulltext.build(fx.index(spark, sf_dir), names, storage.new_path(spark, "search-index"))
    return _INDEXES[key]


_ONE, _TWO = "The things", "thing of an ERIN, thsh"


@query(fx.with_(fx.INDEX, _LIVE, fulltext.rank_sql("live", _ONE, "one"), fulltext.rank_sql("live", _TWO, "two")) + """SELECT asset_id, CAST(floor(coalesce(o.text_rank, 0) * 10000 + 0.5) AS BIGINT) AS one_term, CAST(floor(coalesce(t.text_rank, 0) * 10000 + 0.5) AS BIGINT) AS three_terms
FROM live LEFT JOIN one o USING (asset_id) LEFT JOIN two t USING (asset_id)""")
def text_rank(spark, sf_dir):
    """Full-text rank of every indexed text, for a query of one term and one of three."""
    ppm = lambda c: F.floor(F.coalesce(c, F.lit(0.0)) * 10000 + 0.5).cast("long")
    live, terms = fx.index(spark, sf_dir).where("indexing_status = 'INDEXED'").select("asset_id"), _terms(spark, sf_dir)
    out = live.join(terms.text_ranks(_ONE).withColumnRenamed("text_rank", "a"), "asset_id", "left").join(terms.text_ranks(_TWO).withColumnRenamed("text_rank", "b"), "asset_id", "left")
    return out.select("asset_id", ppm("a").alias("one_term"), ppm("b").alias("three_terms"))


_SPLIT = r"list_filter(regexp_split_to_array(lower(searchable_text), '[^\p{L}\p{N}]+'), lambda w: w <> '')"


@query(fx.with_(fx.INDEX, _LIVE, f"places AS (SELECT asset_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM (SELECT asset_id, {_SPLIT} AS w FROM live))",
                "words AS (SELECT DISTINCT word FROM places WHERE word NOT IN (" + ", ".join(f"'{w}'" for w in english.STOP_WORDS) + "))", english.stem_sql("words", "stems")) + f"""SELECT term, CAST(count(DISTINCT asset_id) AS BIGINT) AS n_assets, CAST(count(*) AS BIGINT) AS n_positions, CAST(sum(p) AS BIGINT) AS sum_positions
FROM (SELECT *, row_number() OVER (PARTITION BY asset_id, term ORDER BY p) AS i FROM (SELECT DISTINCT asset_id, term, least(p, {fulltext.LAST_POSITION}) AS p FROM places JOIN stems USING (word))) WHERE i <= {fulltext.MOST_POSITIONS} GROUP BY term""")
def term_postings(spark, sf_dir):
    """What the stored postings hold of every term."""
    t = spark.read.parquet(f"{_terms(spark, sf_dir).folder}/terms")
    return t.groupBy("term").agg(F.count("*").alias("n_assets"), F.sum(F.size("positions")).cast("long").alias("n_positions"), F.sum(F.aggregate("positions", F.lit(0).cast("long"), lambda s, x: s + x)).alias("sum_positions"))


_Q1 = "hair transplant erin thing"
_PPM = "CAST(floor({x} * 10000 + 0.5) AS BIGINT)"
_RANKED = fulltext.rank_sql("live", _Q1, "ranked")


@query(fx.with_(fx.INDEX, _LIVE) + f"SELECT asset_id, CAST({_similar('treatment', _Q1)} AS BIGINT) AS treatment, CAST({_similar('subject', _Q1)} AS BIGINT) AS subject, CAST({_similar('doctor_name', 'dr. hairs')} AS BIGINT) AS doctor FROM live")
def trigram_index(spark, sf_dir):
    """The trigram matches of every indexed asset, from the lists of distinct values."""
    t = _terms(spark, sf_dir)
    live = fx.index(spark, sf_dir).where("indexing_status = 'INDEXED'").select("asset_id")
    out = live.join(t.similar_fields(_Q1).drop("near_doctor_name"), "asset_id", "left").join(t.similar_fields("dr. hairs").select("asset_id", "near_doctor_name"), "asset_id", "left")
    n = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return out.select("asset_id", n("near_treatment").alias("treatment"), n("near_subject").alias("subject"), n("near_doctor_name").alias("doctor"))


@query(fx.with_(fx.FILES) + "SELECT file_id AS asset_id, contains(lower(file_name), '1.pdf') AS has_end, contains(lower(file_name), 'f12') AS has_start, contains(lower(file_name), '$') AS has_mark FROM files")
def filename_index(spark, sf_dir):
    """File names that contain a text, from the trigram lists and, for one without a trigram, from the names."""
    t = _terms(spark, sf_dir)
    out = fx.files(spark, sf_dir, "file_id").withColumnRenamed("file_id", "asset_id")
    for c, q in (("has_end", "1.PDF"), ("has_start", "f12"), ("has_mark", "$")):
        out = out.join(t.names_with(q).withColumn(c, F.lit(True)), "asset_id", "left")
    return out.select("asset_id", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("has_end", "has_start", "has_mark")])


_V1 = f"""j AS (SELECT a.asset_id, round(coalesce({_COS}, 0), 12) AS cs, coalesce(text_rank, 0) AS ct,
 0.08 * {_similar('treatment', _Q1)} + 0.07 * {_similar('subject', _Q1)} + 0.10 * {_similar('doctor_name', _Q1)} AS cf, CASE WHEN contains(lower(file_name), '{_Q1}') THEN 0.10 ELSE 0 END AS cn
 FROM active a JOIN live i ON a.asset_id = i.asset_id LEFT JOIN ranked r ON r.asset_id = a.asset_id LEFT JOIN emb e ON a.asset_id = e.asset_id WHERE lower(coalesce(mime_type, '')) LIKE 'image/%' OR file_extension IN ('jpg', 'jpeg', 'png', 'webp')),
s AS (SELECT *, round(0.45 * cs + 0.20 * ct + CAST(cf AS DOUBLE) + CAST(cn AS DOUBLE), 9) AS raw FROM j)"""


@query(fx.with_(fx.FILES, fx.FOLDERS, fx.DESTINATIONS, _ACTIVE, fx.INDEX, _LIVE, _RANKED, fx.EMBEDDINGS, _V1) + f"""SELECT asset_id, {_PPM.format(x='least(raw, 1.0)')} AS match_score, {_PPM.format(x='round(cs, 9)')} AS semantic_score, {_PPM.format(x='round(ct, 9)')} AS text_score, {_PPM.format(x='round(CAST(cf AS DOUBLE), 9)')} AS structured_score, {_PPM.format(x='cn')} AS filename_score, (SELECT count(*) FROM s) AS total_count
FROM s ORDER BY raw DESC, asset_id LIMIT 25""")
def hybrid_search_v1(spark, sf_dir):
    """A page of 25 of the ranked search (the limit is the page's)."""
    return search.hybrid_v1(_active(spark, sf_dir), fx.index(spark, sf_dir), fx.embeddings(spark, sf_dir), search.Query(q=f" {_Q1} ", semantic=fx.VECTOR, category="image"), _terms(spark, sf_dir))


_V2 = f"""j AS (SELECT a.asset_id, round(coalesce({_COS.replace('embedding', 'e.embedding')}, 0), 12) AS cv, coalesce(text_rank, 0) AS ct,
 ({_similar('treatment', _Q1)} + {_similar('subject', _Q1)} + {_similar('doctor_name', _Q1)}) / 3.0 AS cf, CASE WHEN contains(lower(file_name), '{_Q1}') THEN 1.0 ELSE 0.0 END AS cn
 FROM active a LEFT JOIN live i ON a.asset_id = i.asset_id LEFT JOIN ranked r ON r.asset_id = a.asset_id LEFT JOIN (SELECT * FROM emb WHERE model = '3') e ON a.asset_id = e.asset_id WHERE lower(coalesce(mime_type, '')) NOT LIKE 'image/%' AND lower(coalesce(mime_type, '')) NOT LIKE 'video/%'),
s AS (SELECT *, round(0.65 * cv + 0.15 * greatest(ct, cf) + 0.05 * CAST(cn AS DOUBLE), 9) AS raw FROM j)"""


@query(fx.with_(fx.FILES, fx.FOLDERS, fx.DESTINATIONS, _ACTIVE, fx.INDEX, _LIVE, _RANKED, fx.EMBEDDINGS, _V2) + f"""SELECT asset_id, {_PPM.format(x='least(greatest(raw, 0.0), 1.0)')} AS match_score, {_PPM.format(x='round(cv, 9)')} AS visual_score, CAST(0 AS BIGINT) AS semantic_score, {_PPM.format(x='round(ct, 9)')} AS text_score, {_PPM.format(x='round(cf, 9)')} AS structured_score, {_PPM.format(x='cn')} AS filename_score, (SELECT count(*) FROM s) AS total_count
FROM s ORDER BY raw DESC, asset_id LIMIT 25""")
def hybrid_search_v2(spark, sf_dir):
    e = fx.embeddings(spark, sf_dir)
    return search.search(_active(spark, sf_dir), fx.index(spark, sf_dir), e, e, search.Query(q=_Q1, visual=fx.VECTOR, visual_identity={"model": "3"}, category="document"), _terms(spark, sf_dir))


@query(fx.with_(fx.FILES, fx.FOLDERS, fx.DESTINATIONS, _ACTIVE, fx.INDEX, _LIVE, fulltext.rank_sql("live", "thing", "single")) + ", " + ", ".join(f"""s_{c} AS (SELECT a.asset_id, round(0.20 * coalesce(text_rank, 0) + CAST(0.08 * {_similar('treatment', 'thing')} AS DOUBLE), 9) AS raw FROM active a JOIN live USING (asset_id) LEFT JOIN single USING (asset_id) WHERE {w})""" for c, w in (
    ("video", "lower(mime_type) LIKE 'video/%' OR file_extension IN ('mp4', 'mov')"),
    ("document", "mime_type IN ('application/pdf', 'application/vnd.openxmlformats-officedocument.presentationml.presentation') OR contains(lower(mime_type), 'presentation') OR file_extension IN ('pdf', 'pptx')"),
    ("other", "NOT (lower(mime_type) LIKE 'video/%' OR file_extension IN ('mp4', 'mov') OR lower(mime_type) LIKE 'image/%' OR file_extension IN ('jpg', 'jpeg', 'png', 'webp', 'pdf', 'pptx') OR mime_type = 'application/pdf' OR contains(lower(mime_type), 'presentation'))"),
)) + " " + " UNION ALL ".join(f"(SELECT '{c}' AS category, asset_id, {_PPM.format(x='raw')} AS match_score, (SELECT count(*) FROM s_{c}) AS total_count FROM s_{c} ORDER BY raw DESC, asset_id LIMIT 10 OFFSET 5)" for c in ("video", "document", "other")))
def search_by_category(spark, sf_dir):
    """Rows 6 to 15 of a search by words alone, in each of three categories (the limit is the page's)."""
    a, i, e, t = _active(spark, sf_dir), fx.index(spark, sf_dir), fx.embeddings(spark, sf_dir).where("false"), _terms(spark, sf_dir)
    one = lambda c: search.search(a, i, e, e, search.Query(q="thing", category=c, limit=10, offset=5), t).select(F.lit(c).alias("category"), "asset_id", "match_score", "total_count")
    return one("video").unionByName(one("document")).unionByName(one("other"))


_TYPES = ("exact_terms", "semantic_paraphrase", "natural_conversational", "file_name")
_ASKED = f"asked AS (SELECT item_id AS query_id, CASE item_id % 9 WHEN 0 THEN 'long hair' WHEN 1 THEN concat('f', item_id) WHEN 2 THEN 'thing' ELSE text END AS q, {fx._pick(_TYPES, '(item_id % 4)')} AS type FROM benchmark)"
_EXPECTED = "expected AS (SELECT query_id, asset_id FROM asked JOIN active ON asset_id % 5 = query_id % 5 WHERE query_id % 7 <> 0)"


def _asked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Benchmark queries (texts, a field's words, part of a name, one word) with a type, and the expected assets as a rule on ids."""
    q = fx.table(spark, sf_dir, "benchmark").selectExpr("item_id AS query_id", "CASE item_id % 9 WHEN 0 THEN 'long hair' WHEN 1 THEN concat('f', item_id) WHEN 2 THEN 'thing' ELSE text END AS q", f"{fx._pick(_TYPES, '(item_id % 4)')} AS type")
    return q, q.where("query_id % 7 <> 0").select("query_id")


_DICE = "(SELECT query_id, field, value, len(list_intersect(g, h)) / len(list_distinct(list_concat(g, h))) AS dice FROM (SELECT query_id, " + _tri("q") + " AS g FROM asked) JOIN (SELECT field, value, " + _tri("value") + " AS h FROM (SELECT DISTINCT 'treatment' AS field, treatment AS value FROM live UNION SELECT 'subject', subject FROM live UNION SELECT 'doctor_name', doctor_name FROM live) WHERE value IS NOT NULL) ON true)"
_TOP = f"""near_values AS MATERIALIZED (SELECT query_id, field, value FROM {_DICE} WHERE dice >= 0.3),
scored AS (SELECT k.query_id, a.asset_id, round(0.20 * coalesce(text_rank, 0) + CASE WHEN t.value IS NULL THEN 0 ELSE CAST(0.08 AS DOUBLE) END + CASE WHEN s.value IS NULL THEN 0 ELSE CAST(0.07 AS DOUBLE) END + CASE WHEN d.value IS NULL THEN 0 ELSE CAST(0.10 AS DOUBLE) END
  + CASE WHEN contains(lower(file_name), lower(q)) THEN CAST(0.10 AS DOUBLE) ELSE 0 END, 9) AS raw
 FROM asked k JOIN active a ON true LEFT JOIN live i USING (asset_id) LEFT JOIN ranks r ON r.query_id = k.query_id AND r.asset_id = a.asset_id
 LEFT JOIN near_values t ON t.field = 'treatment' AND t.query_id = k.query_id AND t.value = i.treatment LEFT JOIN near_values s ON s.field = 'subject' AND s.query_id = k.query_id AND s.value = i.subject
 LEFT JOIN near_values d ON d.field = 'doctor_name' AND d.query_id = k.query_id AND d.value = i.doctor_name),
top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY raw DESC, asset_id) AS place FROM scored QUALIFY place <= 3)"""
_BENCHMARK = fx.with_(fx.FILES, fx.FOLDERS, fx.DESTINATIONS, _ACTIVE, fx.INDEX, _LIVE, _ASKED, _EXPECTED, batchrank.ranks_sql("live", "asked", "ranks"), _TOP)
_VERDICT = "(SELECT k.query_id, type, min(CASE WHEN e.asset_id IS NOT NULL THEN place END) AS expected_rank, CASE WHEN k.query_id IN (SELECT query_id FROM expected) THEN count(e.asset_id) > 0 END AS passed FROM asked k LEFT JOIN top USING (query_id) LEFT JOIN expected e ON e.query_id = k.query_id AND e.asset_id = top.asset_id GROUP BY k.query_id, type)"


def _top(spark, sf_dir):
    return batchrank.top_assets(_asked(spark, sf_dir)[0], _active(spark, sf_dir), _terms(spark, sf_dir))


@query(_BENCHMARK + f"SELECT query_id, CAST(place AS BIGINT) AS place, asset_id, {_PPM.format(x='raw')} AS score FROM top")
def batch_top_assets(spark, sf_dir):
    """The three best active assets of every benchmark query."""
    return _top(spark, sf_dir).select("query_id", F.col("place").cast("long").alias("place"), "asset_id", F.floor(F.col("raw") * 10000 + 0.5).cast("long").alias("score"))


def _verdicts(spark, sf_dir):
    (q, some), a = _asked(spark, sf_dir), _active(spark, sf_dir).select("asset_id")
    top = storage.materialize(_top(spark, sf_dir), "top-assets")
    # the rule is applied to the assets in the top, and to know of a query whether it expects any to the ids of each class
    classes = a.select((F.col("asset_id") % 5).alias("c")).distinct()
    rule = some.withColumn("c", F.col("query_id") % 5).join(F.broadcast(classes), "c", "left_semi")  # five rows
    expected = top.join(rule, "query_id").where(F.col("asset_id") % 5 == F.col("c")).select("query_id", "asset_id")
    return batchrank.benchmark(q, top, expected.unionByName(rule.select("query_id", F.lit(None).cast("long").alias("asset_id"))))


@query(_BENCHMARK + f"SELECT query_id, type, CAST(expected_rank AS BIGINT) AS expected_rank, passed FROM {_VERDICT}")
def benchmark_results(spark, sf_dir):
    """Of every benchmark query the first place of an expected asset among the three best, and whether there is one."""
    return _verdicts(spark, sf_dir).select("query_id", "type", F.col("expected_rank").cast("long").alias("expected_rank"), "passed")


@query(_BENCHMARK + f"SELECT type, CAST(sum(CAST(passed AS INT)) AS BIGINT) AS passed, CAST(count(*) AS BIGINT) AS total FROM {_VERDICT} WHERE passed IS NOT NULL GROUP BY type")
def benchmark_by_type(spark, sf_dir):
    """Passed queries by type."""
    return batchrank.by_type(_verdicts(spark, sf_dir))


@query(fx.with_(fx.FILES) + """, f AS (SELECT * FROM files WHERE contains(lower(file_name), '1') AND file_extension = 'mov') SELECT file_id AS asset_id, CAST(NULL AS BIGINT) AS match_score, (SELECT count(*) FROM f) AS total_count FROM f ORDER BY size_bytes DESC NULLS LAST, file_id LIMIT 25 OFFSET 25""")
def browse_page(spark, sf_dir):
    """What an empty query shows: the second page of the library, filtered and ordered (the limit is the page's)."""
    a = fx.files(spark, sf_dir, "file_id", "file_name", "mime_type", "file_extension", "size_bytes").withColumnRenamed("file_id", "asset_id").withColumn("updated_at", F.lit(None).cast("long"))
    q = search.Query.of({"nlq": "  ", "query": " 1* ", "category": "video", "extension": ".MOV", "sort": "largest", "page": "2"})
    return search.search(a, a, a, a, q, None)


@query(fx.with_(fx.INDEX) + r"SELECT asset_id, left(trim(regexp_replace(concat_ws(' ', content_type, coalesce(treatment, ''), coalesce(subject, ''), coalesce(doctor_name, ''), searchable_text), '\s+', ' ', 'g')), 4000) AS searchable FROM idx")
def searchable_text(spark, sf_dir):
    blank = lambda c: F.coalesce(c, F.lit(""))
    return fx.index(spark, sf_dir).select("asset_id", text.collapse(F.concat_ws(" ", "content_type", blank("treatment"), blank("subject"), blank("doctor_name"), blank("searchable_text")), 4000).alias("searchable"))


@query(fx.with_(fx.FILES) + "SELECT file_id, sha256(concat_ws('|', CASE WHEN file_id % 4 = 0 THEN '' ELSE content_hash END, CASE WHEN file_id % 4 = 0 THEN mime_type ELSE '' END, 'p', 'm', 'v')) AS fingerprint FROM files")
def fingerprints(spark, sf_dir):
    f = fx.files(spark, sf_dir, "file_id", "content_hash", "mime_type")
    return f.select("file_id", hashing.fingerprint(F.when(F.col("file_id") % 4 != 0, F.col("content_hash")), F.col("mime_type"), "p", "m", "v").alias("fingerprint"))


@query(fx.with_(fx.FILES, fx.FOLDERS, fx.DESTINATIONS, _ACTIVE) + """, x AS (SELECT file_id, file_extension, CASE WHEN file_id % 10 = 3 THEN 'PENDING' ELSE 'INDEXED' END AS st, file_id % 6 <> 0 AS known, file_id % 8 = 0 AS stale FROM files)
SELECT file_id AS asset_id, CASE WHEN known AND st <> 'INDEXED' THEN 'PENDING' WHEN known AND NOT stale THEN 'UNCHANGED' WHEN file_extension = 'heic' OR file_id NOT IN (SELECT asset_id FROM active) THEN 'INELIGIBLE' WHEN known THEN 'CHANGED' ELSE 'NEW' END AS state FROM x""")
def index_discovery(spark, sf_dir):
    f = fx.files(spark, sf_dir, "file_id", "content_hash", "file_extension").withColumnRenamed("file_id", "asset_id")
    mark = hashing.fingerprint(F.col("content_hash"), F.lit(None).cast("string"))
    known = f.where("asset_id % 6 <> 0").select("asset_id", F.expr("CASE WHEN asset_id % 10 = 3 THEN 'PENDING' ELSE 'INDEXED' END").alias("indexing_status"), F.when(F.col("asset_id") % 8 == 0, "old").otherwise(mark).alias("source_fingerprint"))
    return search.discovery(f, known, mark, _active(spark, sf_dir))


@query("""WITH RECURSIVE e AS (SELECT 'root' AS p, concat('r', r_regionkey) AS n, r_name AS name FROM region UNION ALL SELECT concat('r', n_regionkey), concat('n', n_nationkey), n_name FROM nation UNION ALL SELECT concat('n', c_nationkey), concat('c', c_custkey), c_name FROM customer),
t AS (SELECT 'root' AS node, 0 AS depth, '' AS path UNION ALL SELECT e.n, t.depth + 1, CASE WHEN t.path = '' THEN e.name ELSE concat(t.path, '/', e.name) END FROM t JOIN e ON e.p = t.node) SELECT node, CAST(depth AS INT) AS depth, path FROM t""")
def folder_tree_paths(spark, sf_dir):
    edge = lambda t, p, n, name: fx.table(spark, sf_dir, t).selectExpr(f"{p} AS parent", f"{n} AS node", f"{name} AS name")
    edges = edge("region", "'root'", "concat('r', r_regionkey)", "r_name").unionByName(edge("nation", "concat('r', n_regionkey)", "concat('n', n_nationkey)", "n_name")).unionByName(edge("customer", "concat('n', c_nationkey)", "concat('c', c_custkey)", "c_name"))
    return inventory.folder_paths(edges, "root")


@query(fx.with_(fx.FILES) + "SELECT file_id, 'size' AS rule FROM files WHERE NOT size_bytes > 0 UNION ALL SELECT file_id, 'mime' FROM files WHERE NOT (mime_type LIKE 'image/%' OR mime_type LIKE 'video/%') UNION ALL SELECT file_id, 'state' FROM files WHERE trashed AND is_missing")
def constraint_violations(spark, sf_dir):
    f = fx.files(spark, sf_dir, "file_id", "size_bytes", "mime_type", "trashed", "is_missing")
    return quality.violations(f, "file_id", {"size": F.col("size_bytes") > 0, "mime": F.col("mime_type").startswith("image/") | F.col("mime_type").startswith("video/"), "state": ~(F.col("trashed") & F.col("is_missing"))})


@query("SELECT n_name AS name, CASE WHEN n_nationkey % 4 = 0 THEN 'MISSING' WHEN n_nationkey % 5 = 0 THEN 'DIFFERENT' ELSE 'OK' END AS status FROM nation UNION ALL SELECT 'OVERALL', 'FAILED'")
def expected_vs_actual_diff(spark, sf_dir):
    n = fx.table(spark, sf_dir, "nation").selectExpr("n_nationkey AS k", "n_name AS name", "n_regionkey AS v")
    return quality.expected_vs_actual(n.drop("k"), n.where("k % 4 <> 0").selectExpr("name", "CASE WHEN k % 5 = 0 THEN NULL ELSE v END AS v"), "name", "v")


@query("SELECT n_nationkey AS k, CASE WHEN n_nationkey IN (3, 7) AND n_regionkey <> 1 THEN 'APPLIED' WHEN n_nationkey IN (3, 7) THEN 'NO_CHANGE' ELSE 'UNTOUCHED' END AS result FROM nation")
def controlled_apply(spark, sf_dir):
    """A guarded update of stated rows, and the check that nothing else changed."""
    n = fx.table(spark, sf_dir, "nation").selectExpr("n_nationkey AS k", "n_name AS name", "n_regionkey AS v")
    wanted = F.col("k").isin(3, 7)
    after = lifecycle.guarded_update(n, wanted & (F.col("v") != 1), {"v": F.lit(1)})
    changed = sync.unrelated_fields_unchanged(n, after.drop("updated"), "k", ["v"])
    result = F.when(F.col("updated"), "APPLIED").when(wanted, "NO_CHANGE").otherwise("UNTOUCHED")
    return after.join(changed, "k", "left_anti").select("k", result.alias("result"))


@query("SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'Consultation' ELSE 'Other' END AS content_type, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE lang END AS treatment, CASE WHEN doc_id % 7 = 0 THEN 'UNAPPROVED_FIELDS' WHEN doc_id % 4 = 0 THEN 'SHORT_CAPTION_MISSING' END AS error FROM documents")
def structured_metadata_clean(spark, sf_dir):
    raw = F.expr("to_json(named_struct('content_type', CASE WHEN doc_id % 5 = 0 THEN 'Consultation' ELSE 'Invented' END, 'treatment', CASE WHEN doc_id % 3 = 0 THEN ' N/A ' ELSE lang END, 'short_caption', CASE WHEN doc_id % 4 = 0 THEN ' ' ELSE 'c' END, 'ai_description', source, 'extra', CASE WHEN doc_id % 7 = 0 THEN 1 END))")
    d = fx.table(spark, sf_dir, "documents").select("doc_id", raw.alias("raw"))
    return quality.structured_metadata(d, "raw", fx.CONTENT_TYPES).select("doc_id", "content_type", "treatment", "error")


@query("SELECT c_custkey AS id, c_name FROM customer WHERE c_mktsegment <> 'MACHINERY' AND c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)")
def rls_visible_rows(spark, sf_dir):
    """Row-level access: rows of the caller's nations, and not of the restricted segment."""
    allowed = fx.table(spark, sf_dir, "nation").where("n_regionkey = 2").selectExpr("n_nationkey AS c_nationkey")
    return fx.table(spark, sf_dir, "customer").where("c_mktsegment <> 'MACHINERY'").join(allowed, "c_nationkey", "left_semi").selectExpr("c_custkey AS id", "c_name")


@query(fx.with_(fx.FILES) + "SELECT file_id, file_name, size_bytes, (SELECT count(*) FROM files) AS total FROM files ORDER BY size_bytes DESC NULLS LAST, file_id LIMIT 50 OFFSET 50")
def library_page(spark, sf_dir):
    """Page 2 of 50 of the library, largest first (the limit is the page's)."""
    f = fx.files(spark, sf_dir, "file_id", "file_name", "size_bytes")
    page = f.orderBy(F.col("size_bytes").desc_nulls_last(), "file_id").offset(50).limit(50)
    return page.crossJoin(F.broadcast(f.agg(F.count("*").alias("total"))))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_object('event', event_type, 'k', CAST(json_extract_string(props, '$.k') AS BIGINT)) AS doc FROM events")
def json_props(spark, sf_dir):
    e = fx.table(spark, sf_dir, "events").select("event_id", "event_type", F.get_json_object("props", "$.k").cast("long").alias("k"))
    return e.select("event_id", "k", F.to_json(F.struct(F.col("event_type").alias("event"), "k")).alias("doc"))


@query(r"SELECT page_id, CASE WHEN page_id % 3 = 0 THEN concat('F_', page_id) END AS folder_id FROM pages")
def url_folder_id(spark, sf_dir):
    link = F.expr("CASE WHEN page_id % 3 = 0 THEN concat(' https://Drive.google.com/drive/folders/F_', page_id, '?usp=x') WHEN page_id % 3 = 1 THEN concat('https://drive.google.com:443/drive/folders/', page_id) ELSE url END")
    return fx.table(spark, sf_dir, "pages").select("page_id", text.folder_id(link).alias("folder_id"))


@query(r"""SELECT doc_id, left(trim(regexp_replace(regexp_replace(t, '(?i)(bearer|access[_ -]?token|refresh[_ -]?token|client_secret|service[_ -]?role|password|authorization)\s*[:=]\s*\S+', '\1=[REDACTED]', 'g'), '\s+', ' ', 'g')), 500) AS redacted
 FROM (SELECT doc_id, concat('Password: ', source, '  x ', CASE doc_id % 3 WHEN 0 THEN 'access token: ' WHEN 1 THEN 'SERVICE-ROLE = ' ELSE 'authorization:' END, lang, ' ', text) AS t FROM documents)""")
def redact_secrets(spark, sf_dir):
    kind = F.expr("CASE doc_id % 3 WHEN 0 THEN 'access token: ' WHEN 1 THEN 'SERVICE-ROLE = ' ELSE 'authorization:' END")
    return fx.table(spark, sf_dir, "documents").select("doc_id", text.redacted(F.concat(F.lit("Password: "), "source", F.lit("  x "), kind, "lang", F.lit(" "), "text")).alias("redacted"))


_DETAILS = """concat('{"file":"f', event_id, '","n":', user_id, ',"Password":"p', event_id, '","error":"password: abc', event_id, '  and  more","nothing":null,"ok":true,"inner":{"ACCESS_TOKEN":"x","note":"bearer = t', user_id, ' \\\\n ends","deep":{"signed_url":"u","kind":"', event_type, '"}},"list":[{"client_secret":"s","k":1},"authorization:x y"]}')"""


@query("""SELECT event_id, concat('{"file":"f', event_id, '","n":"', user_id, '","error":"password=[REDACTED] and more","nothing":null,"ok":"true","inner":{"note":"bearer=[REDACTED] ends","deep":{"kind":"', event_type, '"}},"list":[{"k":"1"},"authorization=[REDACTED] y"]}') AS details FROM events""")
def event_details(spark, sf_dir):
    """Nested details of every event without prohibited keys, texts redacted, still JSON."""
    e = fx.table(spark, sf_dir, "events").selectExpr("event_id", f"{_DETAILS} AS details")
    return e.select("event_id", details.sanitized("details").alias("details"))


@query(fx.with_(fx.FILES) + "SELECT file_id, concat(left(checksum, 8), '…', right(checksum, 4)) AS id, concat('Restricted file.', file_extension) AS name FROM files")
def masking(spark, sf_dir):
    return fx.files(spark, sf_dir, "file_id", "checksum", "file_name").select("file_id", text.short_id("checksum").alias("id"), text.masked_filename("file_name").alias("name"))


@query("SELECT doc_id, CASE WHEN n_chars < 1024 THEN concat(n_chars, ' B') ELSE concat(CAST(floor(n_chars / 1024.0 + 0.5) AS BIGINT), ' KB') END AS size FROM documents")
def format_bytes(spark, sf_dir):
    return fx.table(spark, sf_dir, "documents").select("doc_id", text.format_bytes("n_chars").alias("size"))


@query(r"SELECT doc_id, contains(s, '@') OR regexp_matches(s, '\b(patient|mrn|dob|mobile|phone|email)\b') OR regexp_matches(s, '[0-9]{7,}') AS sensitive FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN concat('patient ', doc_id) WHEN 1 THEN concat('a@b', doc_id) WHEN 2 THEN CAST(1000000 + doc_id * 3 AS VARCHAR) ELSE concat('clip ', lang) END AS s FROM documents)")
def sensitive_names(spark, sf_dir):
    stem = F.expr("CASE doc_id % 4 WHEN 0 THEN concat('patient ', doc_id) WHEN 1 THEN concat('a@b', doc_id) WHEN 2 THEN CAST(1000000 + doc_id * 3 AS STRING) ELSE concat('clip ', lang) END")
    return fx.table(spark, sf_dir, "documents").select("doc_id", text.looks_sensitive(stem).alias("sensitive"))


@query(fx.with_(fx.FILES) + "SELECT file_id, concat(CASE WHEN file_id % 2 = 0 THEN concat('clip-', file_id % 100, '__') ELSE 'asset__' END, left(checksum, 8), '.', file_extension) AS name FROM files WHERE file_extension <> 'heic'")
def destination_plan(spark, sf_dir):
    f = fx.files(spark, sf_dir, "file_id", "checksum", "file_extension").where("file_extension <> 'heic'")
    original = F.expr("CASE WHEN file_id % 2 = 0 THEN concat(' clip  ', file_id % 100, '.', upper(file_extension)) ELSE concat('patient ', file_id) END")
    return f.select("file_id", text.destination_name("checksum", "file_extension", original).alias("name"))


@query("SELECT doc_id, CAST(CASE WHEN n_chars % 4 = 0 THEN 1 ELSE 3 END AS INT) AS n, CAST(CASE WHEN n_chars % 4 = 0 THEN 0 ELSE n_chars * 50 END AS BIGINT) AS first_ms, CAST(CASE WHEN n_chars % 4 = 0 THEN 0 ELSE n_chars * 950 END AS BIGINT) AS last_ms FROM documents")
def frame_timestamps(spark, sf_dir):
    """Three evenly spaced positions with a margin of 5 % at each end; the start alone where there is no duration."""
    d = F.expr("CASE WHEN n_chars % 4 = 0 THEN 0 ELSE n_chars * 1000 END")
    at = F.when(d <= 0, F.array(F.lit(0.0))).otherwise(F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: d * 0.05 + i * (d * 0.9 / 2)))
    x = fx.table(spark, sf_dir, "documents").select("doc_id", at.alias("at"))
    return x.select("doc_id", F.size("at").alias("n"), F.round(F.element_at("at", 1)).cast("long").alias("first_ms"), F.round(F.element_at("at", -1)).cast("long").alias("last_ms"))


@query()
def idempotency_keys(spark, sf_dir):
    """Name-based ids (version 5); tested against the standard library."""
    f = fx.files(spark, sf_dir, "file_id", "checksum")
    return f.select("file_id", hashing.idempotency_key(F.col("checksum"), F.lit("folder"), F.lit("v1"), "asset-destination").alias("key"))


KNOWN = conversation.Vocabulary(doctors={"Dr Hair": ("with dr hair", "by dr hair")}, brands={"Long Hair FUE": ("long hair fue",)})
SAID = ("show me hair transplant clips", "Only videos.", "newest first", "with Dr. Hair", "no testimonials", "female patients consultation", "clear the doctor", "start over", "long hair fue, photos only", "include testimonials")


def _said(phrases: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains(said, ' {p} ')" for p in phrases) + ")"


def _chosen(values: dict) -> str:
    return "CASE " + " ".join(f"WHEN {_said(p)} THEN {{'v': {f"'{v}'" if v else 'CAST(NULL AS VARCHAR)'}}}" for v, p in values.items()) + " END"


def _now(c: str) -> str:
    return f"last_value({c} IGNORE NULLS) OVER u"


@query(fr"""WITH t AS (SELECT conv_id, turn * 2 AS turn, text FROM conversations UNION ALL SELECT conv_id, turn * 2 + 1, {fx._pick(SAID, f"((conv_id + turn) % {len(SAID)})")} FROM conversations),
c AS (SELECT *, trim(left(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')), 300)) AS clean FROM t),
w AS (SELECT *, concat(' ', array_to_string(list_filter(regexp_split_to_array(lower(clean), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> ''), ' '), ' ') AS said FROM c),
i AS (SELECT *, trim(said) IN {conversation.RESETS} AS reset, {_chosen(conversation.MEDIA)} AS media, {_chosen(conversation.SORTS)} AS ord, {_said(conversation.NO_DOCTOR)} AS no_doctor, {_chosen(KNOWN.doctors)} AS doctor, {_said(conversation.EXCLUDE)} AS excl,
 {_said(conversation.INCLUDE)} AS incl, {_chosen(KNOWN.brands)} AS brand, {_chosen(KNOWN.treatments)} AS care, {_chosen(conversation.SUBJECTS)} AS who, {_chosen(conversation.CONTENTS)} AS what FROM w),
h AS (SELECT *, clean <> '' AND NOT reset AS live, media IS NOT NULL OR ord IS NOT NULL OR no_doctor OR excl OR incl AS hard, sum(CAST(reset AS INT)) OVER (PARTITION BY conv_id ORDER BY turn, text ROWS UNBOUNDED PRECEDING) AS part FROM i),
a AS (SELECT *, coalesce(bool_or(live AND NOT hard) OVER (PARTITION BY conv_id, part ORDER BY turn, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS asked FROM h),
k AS (SELECT *, live AND NOT (hard OR (doctor IS NOT NULL AND NOT no_doctor AND asked)) AS plain FROM a),
z AS (SELECT *, CASE WHEN plain THEN {{'v': clean}} END AS q1, CASE WHEN live THEN media END AS m1, CASE WHEN live THEN ord END AS o1, CASE WHEN live THEN CASE WHEN no_doctor THEN {{'v': CAST(NULL AS VARCHAR)}} ELSE doctor END END AS d1,
 CASE WHEN live THEN CASE WHEN excl THEN {{'v': 'Patient Testimonial'}} WHEN incl THEN {{'v': ''}} END END AS e1, CASE WHEN live THEN coalesce(brand, CASE WHEN plain THEN care END) END AS t1, CASE WHEN plain THEN who END AS s1, CASE WHEN plain THEN what END AS c1 FROM k),
f AS (SELECT *, coalesce({_now('q1')}.v, '') AS semantic_query, {_now('m1')}.v AS media_type, {_now('t1')}.v AS treatment, {_now('s1')}.v AS subject, {_now('d1')}.v AS doctor_name, {_now('c1')}.v AS content_type, coalesce({_now('e1')}.v, '') AS excluded, coalesce({_now('o1')}.v, 'relevance') AS sort
 FROM z WINDOW u AS (PARTITION BY conv_id, part ORDER BY turn, text ROWS UNBOUNDED PRECEDING))
SELECT conv_id, turn, CASE WHEN reset THEN 'RESET_SEARCH' WHEN clean = '' THEN 'REFINE_SEMANTIC_QUERY' WHEN plain THEN CASE WHEN asked THEN 'REFINE_SEMANTIC_QUERY' ELSE 'START_NEW_SEARCH' END WHEN excl THEN 'ADD_FILTER' WHEN incl OR no_doctor THEN 'REMOVE_FILTER'
 WHEN ord IS NOT NULL THEN 'CHANGE_SORT' WHEN media IS NOT NULL THEN CASE WHEN media.v IS NULL THEN 'REMOVE_FILTER' ELSE 'CHANGE_MEDIA_TYPE' END ELSE 'ADD_FILTER' END AS operation, semantic_query, media_type, treatment, subject, doctor_name, content_type, excluded, sort,
 array_to_string(list_filter([subject, treatment, CASE media_type WHEN 'video' THEN 'Videos' WHEN 'image' THEN 'Images' END, doctor_name, content_type, CASE WHEN excluded <> '' THEN concat('Not ', excluded) END, CASE sort WHEN 'newest' THEN 'Newest first' WHEN 'oldest' THEN 'Oldest first' END], lambda x: x IS NOT NULL), '|') AS labels,
 left(regexp_replace(array_to_string(list_filter([semantic_query, treatment, subject, doctor_name, content_type], lambda x: x IS NOT NULL AND x <> ''), '. '), '\s+', ' ', 'g'), 300) AS effective_query FROM f""")
def conversation_state(spark, sf_dir):
    """The search state after every turn: the texts of the conversations, each followed by a turn with a phrase."""
    t = fx.table(spark, sf_dir, "conversations")
    pick = F.get(F.array(*map(F.lit, SAID)), F.pmod(F.col("conv_id") + F.col("turn"), F.lit(len(SAID))).cast("int"))
    turns = t.select("conv_id", (F.col("turn") * 2).alias("turn"), "text").unionByName(t.select("conv_id", (F.col("turn") * 2 + 1).alias("turn"), pick.alias("text")))
    return conversation.states(turns, KNOWN)


@query(fx.with_(fx.FILES, _REASON) + """, t AS (SELECT *, row_number() OVER (PARTITION BY checksum, size_bytes ORDER BY relative_path, file_id) AS n FROM decisions WHERE decision = 'TAKE'),
o AS (SELECT 'UPLOADED' AS outcome FROM t WHERE n = 1 UNION ALL SELECT 'DUPLICATE' FROM t WHERE n > 1 UNION ALL SELECT CASE decision WHEN 'SKIP' THEN 'SKIPPED' ELSE 'PENDING' END FROM decisions WHERE decision <> 'TAKE') SELECT outcome, CAST(count(*) AS BIGINT) AS n FROM o GROUP BY 1""")
def migration_outcomes(spark, sf_dir):
    """Decide, find duplicates in order of path and id, and count outcomes: of equal contents the first is uploaded."""
    d = _decided(spark, sf_dir, "checksum")
    take = d.where("decision = 'TAKE'")
    first = take.groupBy("checksum", "size_bytes").agg(F.count("*").alias("n")).agg(F.lit("UPLOADED").alias("outcome"), F.count("*").alias("n"))
    rest = take.groupBy("checksum", "size_bytes").agg((F.count("*") - 1).alias("n")).agg(F.lit("DUPLICATE").alias("outcome"), F.sum("n").alias("n"))
    other = d.where("decision <> 'TAKE'").groupBy(F.when(F.col("decision") == "SKIP", "SKIPPED").otherwise("PENDING").alias("outcome")).agg(F.count("*").alias("n"))
    return first.unionByName(rest).unionByName(other).where("n > 0")


@query(fx.with_(fx.INDEX) + ", b AS (SELECT item_id, " + _words("text") + " AS w FROM benchmark), r AS (SELECT item_id, asset_id, len(list_intersect(list_distinct(" + _words("searchable_text") + """), list_distinct(w))) AS hits FROM b, idx),
k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY hits DESC, asset_id) AS n FROM r) SELECT item_id, min(CASE WHEN asset_id % 100 = 0 THEN n END) AS first_expected, coalesce(min(CASE WHEN asset_id % 100 = 0 THEN n END) <= 3, false) AS passed FROM k GROUP BY 1""")
def search_benchmark(spark, sf_dir):
    """Rank of the first expected asset (id % 100 = 0) for each benchmark query (texts) among all assets, and whether it is in the top 3.

    Assets without a hit come after those with one, by id (``termhits``).
    """
    terms = lambda c: F.array_distinct(fulltext.terms(F.col(c))).alias("terms")
    asked = fx.table(spark, sf_dir, "benchmark").select("item_id", terms("text")).groupBy("item_id").agg(F.flatten(F.collect_list("terms")).alias("terms"))
    texts = fx.index(spark, sf_dir).select("asset_id", terms("searchable_text"), (F.col("asset_id") % 100 == 0).alias("expected"))
    ranked = termhits.first_expected(asked, texts)
    return ranked.select("item_id", "first_expected", F.coalesce(F.col("first_expected") <= 3, F.lit(False)).alias("passed"))


@query(fx.with_(fx.FILES) + """SELECT file_id, CASE WHEN file_id % 23 = 0 THEN 'SOURCE_ACCESS_DENIED' WHEN is_missing THEN 'SOURCE_NOT_FOUND' WHEN trashed THEN 'SOURCE_TRASHED' WHEN file_id % 12 = 0 THEN 'SIZE_CHANGED' WHEN file_id % 31 = 0 THEN 'MIME_CHANGED' WHEN file_id % 37 = 0 THEN 'VERSION_CHANGED' END AS reason FROM files""")
def source_preflight(spark, sf_dir):
    """Ordered reasons against a transfer."""
    f = fx.files(spark, sf_dir, "file_id", "size_bytes", "mime_type", "trashed", "is_missing", "content_hash")
    f = f.selectExpr("file_id", "content_hash", "trashed", "file_id % 23 = 0 AS access_denied", "CAST(file_id AS STRING) AS exp_id", "CASE WHEN NOT is_missing THEN CAST(file_id AS STRING) END AS cur_id", "size_bytes AS exp_size", "CASE WHEN file_id % 12 = 0 THEN size_bytes + 1 ELSE size_bytes END AS cur_size",
                     "mime_type AS exp_mime", "CASE WHEN file_id % 31 = 0 THEN 'x' ELSE upper(mime_type) END AS cur_mime", "'2024-01-01T00:00:00Z' AS exp_modified", "CASE WHEN file_id % 2 = 0 THEN '2024-01-01T01:00:00+01:00' END AS cur_modified", "CASE WHEN file_id % 37 = 0 THEN '1' END AS exp_version", "'2' AS cur_version")
    return f.select("file_id", shape.source_preflight().alias("reason"))


@query(fx.with_(fx.FILES) + "SELECT coalesce(CASE WHEN file_id % 5 = 0 THEN NULL ELSE mime_type END, '(none)') AS mime_type, CAST(count(*) AS BIGINT) AS n FROM files GROUP BY 1")
def mime_distribution(spark, sf_dir):
    return shape.distribution(fx.files(spark, sf_dir, "file_id", "mime_type").withColumn("mime_type", F.expr("CASE WHEN file_id % 5 <> 0 THEN mime_type END")), "mime_type")


@query(fx.with_(fx.FILES, _REASON) + "(SELECT file_id, decision FROM decisions WHERE decision = 'TAKE' ORDER BY file_id LIMIT 7) UNION ALL (SELECT file_id, decision FROM decisions WHERE decision = 'SKIP' ORDER BY file_id LIMIT 1)")
def stratified_sample(spark, sf_dir):
    """The first seven TAKE rows and the first SKIP row (a sampling operator)."""
    return shape.stratified_sample(_decided(spark, sf_dir), "decision", {"TAKE": 7, "SKIP": 1}, "file_id").select("file_id", "decision")


@query(fx.with_(fx.FILES) + """, l AS (SELECT content_hash AS asset_id, file_id FROM files), a AS (SELECT DISTINCT content_hash AS asset_id FROM files WHERE file_id % 4 <> 0)
SELECT CAST((SELECT count(*) FROM l WHERE file_id % 10 = 0) AS BIGINT) AS links_without_file, CAST((SELECT count(*) FROM l WHERE asset_id NOT IN (SELECT asset_id FROM a)) AS BIGINT) AS links_without_asset, CAST(0 AS BIGINT) AS assets_without_link, CAST(0 AS BIGINT) AS repeated_assets""")
def link_integrity(spark, sf_dir):
    f = fx.files(spark, sf_dir, "file_id", "content_hash").withColumnRenamed("content_hash", "asset_id")
    return shape.integrity(f.where("file_id % 10 <> 0").select("file_id"), f, f.where("file_id % 4 <> 0").select("asset_id").distinct())


@query(fx.with_(fx.DESTINATIONS) + """SELECT asset_id, CAST(count(*) AS BIGINT) AS n, min(id) AS first_id, arg_min(upload_status, id) AS first_status FROM destinations GROUP BY 1""")
def nested_destinations(spark, sf_dir):
    """Assets with their destinations as ordered lists."""
    d = fx.destinations(spark, sf_dir)
    x = shape.with_links(d.select("asset_id").distinct(), d.select("asset_id", F.col("id").alias("file_id")), d)
    return x.select("asset_id", F.size("destinations").cast("long").alias("n"), F.col("first_destination.id").alias("first_id"), F.col("first_destination.upload_status").alias("first_status"))


@query("SELECT user_id, CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (WHERE event_type = 'click') AS BIGINT) AS click, CAST(count(*) FILTER (WHERE event_type = 'error') AS BIGINT) AS error FROM events GROUP BY 1")
def run_totals(spark, sf_dir):
    return shape.run_totals(fx.table(spark, sf_dir, "events").selectExpr("user_id", "event_type AS outcome"), "user_id", ("click", "error"))


@query("SELECT user_id, max(struct_pack(ts := ts, event_id := event_id)).event_id AS event_id, arg_max(event_type, struct_pack(ts := ts, event_id := event_id)) AS event_type FROM events GROUP BY 1")
def latest_event(spark, sf_dir):
    return shape.latest_by(fx.table(spark, sf_dir, "events"), "user_id", "ts", "event_id").select("user_id", "event_id", "event_type")


@query(fx.with_(fx.DESTINATIONS) + "SELECT id, CASE upload_status WHEN 'FAILED_RETRYABLE' THEN 'RETRYABLE_FAILURE' WHEN 'FAILED_PERMANENT' THEN 'PERMANENT_FAILURE' ELSE 'OTHER' END AS bucket, attempts = 5 AS exception FROM destinations")
def outcome_buckets(spark, sf_dir):
    d = fx.destinations(spark, sf_dir).withColumns({"failure": F.lit(""), "again": F.col("attempts") == 5})
    return d.select("id", shape.outcome_bucket("upload_status").alias("bucket"), shape.is_exception("upload_status", "failure", "again").alias("exception"))


@query("SELECT CAST(event_id AS DECIMAL(18,0)) AS event_id, CAST(CAST((event_id * 25 + user_id * 100 + 5) // 10 AS DECIMAL(12,0)) * CAST(0.000001 AS DECIMAL(6,6)) AS DECIMAL(18,6)) AS cost FROM events")
def token_costs(spark, sf_dir):
    e = fx.table(spark, sf_dir, "events")
    return e.select(F.col("event_id").cast("decimal(18,0)").alias("event_id"), shape.token_cost("event_id", "user_id", 2.5, 10).alias("cost"))


@query(fx.with_(fx.FILES) + "SELECT file_extension, listagg(DISTINCT mime_type, ',' ORDER BY mime_type) AS mime_types, CAST(count(DISTINCT mime_type) AS BIGINT) AS n FROM files GROUP BY 1")
def vocabulary(spark, sf_dir):
    """Ordered distinct values by key."""
    f = fx.files(spark, sf_dir, "file_extension", "mime_type").groupBy("file_extension").agg(F.array_sort(F.collect_set("mime_type")).alias("m"))
    return f.select("file_extension", F.array_join("m", ",").alias("mime_types"), F.size("m").cast("long").alias("n"))
