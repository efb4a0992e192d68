"""Queries over the whole library: previews of rules, preflights, destination plans, locations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import checks, destinations, preview, rules
from . import catalogue
from . import fixtures as fx
from .catalogue import _REASON, RULE_COLUMNS, RULES, query


def uuid5_sql(name: str) -> str:
    """DuckDB: the version-5 UUID of a text in the namespace of addresses."""
    h = f"sha1(from_hex('6ba7b8119dad11d180b400c04fd430c8') || encode({name}))"
    return f"(SELECT concat(substr(h, 1, 8), '-', substr(h, 9, 4), '-5', substr(h, 14, 3), '-', substr('89ab89ab89ab89ab', CAST(('0x' || substr(h, 17, 1)) AS INT) + 1, 1), substr(h, 18, 3), '-', substr(h, 21, 12)) FROM (SELECT {h} AS h))"


catalogue.SQL["idempotency_keys"] = fx.with_(fx.FILES) + f"SELECT file_id, {uuid5_sql(chr(39) + 'asset-destination:' + chr(39) + ' || checksum || ' + chr(39) + '|folder|v1' + chr(39))} AS key FROM files"

_CURRENT = "CASE file_id % 4 WHEN 0 THEN 'TAKE' WHEN 1 THEN 'SKIP' WHEN 2 THEN 'PENDING' END"
_STATE = "CASE file_id % 4 WHEN 0 THEN 'READY' WHEN 1 THEN 'SKIPPED' WHEN 2 THEN CASE WHEN file_id % 6 = 0 THEN 'INACCESSIBLE' ELSE 'DISCOVERED' END END"
_PREVIEW = fx.with_(
    fx.FILES,
    f"before AS (SELECT * REPLACE (CASE WHEN {_STATE} = 'INACCESSIBLE' THEN 'inaccessible' ELSE accessibility_status END AS accessibility_status), {_CURRENT} AS current_decision, {_STATE} AS current_status FROM files)",
    _REASON.replace("FROM files)", "FROM before)"),
    """judged AS (SELECT *, CASE reason_code WHEN 'FOLDER_ITEM' THEN 'DISCOVERED' WHEN 'INACCESSIBLE' THEN 'INACCESSIBLE' WHEN 'SUPPORTED_FORMAT' THEN 'READY' ELSE 'SKIPPED' END AS target_status,
 reason_code IN ('UNSUPPORTED_MIME_TYPE', 'ZERO_BYTE_FILE', 'SUPPORTED_FORMAT') AND file_extension NOT IN ('pdf', 'pptx') AS accepted FROM decisions)""",
)
_CHANGED = "(current_decision IS DISTINCT FROM decision OR current_status IS DISTINCT FROM target_status)"


def _proposed(spark, sf_dir):
    f = fx.files(spark, sf_dir, *RULE_COLUMNS).selectExpr("*", f"{_CURRENT} AS current_decision", f"{_STATE} AS current_status")
    return preview.proposed(f, RULES)


@query(_PREVIEW + f"SELECT file_extension AS extension, mime_type, coalesce(current_decision, '(missing)') AS current_decision, coalesce(current_status, '(missing)') AS current_status, decision AS proposed_decision, target_status AS proposed_status, reason_code, accepted AS accepted_for_analysis, CAST(count(*) AS BIGINT) AS n FROM judged WHERE {_CHANGED} GROUP BY ALL")
def rule_change_groups(spark, sf_dir):
    """Files whose decision or status the rules would change, by the eight keys of a preview."""
    return preview.changes(_proposed(spark, sf_dir))


@query(_PREVIEW + f"""SELECT count(*) AS total_rows, count(*) FILTER (current_decision = 'TAKE' AND current_status = 'READY') AS current_take_ready, count(*) FILTER (current_decision = 'SKIP' AND current_status = 'SKIPPED') AS current_skip_skipped,
 count(*) FILTER (decision = 'TAKE' AND target_status = 'READY') AS proposed_take_ready, count(*) FILTER (decision = 'SKIP' AND target_status = 'SKIPPED') AS proposed_skip_skipped, count(*) FILTER (NOT {_CHANGED}) AS unchanged, count(*) FILTER ({_CHANGED}) AS changed,
 count(*) FILTER (reason_code = 'INACCESSIBLE') AS inaccessible, count(*) FILTER (reason_code = 'FOLDER_ITEM') AS folder_rows, count(*) FILTER (reason_code = 'GOOGLE_NATIVE_FILE') AS native_skip, count(*) FILTER (file_extension = 'heic' AND decision = 'SKIP') AS heic_skip,
 count(*) - count(DISTINCT (folder_id, file_id)) AS duplicate_identities FROM judged""")
def rule_change_summary(spark, sf_dir):
    """Counters of a preview over all files."""
    return preview.summary(_proposed(spark, sf_dir))


@query(fx.with_(fx.FILES) + """, k AS (SELECT *, CASE WHEN mime_type LIKE 'image/%' THEN 'image' WHEN mime_type LIKE 'video/%' THEN 'video' WHEN mime_type = 'application/pdf' OR mime_type LIKE '%presentation%' THEN 'document' WHEN file_extension IN ('jpg', 'jpeg', 'png', 'webp') THEN 'image'
 WHEN file_extension IN ('mp4', 'mov') THEN 'video' WHEN file_extension IN ('pdf', 'pptx') THEN 'document' ELSE 'other' END AS kind, file_id IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 7 <> 0) AS verified FROM files)
SELECT folder_id, CAST(count(*) FILTER (kind = 'image') AS BIGINT) AS images, CAST(count(*) FILTER (kind = 'video') AS BIGINT) AS videos, CAST(count(*) FILTER (kind = 'document') AS BIGINT) AS documents, CAST(count(*) FILTER (kind = 'other') AS BIGINT) AS others, CAST(count(DISTINCT CASE WHEN verified THEN content_hash END) AS BIGINT) AS verified_assets FROM k GROUP BY 1""")
def folder_library(spark, sf_dir):
    """Per folder: files of every category, and distinct contents with a verified destination."""
    f = fx.files(spark, sf_dir, "folder_id", "file_id", "file_extension", "mime_type", "content_hash")
    done = fx.destinations(spark, sf_dir).where("upload_status = 'VERIFIED' and destination_file_id is not null").select(F.col("asset_id").alias("file_id"), F.lit(True).alias("verified")).distinct()
    kind = rules.media_category("mime_type", "file_extension")
    counts = [F.count_if(kind == k).alias(f"{k}s") for k in ("image", "video", "document", "other")]
    return f.join(done, "file_id", "left").groupBy("folder_id").agg(*counts, F.count_distinct(F.when(F.col("verified"), F.col("content_hash"))).alias("verified_assets"))


_PLAN = fx.with_(fx.FILES, _REASON, "assets AS (SELECT min(file_id) AS asset_id, content_hash FROM files GROUP BY content_hash)",
    "valid AS (SELECT a.asset_id, a.content_hash, d.* EXCLUDE (content_hash) FROM assets a JOIN decisions d ON d.content_hash = a.content_hash WHERE decision = 'TAKE' AND file_id % 16 <> 0 AND NOT trashed AND NOT is_missing)",
    "chosen AS (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY folder_id, file_id) AS k FROM valid QUALIFY k = 1)")


@query(_PLAN + f"""SELECT {uuid5_sql("'destination-record:' || asset_id || '|root|v1'")} AS id, asset_id, file_id AS selected_file_id, concat('asset__', left(md5(CAST(asset_id AS VARCHAR)), 8), '.', file_extension) AS filename,
 concat(CASE WHEN mime_type LIKE 'image/%' THEN 'Images' WHEN mime_type LIKE 'video/%' THEN 'Videos' ELSE 'Documents' END, '/asset__', left(md5(CAST(asset_id AS VARCHAR)), 8), '.', file_extension) AS relative_path,
 {uuid5_sql("'asset-destination:' || asset_id || '|root|v1'")} AS idempotency_key, size_bytes AS expected_bytes, content_hash AS source_sha256, concat('{{"file_id":', file_id, ',"folder_id":', folder_id, ',"hash_algorithm":"SHA-256","expected_bytes":', size_bytes, ',"mime_type":"', mime_type, '","file_extension":"', file_extension, '"}}') AS source_snapshot FROM chosen""")
def destination_rows(spark, sf_dir):
    """First destination rows of all assets: valid source, route, name, keys and snapshot in one plan; assets without a valid source have none."""
    files = rules.decide(fx.files(spark, sf_dir, *RULE_COLUMNS, "content_hash"), RULES).withColumn("processing_status", F.when((F.col("decision") == "TAKE") & (F.col("file_id") % 16 != 0), "READY").otherwise("SKIPPED")).drop("accessibility_status").withColumn("accessibility_status", F.lit("OK"))
    assets = files.groupBy("content_hash").agg(F.min("file_id").alias("asset_id"))
    links = files.select("content_hash", "file_id").join(assets, "content_hash").select("asset_id", "file_id")
    out = destinations.plan(assets, links, files, "root", "v1")
    return out.select("id", "asset_id", "selected_file_id", "filename", "relative_path", "idempotency_key", "expected_bytes", "source_sha256", "source_snapshot")


@query(fx.with_(fx.DESTINATIONS, fx.FILES) + """, d AS (SELECT asset_id, count(*) AS n, min(CASE WHEN upload_status = 'VERIFIED' AND destination_file_id <> '' THEN id END) AS first FROM destinations GROUP BY 1),
s AS (SELECT file_id % 1500 AS asset_id, min(file_id) AS first FROM files WHERE NOT trashed AND NOT is_missing GROUP BY 1),
a AS (SELECT c_custkey AS asset_id, c_mktsegment <> 'BUILDING' AS active, CASE WHEN c_custkey % 6 <> 0 THEN concat('n', c_custkey, '.jpg') END AS file_name, CASE WHEN c_custkey % 5 <> 0 THEN 'image/jpeg' END AS mime_type, 'jpg' AS file_extension, CAST(c_custkey AS BIGINT) AS size_bytes FROM customer),
r AS (SELECT a.*, d.n, o.id, o.destination_file_id, f.file_id, f.file_name AS s_name, f.mime_type AS s_mime, f.file_extension AS s_ext, f.size_bytes AS s_size,
 CASE WHEN NOT active THEN 'inactive_asset' WHEN o.id IS NOT NULL THEN 'destination' WHEN f.file_id IS NOT NULL THEN 'source_fallback' WHEN d.n IS NOT NULL THEN 'no_verified_destination_or_fallback' ELSE 'no_destination' END AS reason
 FROM a LEFT JOIN d USING (asset_id) LEFT JOIN destinations o ON o.id = d.first LEFT JOIN s ON s.asset_id = a.asset_id LEFT JOIN files f ON f.file_id = s.first)
SELECT asset_id, reason, CASE reason WHEN 'destination' THEN destination_file_id WHEN 'source_fallback' THEN CAST(file_id AS VARCHAR) END AS file_id, CASE reason WHEN 'destination' THEN CASE WHEN id % 2 = 0 THEN concat('d', id, '.jpg') ELSE coalesce(file_name, 'download') END WHEN 'source_fallback' THEN s_name END AS filename,
 CASE reason WHEN 'destination' THEN coalesce(mime_type, 'application/octet-stream') WHEN 'source_fallback' THEN s_mime END AS mime_type, CASE reason WHEN 'destination' THEN file_extension WHEN 'source_fallback' THEN s_ext END AS extension,
 CASE reason WHEN 'destination' THEN size_bytes WHEN 'source_fallback' THEN CASE WHEN s_size = 0 THEN size_bytes ELSE s_size END END AS size_bytes, CASE reason WHEN 'destination' THEN CASE WHEN id % 3 = 0 THEN 'at-' || id ELSE CAST(id AS VARCHAR) END WHEN 'source_fallback' THEN 'source' END AS version_tag FROM r""")
def media_locations(spark, sf_dir):
    """Where every asset is served from: verified destination, else a source, with name, type, size and version."""
    assets = fx.table(spark, sf_dir, "customer").selectExpr("c_custkey AS asset_id", "c_mktsegment <> 'BUILDING' AS active", "CASE WHEN c_custkey % 6 <> 0 THEN concat('n', c_custkey, '.jpg') END AS file_name", "CASE WHEN c_custkey % 5 <> 0 THEN 'image/jpeg' END AS mime_type", "'jpg' AS file_extension", "CAST(c_custkey AS BIGINT) AS size_bytes")
    d = fx.destinations(spark, sf_dir).withColumns({"destination_filename": F.expr("CASE WHEN id % 2 = 0 THEN concat('d', id, '.jpg') END"), "verified_at": F.expr("CASE WHEN id % 3 = 0 THEN concat('at-', id) END")})
    s = fx.files(spark, sf_dir, "file_id", "file_name", "mime_type", "file_extension", "size_bytes", "trashed", "is_missing").withColumn("asset_id", F.col("file_id") % 1500)
    return destinations.located(assets, d, s)


@query(fx.with_(fx.FILES, fx.DESTINATIONS) + """, a AS (SELECT DISTINCT content_hash AS asset_id FROM files), l AS (SELECT CASE WHEN file_id % 97 = 0 THEN 'gone' ELSE content_hash END AS asset_id, file_id FROM files WHERE file_id % 5 <> 0 UNION ALL SELECT content_hash, -file_id - 1 FROM files WHERE file_id % 89 = 0)
SELECT (SELECT count(*) FROM a) AS canonical_candidates, (SELECT count(*) FROM destinations) AS asset_destinations, (SELECT count(claim_owner) FROM destinations) AS active_claims, (SELECT count(claim_expires_at) FROM destinations) AS active_leases, (SELECT count(*) FILTER (upload_status = 'UPLOADED') FROM destinations) AS uploaded_rows,
 (SELECT count(*) FILTER (upload_status = 'VERIFIED') FROM destinations) AS verified_rows, (SELECT count(destination_file_id) FROM destinations) AS destination_file_ids, (SELECT count(*) FROM a) AS assets, (SELECT count(*) FROM l) AS asset_sources,
 (SELECT count(*) FROM l WHERE asset_id NOT IN (SELECT asset_id FROM a) OR file_id NOT IN (SELECT file_id FROM files)) AS orphan_relationships, CASE WHEN (SELECT count(*) FROM a) <> 1000 THEN 'CANDIDATE_COUNT_MISMATCH' WHEN (SELECT count(*) FROM destinations) <> 0 THEN 'DESTINATION_COUNT_MISMATCH' END AS reason""")
def run_preflight(spark, sf_dir):
    """Counters and the first reason against a run over the whole catalogue."""
    f = fx.files(spark, sf_dir, "file_id", "content_hash")
    assets = f.select(F.col("content_hash").alias("asset_id")).distinct()
    links = f.where("file_id % 5 <> 0").selectExpr("CASE WHEN file_id % 97 = 0 THEN 'gone' ELSE content_hash END AS asset_id", "file_id").unionByName(f.where("file_id % 89 = 0").selectExpr("content_hash AS asset_id", "-file_id - 1 AS file_id"))
    return preview.preflight(assets, links, f, assets, fx.destinations(spark, sf_dir), 1000, 0)


_SIZE = "CASE file_id % 7 WHEN 0 THEN concat('\"', size_bytes, '\"') WHEN 1 THEN 'true' WHEN 2 THEN concat(size_bytes, '.5') WHEN 3 THEN 'null' WHEN 4 THEN '{\"a\":1}' ELSE concat('', size_bytes) END"
_RAW = f"concat('{{\"file_id\":', CASE WHEN file_id % 5 = 0 THEN concat('', file_id) ELSE concat('\"', file_id, '\"') END, ',\"name\":', CASE WHEN file_id % 11 = 0 THEN '[\"x\"]' ELSE concat('\"', file_name, '\"') END, ',\"size\":', {_SIZE}, CASE WHEN file_id % 13 = 0 THEN ',\"md5_checksum\":false' ELSE '' END, CASE WHEN file_id % 17 = 0 THEN '' ELSE '}}' END)"


@query(fx.with_(fx.FILES) + f""", r AS (SELECT file_id, {_RAW} AS raw FROM files), t AS (SELECT file_id, CASE WHEN json_valid(raw) THEN raw END AS raw FROM r)
SELECT file_id, CASE WHEN raw IS NOT NULL THEN concat_ws('|', CASE WHEN json_type(raw, '$.file_id') NOT IN ('VARCHAR', 'NULL') THEN 'file_id' END, CASE WHEN json_type(raw, '$.name') NOT IN ('VARCHAR', 'NULL') THEN 'name' END,
 CASE WHEN json_type(raw, '$.size') NOT IN ('BIGINT', 'UBIGINT', 'NULL') THEN 'size' END, CASE WHEN json_type(raw, '$.md5_checksum') NOT IN ('VARCHAR', 'NULL') THEN 'md5_checksum' END) END AS wrong FROM t""")
def item_types(spark, sf_dir):
    """Fields of raw inventory items whose JSON type is wrong; null for broken JSON."""
    raw = fx.files(spark, sf_dir, "file_id", "file_name", "size_bytes").selectExpr("file_id", f"{_RAW} AS raw")
    return raw.select("file_id", F.array_join(checks.wrong_types("raw"), "|").alias("wrong"))
