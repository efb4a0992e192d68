"""Queries of row checks, queues and records, each with SQL of the same meaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import hashing, text
from ..operators import checks, inventory, lifecycle, queues, records, rules, shape
from . import fixtures as fx
from .catalogue import _REASON, _decided, query

NOW = "TIMESTAMP '1997-01-01 00:00:00'"


def _now():
    return F.expr(NOW)


# folders and files


@query(fx.with_(fx.FILES) + "SELECT file_id, file_name FROM files WHERE folder_id = 3")
def folder_children(spark, sf_dir):
    """The immediate children of one folder."""
    return fx.files(spark, sf_dir, "file_id", "folder_id", "file_name").where("folder_id = 3").select("file_id", "file_name")


@query("SELECT c_custkey AS id, concat(r_name, '/', n_name, '/', c_name) AS path FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def tree_files(spark, sf_dir):
    """The files of a tree with their paths; folders are walked by level and dropped."""
    of = lambda t, e: fx.table(spark, sf_dir, t).selectExpr(*e)
    folders = of("region", ["'root' AS parent", "concat('r', r_regionkey) AS node", "r_name AS name"]).unionByName(of("nation", ["concat('r', n_regionkey) AS parent", "concat('n', n_nationkey) AS node", "n_name AS name"]))
    paths = inventory.folder_paths(folders, "root").select("node", "path")
    files = of("customer", ["c_custkey AS id", "concat('n', c_nationkey) AS node", "c_name"])
    return files.join(paths, "node").select("id", F.concat_ws("/", "path", "c_name").alias("path"))


@query(fx.with_(fx.FILES, _REASON) + "SELECT file_id, CASE WHEN is_folder THEN 'folder' WHEN reason_code = 'SUPPORTED_FORMAT' THEN 'supported_media' ELSE 'unsupported' END AS classification FROM decisions")
def item_classes(spark, sf_dir):
    return _decided(spark, sf_dir).select("file_id", checks.item_class().alias("classification"))


@query(fx.with_(fx.FILES, _REASON) + "SELECT file_id, decision, reason_code AS reason FROM decisions WHERE NOT is_folder")
def legacy_decisions(spark, sf_dir):
    """The two-column view that older callers read."""
    return _decided(spark, sf_dir).where("not is_folder").select("file_id", "decision", F.col("reason_code").alias("reason"))


@query(fx.with_(fx.FILES) + "SELECT file_id FROM files WHERE contains(lower(file_name), '_1') AND lower(file_extension) = 'png'")
def filtered_library(spark, sf_dir):
    """Filters of the library: part of a name, in which ``_`` is itself, and an extension."""
    return fx.files(spark, sf_dir, "file_id", "file_name", "file_extension").where(checks.matching(name="_1", ext="PNG")).select("file_id")


@query(fx.with_(fx.FILES, _REASON) + "SELECT file_id, decision FROM decisions WHERE contains(lower(file_name), 'f1') AND decision = 'TAKE' AND mime_type = 'video/mp4'")
def filtered_decisions(spark, sf_dir):
    return _decided(spark, sf_dir).where(checks.matching(name="F1", decision="TAKE", mime_type="video/mp4", processing_status=None)).select("file_id", "decision")


@query(fx.with_(fx.FILES) + "SELECT file_id, CASE WHEN (file_extension IN ('jpg', 'jpeg') AND mime_type = 'image/jpeg') OR (file_extension IN ('png', 'webp') AND mime_type = concat('image/', file_extension)) THEN 'Images' WHEN (file_extension = 'mp4' AND mime_type = 'video/mp4') OR (file_extension = 'mov' AND mime_type = 'video/quicktime') THEN 'Videos' WHEN (file_extension = 'pdf' AND mime_type = 'application/pdf') OR (file_extension = 'pptx' AND mime_type LIKE '%presentationml.presentation') THEN 'Documents' END AS route FROM files")
def destination_routes(spark, sf_dir):
    return fx.files(spark, sf_dir, "file_id", "file_extension", "mime_type").select("file_id", checks.route(F.concat(F.lit("."), F.upper("file_extension")), F.upper("mime_type")).alias("route"))


_HASH = "h AS (SELECT *, CASE file_id % 5 WHEN 0 THEN 'NOT_STARTED' WHEN 1 THEN 'HASHING' WHEN 2 THEN 'HASHED' WHEN 3 THEN 'FAILED_RETRYABLE' ELSE 'FAILED_PERMANENT' END AS hash_status, CASE WHEN decision = 'TAKE' THEN 'READY' ELSE 'SKIPPED' END AS processing_status FROM decisions)"


def _hashing(spark, sf_dir, *more):
    status = "CASE file_id % 5 WHEN 0 THEN 'NOT_STARTED' WHEN 1 THEN 'HASHING' WHEN 2 THEN 'HASHED' WHEN 3 THEN 'FAILED_RETRYABLE' ELSE 'FAILED_PERMANENT' END"
    return _decided(spark, sf_dir, *more).withColumns({"hash_status": F.expr(status), "processing_status": F.expr("CASE WHEN decision = 'TAKE' THEN 'READY' ELSE 'SKIPPED' END")})


@query(fx.with_(fx.FILES, _REASON, _HASH) + """SELECT file_id, coalesce(decision = 'TAKE' AND NOT trashed AND NOT is_missing AND hash_status IN ('NOT_STARTED', 'FAILED_RETRYABLE') AND size_bytes > 0, false) AS hashable,
 hash_status = 'HASHED' AND decision = 'TAKE' AND NOT trashed AND NOT is_missing AND accessibility_status = 'accessible' AS canonical FROM h""")
def eligibility(spark, sf_dir):
    """Whether a file may be hashed, and whether it may stand for its content."""
    return _hashing(spark, sf_dir, "content_hash").select("file_id", checks.may_be_hashed().alias("hashable"), checks.may_be_canonical("content_hash").alias("canonical"))


@query(fx.with_(fx.FILES) + "SELECT file_id, CASE WHEN trashed THEN 'SOURCE_TRASHED' WHEN file_id % 22 = 0 THEN 'SOURCE_ACCESS_DENIED' WHEN mime_type LIKE 'application/vnd.google-apps.%' THEN 'NATIVE_FORMAT' WHEN file_id % 12 = 0 THEN 'SIZE_CHANGED' WHEN file_id % 14 = 0 THEN 'REVISION_CHANGED' WHEN file_id % 15 = 0 THEN 'MODIFIED_TIME_CHANGED' END AS reason FROM files")
def hashing_preflight(spark, sf_dir):
    """Ordered reasons against hashing a source."""
    f = fx.files(spark, sf_dir, "file_id", "size_bytes", "mime_type", "trashed")
    f = f.selectExpr("file_id", "trashed AS cur_trashed", "file_id % 22 <> 0 AS cur_can_download", "CAST(file_id AS STRING) AS inv_id", "CAST(file_id AS STRING) AS cur_id", "mime_type AS inv_mime", "mime_type AS cur_mime", "size_bytes AS inv_size", "CASE WHEN file_id % 12 = 0 THEN size_bytes + 1 WHEN file_id % 4 = 1 THEN NULL ELSE size_bytes END AS cur_size",
                     "CAST(NULL AS STRING) AS inv_version", "'3' AS cur_version", "'a' AS inv_revision", "CASE WHEN file_id % 14 = 0 THEN 'b' ELSE 'a' END AS cur_revision", "'2024-01-01T00:00:00Z' AS inv_modified", "CASE WHEN file_id % 15 = 0 THEN '2024-01-02T00:00:00Z' ELSE '2024-01-01T02:00:00+02:00' END AS cur_modified")
    return f.select("file_id", checks.hash_preflight().alias("reason"))


# checks


@query("SELECT doc_id, array_to_string(list_filter([CASE WHEN doc_id % 6 = 1 THEN 'keys' END, CASE WHEN doc_id % 6 = 2 THEN 'name' END, CASE WHEN doc_id % 6 = 3 THEN 'size' END, CASE WHEN doc_id % 6 IN (3, 4) THEN 'modified_time' END], lambda x: x IS NOT NULL), ',') AS errors FROM documents")
def strict_items(spark, sf_dir):
    """Items as JSON: exact keys, texts, a size, a time with a zone."""
    raw = F.expr("to_json(named_struct('file_id', concat('g', doc_id), 'name', CASE WHEN doc_id % 6 = 2 THEN ' ' ELSE lang END, 'size', CASE WHEN doc_id % 6 = 3 THEN -1 ELSE n_chars END, 'modified_time', CASE doc_id % 6 WHEN 3 THEN '2024-01-01T00:00:00' WHEN 4 THEN '2024-13-01T00:00:00Z' ELSE '2024-01-01T00:00:00+02:00' END, 'more', CASE WHEN doc_id % 6 = 1 THEN 1 END))")
    errors = checks.json_item_errors("raw", ("file_id", "name", "size", "modified_time"), ("file_id", "name"), "size", "modified_time")
    return fx.table(spark, sf_dir, "documents").select("doc_id", raw.alias("raw")).select("doc_id", F.array_join(errors, ",").alias("errors"))


@query(fx.with_(fx.DESTINATIONS) + """, r AS (SELECT id, unnest(list_filter([CASE WHEN upload_status NOT IN ('VERIFIED', 'QUEUED', 'NOT_STARTED', 'FAILED_RETRYABLE', 'CLAIMED') THEN 'upload_status:domain' END, CASE WHEN attempts - 1 < 0 THEN 'n:negative' END, CASE WHEN id % 3 = 0 THEN 'digest:digest' END, CASE WHEN claim_expires_at > CAST('1996-01-01' AS TIMESTAMP) THEN 'claim_expires_at:after:limit_at' END], lambda x: x IS NOT NULL)) AS rule FROM destinations)
SELECT rule, CAST(count(*) AS BIGINT) AS n FROM r GROUP BY 1""")
def domain_checks(spark, sf_dir):
    """Rows by broken CHECK rule: domains, counters, digests, order of times."""
    d = fx.destinations(spark, sf_dir).withColumns({"n": F.col("attempts") - 1, "digest": F.when(F.col("id") % 3 == 0, "ABC").otherwise(F.sha2(F.col("id").cast("string"), 256)), "limit_at": F.expr("TIMESTAMP '1996-01-01 00:00:00'")})
    allowed = {"upload_status": ("VERIFIED", "QUEUED", "NOT_STARTED", "FAILED_RETRYABLE", "CLAIMED")}
    return checks.domain_violations(d, "id", allowed, ("n",), ("digest",), (("claim_expires_at", "limit_at"),)).groupBy("rule").agg(F.count("*").alias("n"))


@query(fx.with_(fx.DESTINATIONS) + """SELECT id, CASE WHEN upload_status = 'VERIFIED' THEN CASE WHEN destination_file_id IS NULL THEN 'FILE_ID_MISSING' WHEN id % 11 = 0 THEN 'COMPLETION_TIME_MISSING' WHEN id % 13 = 0 THEN 'VERIFICATION_TIME_MISSING' WHEN id % 4 = 3 THEN 'VERIFICATION_LEVEL_INVALID' END
 WHEN upload_status = 'FAILED_RETRYABLE' THEN CASE WHEN id % 2 = 0 THEN 'NOT_RETRYABLE' WHEN id % 3 = 0 THEN 'FAILURE_CODE_MISSING' END END AS reason FROM destinations""")
def completeness_checks(spark, sf_dir):
    """Fields that a status demands."""
    d = fx.destinations(spark, sf_dir).withColumns({"upload_completed_at": F.expr("CASE WHEN id % 11 <> 0 THEN created_at END"), "verified_at": F.expr("CASE WHEN id % 13 <> 0 THEN created_at END"), "verification_level": F.expr("CASE id % 4 WHEN 0 THEN 'DESTINATION_METADATA_VERIFIED' WHEN 1 THEN 'PROVIDER_CHECKSUM_VERIFIED' WHEN 2 THEN 'DESTINATION_SHA256_VERIFIED' END"), "retryable": F.expr("id % 2 <> 0"), "failure_code": F.expr("CASE WHEN id % 3 <> 0 THEN 'X' END")})
    return d.select("id", checks.incomplete_destination().alias("reason"))


@query(fx.with_(fx.FILES, _REASON, _HASH) + "SELECT file_id, CASE WHEN hash_status = 'HASHED' THEN CASE WHEN file_id % 3 = 0 THEN 'DIGEST_OR_TIME_MISSING' WHEN file_id % 7 = 0 THEN 'FAILURE_ON_HASHED' END WHEN file_id % 3 <> 0 THEN 'DIGEST_WITHOUT_STATUS' END AS reason FROM h")
def hash_completeness(spark, sf_dir):
    h = _hashing(spark, sf_dir).withColumns({"content_sha256": F.expr("CASE WHEN file_id % 3 <> 0 THEN 'd' END"), "hash_completed_at": F.expr(f"CASE WHEN file_id % 3 <> 0 THEN {NOW} END"), "hash_retryable": F.lit(False), "hash_failure_code": F.expr("CASE WHEN file_id % 7 = 0 THEN 'X' END")})
    return h.select("file_id", checks.incomplete_hash().alias("reason"))


@query("SELECT CAST(2 AS BIGINT) AS failing, 'files.c, orders.b' AS names FROM (SELECT count(*) AS n FROM documents WHERE doc_id % 2 = 1) a, (SELECT count(*) AS n FROM orders WHERE o_orderkey % 5 = 0) b WHERE a.n > 0 AND b.n > 0")
def null_probes(spark, sf_dir):
    """Columns with nulls, after what can be was filled in."""
    d = checks.backfilled(fx.table(spark, sf_dir, "documents").selectExpr("CASE WHEN doc_id % 2 = 0 THEN lang END AS a", "CASE WHEN doc_id % 2 = 0 THEN lang END AS c"), {"a": F.lit("none")})
    o = fx.table(spark, sf_dir, "orders").selectExpr("o_orderkey AS a", "CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey END AS b")
    return checks.null_preflight({"files": (d, ("a", "c")), "orders": (o, ("a", "b"))})


@query(fx.with_(fx.DESTINATIONS) + "SELECT CASE upload_status WHEN 'NOT_STARTED' THEN 'PENDING' WHEN 'CLAIMED' THEN 'UPLOADING' ELSE upload_status END AS status, CAST(count(*) AS BIGINT) AS n FROM destinations GROUP BY 1")
def legacy_remap(spark, sf_dir):
    return fx.destinations(spark, sf_dir).groupBy(checks.remapped(F.col("upload_status"), {"NOT_STARTED": "PENDING", "CLAIMED": "UPLOADING"}).alias("status")).agg(F.count("*").alias("n"))


@query("SELECT r_regionkey AS id, concat('A,', r_name) AS found, r_regionkey % 2 = 0 AS same, r_regionkey <> 3 AS only_membership FROM region")
def vocabulary_compare(spark, sf_dir):
    """Literals of constraint expressions against what is expected, and whether an expression says nothing else."""
    r = fx.table(spark, sf_dir, "region").withColumn("e", F.expr("concat('CHECK ((status = ANY (ARRAY[''', r_name, '''::text, ''A''::text, ''', r_name, ''']))', CASE WHEN r_regionkey = 3 THEN ' AND x > 1' ELSE '' END, ')')"))
    found = checks.quoted_values(F.col("e"))
    want = F.when(F.col("r_regionkey") % 2 == 0, F.array_sort(F.array(F.lit("A"), F.col("r_name")))).otherwise(F.array(F.lit("A")))
    return r.select(F.col("r_regionkey").alias("id"), F.array_join(F.array_sort(found), ",").alias("found"), found.eqNullSafe(want).alias("same"), checks.is_membership(F.col("e"), "status").alias("only_membership"))


_REVIEW = "CASE WHEN doc_id % 9 = 0 THEN '' ELSE CASE WHEN doc_id % 10 = 0 THEN 'Invented' ELSE 'Other' END END"


@query("""WITH r AS (SELECT doc_id, doc_id // 2 AS a, doc_id % 9 = 0 AS no_type, doc_id % 10 = 0 AND doc_id % 9 <> 0 AS bad_type, doc_id % 7 = 0 AS no_caption, doc_id % 11 = 0 AS bad_time FROM documents),
e AS (SELECT *, CAST(no_type AS INT) + CAST(bad_type AS INT) + CAST(no_caption AS INT) + CAST(bad_time AS INT) + CAST(doc_id > min(doc_id) OVER (PARTITION BY a) AS INT) AS n, CAST(no_type AS INT) + CAST(no_caption AS INT) AS missing FROM r)
SELECT CASE WHEN n = 0 THEN 'complete' WHEN n = missing THEN 'incomplete' ELSE 'invalid' END AS status, CAST(count(*) AS BIGINT) AS n, CAST(sum(n) AS BIGINT) AS errors FROM e GROUP BY 1""")
def review_status(spark, sf_dir):
    """Reviewed rows by status, with all their errors; later rows of an asset are errors."""
    asset = F.expr("concat(lpad(CAST(doc_id DIV 2 AS STRING), 8, '0'), '-0000-4000-8000-000000000000')")
    rows = fx.table(spark, sf_dir, "documents").select("doc_id", asset.alias("asset_id"), F.expr(_REVIEW).alias("content_type"), F.expr("CASE WHEN doc_id % 7 = 0 THEN NULL ELSE lang END").alias("short_caption"), F.lit("d").alias("ai_description"), F.lit("r").alias("reviewed_by"), F.expr("CASE WHEN doc_id % 11 = 0 THEN '2024-01-01' ELSE '2024-01-01T00:00:00Z' END").alias("reviewed_at"))
    df = checks.reviewed_manifest(rows, "doc_id", fx.CONTENT_TYPES, ("r",))
    return df.groupBy(checks.review_status().alias("status")).agg(F.count("*").alias("n"), F.sum(F.size("errors")).cast("long").alias("errors"))


@query(fx.with_(fx.FILES) + """, e AS (SELECT * FROM (VALUES ('jpg', CAST(10 AS BIGINT)), ('mp4', CAST(5 AS BIGINT)), ('gif', CAST(1 AS BIGINT))) v(file_extension, expected)), a AS (SELECT file_extension, count(*) AS actual FROM files WHERE folder_id = 1 GROUP BY 1)
SELECT coalesce(e.file_extension, a.file_extension) AS file_extension, coalesce(expected, 0) AS expected, CAST(coalesce(actual, 0) AS BIGINT) AS actual, coalesce(expected, 0) = coalesce(actual, 0) AS ok FROM e FULL JOIN a ON e.file_extension = a.file_extension""")
def manifest_mix(spark, sf_dir):
    """Formats of a selection against what was agreed."""
    f = fx.files(spark, sf_dir, "file_id", "folder_id", "file_extension").where("folder_id = 1").withColumnRenamed("file_id", "asset_id")
    return checks.manifest_mix(f, {"jpg": 10, "mp4": 5, "gif": 1})


@query("SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'SIZE_MISMATCH' WHEN doc_id % 3 = 0 THEN 'DIGEST_MISMATCH' END AS reason FROM documents")
def download_checks(spark, sf_dir):
    d = fx.table(spark, sf_dir, "documents").selectExpr("doc_id", "n_chars AS size_bytes", "md5(text) AS content_hash", "CASE WHEN doc_id % 5 = 0 THEN NULL ELSE n_chars END AS got_size", "CASE WHEN doc_id % 3 = 0 THEN 'x' ELSE upper(md5(text)) END AS got_hash")
    return d.select("doc_id", checks.download_mismatch().alias("reason"))


@query("SELECT c_custkey AS id, true AS can_download FROM customer WHERE c_mktsegment <> 'MACHINERY'")
def access_gate(spark, sf_dir):
    """What a member sees: no clinical rows."""
    users = spark.createDataFrame([("u1", "MEMBER", True, True, False), ("u2", "ADMIN", False, True, True)], "user_id string, role string, active boolean, can_download boolean, can_view_clinical boolean")
    rows = fx.table(spark, sf_dir, "customer").selectExpr("c_custkey AS id", "c_mktsegment = 'MACHINERY' AS clinical")
    member = checks.visible(rows, users, "u1")
    inactive = checks.visible(rows, users, "u2", admin_only=True)
    return member.unionByName(inactive).select("id", "can_download")


@query("""SELECT CASE WHEN s IS NULL THEN k IN ('timeout', 'connection') ELSE s IN (408, 409, 429) OR s >= 500 END AS again, CASE WHEN k = 'timeout' THEN 'E_TIME' WHEN s = 429 THEN 'E_RATE' ELSE 'E_OTHER' END AS code, CAST(count(*) AS BIGINT) AS n
 FROM (SELECT CASE WHEN event_id % 3 = 0 THEN NULL ELSE 400 + event_id % 110 END AS s, CASE event_id % 4 WHEN 0 THEN 'timeout' WHEN 1 THEN 'connection' ELSE 'invalid' END AS k FROM events) GROUP BY ALL""")
def provider_errors(spark, sf_dir):
    """Errors of a provider: whether to try again, and the first known code in the message."""
    e = fx.table(spark, sf_dir, "events").selectExpr("CAST(CASE WHEN event_id % 3 = 0 THEN NULL ELSE 400 + event_id % 110 END AS INT) AS s", "CASE event_id % 4 WHEN 0 THEN 'timeout' WHEN 1 THEN 'connection' ELSE 'invalid' END AS k")
    message = F.concat_ws(" ", F.when(F.col("s") == 429, "got E_RATE"), F.when(F.col("k") == "timeout", "after E_TIME"))
    return e.groupBy((checks.provider_error(F.col("s"), F.col("k")) == "retryable").alias("again"), checks.first_code(message, ("E_TIME", "E_RATE"), "E_OTHER").alias("code")).agg(F.count("*").alias("n"))


@query("SELECT vec_id AS id, vec_id % 4 <> 0 AS is_vector, vec_id % 3 = 0 AS is_object FROM embeddings")
def json_shapes(spark, sf_dir):
    """JSON arrays that are vectors of a dimension, and JSON objects."""
    e = fx.table(spark, sf_dir, "embeddings").selectExpr("vec_id", "CASE WHEN vec_id % 4 = 0 THEN to_json(slice(embedding, 1, 3)) ELSE to_json(embedding) END AS v", "CASE vec_id % 3 WHEN 0 THEN ' {\"a\": [1]}' WHEN 1 THEN '[1]' ELSE '{broken' END AS o")
    return e.select(F.col("vec_id").alias("id"), checks.json_vector("v", 64).isNotNull().alias("is_vector"), checks.is_json_object("o").alias("is_object"))


@query("SELECT doc_id, doc_id % 3 = 0 AS is_uuid, true AS is_sha, doc_id % 2 = 0 AS is_md5 FROM documents")
def id_shapes(spark, sf_dir):
    u = F.expr("CASE WHEN doc_id % 3 = 0 THEN concat(upper(substr(md5(lang), 1, 8)), '-0000-4000-A000-', substr(md5(lang), 1, 12)) ELSE md5(lang) END")
    is_ = lambda c, p: checks.known(c.rlike(p))
    return fx.table(spark, sf_dir, "documents").select("doc_id", is_(u, checks.UUID).alias("is_uuid"), is_(F.sha2("lang", 256), checks.SHA256).alias("is_sha"), is_(F.expr("CASE WHEN doc_id % 2 = 0 THEN md5(lang) ELSE upper(md5(concat('a', lang))) END"), checks.MD5).alias("is_md5"))


# queues


@query(fx.with_(fx.FILES, _REASON, _HASH) + """SELECT file_id, CASE WHEN g THEN 'HASHING' ELSE hash_status END AS hash_status, CAST(CASE WHEN g THEN 1 ELSE 0 END AS INT) AS attempts, g AS updated FROM (SELECT *, file_id IN (5, 6, 8, 10, 13, 15, 18, 20, 26, 31, 36) AND decision = 'TAKE' AND (hash_status IN ('NOT_STARTED', 'FAILED_RETRYABLE') OR (hash_status = 'HASHING' AND file_id % 2 = 0)) AS g FROM h)""")
def claim_hash_tasks(spark, sf_dir):
    """Named files claimed for hashing; a lease in force is left alone."""
    h = _hashing(spark, sf_dir).withColumns({"attempts": F.lit(0), "claim_owner": F.lit("x"), "failure_code": F.lit("y"), "claim_expires_at": F.expr("CASE WHEN file_id % 2 = 0 THEN TIMESTAMP '1996-01-01 00:00:00' ELSE TIMESTAMP '1999-01-01 00:00:00' END")})
    return queues.claim_hash(h, [5, 6, 8, 10, 13, 15, 18, 20, 26, 31, 36], _now(), "w").select("file_id", "hash_status", "attempts", "updated")


_JOBS = "j AS (SELECT id, asset_id, created_at, attempts, CASE upload_status WHEN 'NOT_STARTED' THEN 'QUEUED' WHEN 'CLAIMED' THEN 'PROCESSING' WHEN 'FAILED_PERMANENT' THEN 'RETRY' ELSE upload_status END AS status, claim_expires_at, next_retry_at AS next_attempt_at FROM destinations)"


def _jobs(spark, sf_dir):
    status = F.expr("CASE upload_status WHEN 'NOT_STARTED' THEN 'QUEUED' WHEN 'CLAIMED' THEN 'PROCESSING' WHEN 'FAILED_PERMANENT' THEN 'RETRY' ELSE upload_status END")
    return fx.destinations(spark, sf_dir).select("id", "asset_id", "created_at", "attempts", status.alias("status"), "claim_owner", "claim_expires_at", F.col("next_retry_at").alias("next_attempt_at"))


@query(fx.with_(fx.DESTINATIONS, _JOBS) + f"""SELECT id AS asset_id, attempts + 1 AS attempts, 'PROCESSING' AS status FROM j WHERE attempts < 5 AND id % 2 = 1 AND (status IN ('QUEUED', 'FAILED_RETRYABLE') OR (status = 'PROCESSING' AND claim_expires_at <= {NOW}))
 ORDER BY CASE status WHEN 'FAILED_RETRYABLE' THEN 0 ELSE 1 END, created_at, id LIMIT 150""")
def claim_semantic_batch(spark, sf_dir):
    """150 index jobs claimed (the limit is the batch's), of those in scope."""
    return queues.claim_index_batch(_jobs(spark, sf_dir).where("id % 2 = 1").withColumn("asset_id", F.col("id")), _now(), "w", limit=150)


@query(fx.with_(fx.DESTINATIONS, _JOBS) + f"""SELECT id, 'PROCESSING' AS status, attempts + 1 AS attempts, 'w' AS claim_owner FROM j WHERE (status IN ('QUEUED', 'RETRY') AND coalesce(next_attempt_at, {NOW}) <= {NOW}) OR (status = 'PROCESSING' AND claim_expires_at < {NOW}) ORDER BY created_at, id LIMIT 1""")
def claim_visual_job(spark, sf_dir):
    """The oldest due job."""
    return queues.claim_one(_jobs(spark, sf_dir), _now(), "w").select("id", "status", "attempts", "claim_owner")


@query(fx.with_(fx.DESTINATIONS) + f"SELECT asset_id, id AS destination_id, 'CLAIM_RECOVERED' AS event_type, 'WARNING' AS event_status, '{{\"previous_status\":\"CLAIMED\",\"claim_owner\":\"w\"}}' AS details FROM destinations WHERE upload_status = 'CLAIMED' AND claim_expires_at <= {NOW} AND destination_folder_id = 'd1'")
def recovery_events(spark, sf_dir):
    """Events of claims of one folder whose lease ran out."""
    return queues.recovery_events(queues.in_scope(fx.destinations(spark, sf_dir), folder="d1"), _now())


@query(fx.with_(fx.DESTINATIONS) + "SELECT id, asset_id, 'LIFECYCLE_INITIALIZED' AS event_type, '{\"migration_version\":\"v1\",\"verification_level\":\"SOURCE_HASH_VERIFIED\"}' AS details, CASE upload_status WHEN 'VERIFIED' THEN 'VERIFIED' WHEN 'CLAIMED' THEN 'UPLOADING' WHEN 'FAILED_RETRYABLE' THEN 'FAILED' WHEN 'FAILED_PERMANENT' THEN 'FAILED' ELSE 'PENDING' END AS legacy FROM destinations")
def lifecycle_events(spark, sf_dir):
    """The event of each new row and the asset's legacy status."""
    d = fx.destinations(spark, sf_dir).withColumns({"migration_version": F.lit("v1"), "verification_level": F.lit("SOURCE_HASH_VERIFIED")})
    e = queues.initialized(d).select(F.col("destination_id").alias("id"), "asset_id", "event_type", "details")
    return e.join(d.select("id", queues.legacy_status().alias("legacy")), "id")


@query("SELECT concat('l', n_nationkey) AS lock_name, CASE WHEN n_nationkey % 5 = 0 THEN 'new' ELSE 'old' END AS owner FROM nation WHERE n_nationkey % 5 = 0 OR n_nationkey % 3 <> 0")
def lock_table(spark, sf_dir):
    """Locks after releases by their owner and granted requests."""
    n = fx.table(spark, sf_dir, "nation").selectExpr("n_nationkey AS k", "concat('l', n_nationkey) AS lock_name")
    locks = n.select("lock_name", F.lit("old").alias("owner"), _now().alias("expires_at"))
    released = n.where("k % 3 = 0").select("lock_name", F.lit("old").alias("owner")).unionByName(n.where("k % 3 = 1").select("lock_name", F.lit("stranger").alias("owner")))
    return queues.locks_after(locks, n.where("k % 5 = 0").select("lock_name", F.lit("new").alias("owner"), F.lit(60).alias("lease_seconds")), released, _now()).select("lock_name", "owner")


@query("SELECT user_id, CASE WHEN NOT bool_or(event_type = 'view') THEN 'view' WHEN NOT bool_or(event_type = 'click') THEN 'click' WHEN NOT bool_or(event_type = 'purchase') THEN 'purchase' WHEN NOT bool_or(event_type = 'error') THEN 'error' END AS next_stage FROM events GROUP BY 1")
def stage_resume(spark, sf_dir):
    """The stage at which each source goes on."""
    e = fx.table(spark, sf_dir, "events").selectExpr("user_id", "event_type AS stage", "true AS succeeded")
    return queues.next_stage(e, ("view", "click", "purchase", "error"), "user_id").select("user_id", "next_stage")


@query(fx.with_(fx.DESTINATIONS, _JOBS) + "SELECT CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (WHERE status = 'QUEUED') AS BIGINT) AS queued, CAST(count(*) FILTER (WHERE status = 'PROCESSING') AS BIGINT) AS processing, CAST(count(*) FILTER (WHERE status = 'VERIFIED') AS BIGINT) AS verified FROM j")
def job_states(spark, sf_dir):
    return queues.job_states(_jobs(spark, sf_dir), ("QUEUED", "PROCESSING", "VERIFIED"))


@query("""SELECT event_id, CASE WHEN event_id % 97 = 0 THEN 'ACTIVE_CLAIM_NOT_RELEASED' WHEN event_id % 89 = 0 THEN 'CANONICALIZATION_TABLE_CHANGED' WHEN event_id % 83 = 0 THEN 'NONSELECTED_ROW_CHANGED' WHEN event_id % 4 >= 2 THEN 'TWO_CONSECUTIVE_BYTE_MISMATCHES' WHEN event_id % 9 >= 3 THEN 'THREE_CONSECUTIVE_RETRY_EXHAUSTIONS'
 WHEN event_id % 30 * 20 >= event_id % 100 + 1 THEN 'SOURCE_CHANGE_OR_PERMANENT_FAILURE_RATE_5_PERCENT' WHEN event_id % 2 = 0 THEN 'PERSISTENT_HTTP_429' END AS reason FROM events""")
def stop_reasons(spark, sf_dir):
    """All reasons to stop a run, in their order."""
    e = fx.table(spark, sf_dir, "events").selectExpr("event_id", "event_id % 97 = 0 AS claim_held", "event_id % 89 = 0 AS tables_changed", "event_id % 83 = 0 AS others_changed", "event_id % 4 AS mismatches", "event_id % 9 AS exhaustions", "event_id % 30 AS severe_so_far", "event_id % 100 + 1 AS attempted", "event_id % 2 = 0 AS rate_limited")
    return e.select("event_id", queues.stop_reason().alias("reason"))


@query(fx.with_(fx.DESTINATIONS) + """, c AS (SELECT *, id % 50 = 0 AS i FROM destinations) SELECT 'all' AS kind, CAST(count(*) FILTER (WHERE i) AS BIGINT) AS cohort_rows, CAST(count(*) FILTER (WHERE i AND upload_status = 'VERIFIED') AS BIGINT) AS cohort_verified, CAST(count(DISTINCT CASE WHEN i THEN destination_file_id END) AS BIGINT) AS cohort_file_ids, CAST(count(*) FILTER (WHERE NOT i) AS BIGINT) AS outside_rows,
 CAST(count(*) FILTER (WHERE NOT i AND upload_status = 'NOT_STARTED' AND destination_file_id IS NULL) AS BIGINT) AS outside_untouched, CAST(count(*) FILTER (WHERE claim_owner IS NOT NULL OR claim_expires_at IS NOT NULL) AS BIGINT) AS claims, CAST(count(next_retry_at) AS BIGINT) AS retries, false AS clean FROM c
UNION ALL SELECT 'small', CAST(2 AS BIGINT), CAST(2 AS BIGINT), CAST(2 AS BIGINT), CAST(1 AS BIGINT), CAST(1 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), true""")
def cohort_reconciliation(spark, sf_dir):
    """The final counts of a cohort over all destinations, and over three rows that are clean."""
    d = fx.destinations(spark, sf_dir).select("id", "upload_status", "destination_file_id", "claim_owner", "claim_expires_at", "next_retry_at")
    small = spark.createDataFrame([(1, "VERIFIED", "a"), (2, "VERIFIED", "b"), (3, "NOT_STARTED", None)], "id long, upload_status string, destination_file_id string").selectExpr("*", "CAST(NULL AS STRING) AS claim_owner", "CAST(NULL AS TIMESTAMP) AS claim_expires_at", "CAST(NULL AS TIMESTAMP) AS next_retry_at")
    one = lambda k, rows, cohort, size, out: queues.cohort_reconciliation(rows, cohort, size, out).select(F.lit(k).alias("kind"), "*")
    return one("all", d, d.where("id % 50 = 0"), 100, 100).unionByName(one("small", small, small.where("id < 3"), 2, 1))


@query(fx.with_(fx.FILES) + "SELECT file_id, CASE WHEN file_id % 4 = 0 THEN 'INSERTED' WHEN file_id % 7 = 0 THEN 'CONFLICT' ELSE 'REUSED' END AS outcome FROM files")
def insert_or_reuse(spark, sf_dir):
    f = fx.files(spark, sf_dir, "file_id", "checksum", "size_bytes")
    return queues.insert_or_reuse(f.where("file_id % 4 <> 0").withColumn("size_bytes", F.expr("CASE WHEN file_id % 7 = 0 THEN size_bytes + 1 ELSE size_bytes END")), f, "file_id", ("checksum", "size_bytes"))


@query("""SELECT c_custkey AS id, CASE WHEN c_custkey % 7 = 0 THEN 'UNVERIFIED' WHEN c_custkey % 6 = 0 THEN 'UNKNOWN_USER' WHEN c_custkey % 5 = 0 THEN 'INACTIVE_USER' WHEN c_custkey % 11 = 0 THEN 'UID_LINKED_ELSEWHERE' WHEN c_custkey % 3 = 0 THEN 'LINKED' WHEN c_custkey % 3 = 1 THEN 'UNCHANGED' ELSE 'USER_LINKED_ELSEWHERE' END AS outcome FROM customer""")
def identity_links(spark, sf_dir):
    c = fx.table(spark, sf_dir, "customer").selectExpr("c_custkey AS id", "CAST(c_custkey AS STRING) AS uid", "concat('c', c_custkey) AS email", "c_custkey % 7 <> 0 AS email_verified", "CASE WHEN c_custkey % 6 <> 0 THEN c_custkey END AS user_id", "c_custkey % 5 <> 0 AS active", "CASE WHEN c_custkey % 11 = 0 THEN 'other' WHEN c_custkey % 2 = 0 THEN concat('c', c_custkey) END AS uid_email", "CASE c_custkey % 3 WHEN 1 THEN CAST(c_custkey AS STRING) WHEN 2 THEN 'x' END AS link_uid")
    return c.select("id", queues.link_identity().alias("outcome"))


@query(fx.with_(fx.FILES) + "SELECT CAST(count(*) AS BIGINT) AS rows, CAST(count(*) FILTER (WHERE folder_id IS DISTINCT FROM 3) AS BIGINT) AS foreign_rows, false AS accepted FROM files")
def single_folder(spark, sf_dir):
    return queues.single_folder(fx.files(spark, sf_dir, "folder_id"), 3)


@query("SELECT doc_id, CAST(ceil(n_chars / 256.0) AS BIGINT) AS chunks, CAST(least(doc_id % 2 * 512, n_chars) AS BIGINT) AS next_start, CAST(least(least(doc_id % 2 * 512, n_chars) + 256, n_chars) - 1 AS BIGINT) AS next_end, doc_id % 2 * 512 >= n_chars AS complete FROM documents")
def upload_chunks(spark, sf_dir):
    d = fx.table(spark, sf_dir, "documents").selectExpr("doc_id", "n_chars AS size", "doc_id % 2 * 512 AS sent")
    return d.select("doc_id", *[c.alias(n) for n, c in queues.upload_chunks("size", "sent", 256).items()])


# records


_ITEMS = "items AS (SELECT concat('g', doc_id) AS file_id, lang AS name, CAST(n_chars AS BIGINT) AS size, CASE doc_id % 4 WHEN 0 THEN 'folder' WHEN 1 THEN 'supported_media' WHEN 2 THEN 'unsupported' ELSE 'inaccessible' END AS classification FROM documents)"


def _items(spark, sf_dir):
    return fx.table(spark, sf_dir, "documents").selectExpr("concat('g', doc_id) AS file_id", "lang AS name", "CAST(n_chars AS BIGINT) AS size", "CASE doc_id % 4 WHEN 0 THEN 'folder' WHEN 1 THEN 'supported_media' WHEN 2 THEN 'unsupported' ELSE 'inaccessible' END AS classification", "'accessible' AS accessibility_status", "'x' AS mime_type", "'y' AS file_extension", "'t' AS modified_time", "'p' AS relative_folder_path")


@query(fx.with_(_ITEMS) + """SELECT file_id, name AS file_name, size AS size_bytes, CASE classification WHEN 'supported_media' THEN 'TAKE' WHEN 'unsupported' THEN 'SKIP' ELSE 'PENDING' END AS decision, CASE classification WHEN 'supported_media' THEN 'READY' WHEN 'unsupported' THEN 'SKIPPED' ELSE 'INACCESSIBLE' END AS processing_status,
 CASE classification WHEN 'unsupported' THEN 'Unsupported by inventory classification' END AS skip_reason, concat('{"classification":"', classification, '","accessibility_status":"accessible","import_type":"INVENTORY","report_sha256":"r"}') AS metadata FROM items WHERE classification <> 'folder'""")
def source_file_rows(spark, sf_dir):
    """Rows of source files from inventory items."""
    return records.source_file_rows(_items(spark, sf_dir), "folder", "run", "r", _now()).select("file_id", "file_name", "size_bytes", "decision", "processing_status", "skip_reason", "metadata")


@query(fx.with_(_ITEMS) + f"""SELECT 'folder' AS source_folder_id, 'DRY_RUN' AS run_mode, 'RUNNING' AS status, {NOW} AS started_at, CAST(count(*) FILTER (WHERE classification <> 'folder') AS BIGINT) AS files_discovered, CAST(count(*) FILTER (WHERE classification = 'supported_media') AS BIGINT) AS files_taken, CAST(count(*) FILTER (WHERE classification = 'unsupported') AS BIGINT) AS files_skipped,
 CAST(count(*) FILTER (WHERE classification = 'inaccessible') AS BIGINT) AS inaccessible_items, CAST(count(*) FILTER (WHERE classification = 'folder') + 1 AS BIGINT) AS folders_scanned, CAST(0 AS BIGINT) AS files_uploaded, CAST(0 AS BIGINT) AS duplicates_found, CAST(2 AS BIGINT) AS files_failed FROM items""")
def scan_run_row(spark, sf_dir):
    return records.scan_run_row(_items(spark, sf_dir), "folder", 2, _now())


@query(fx.with_(fx.FILES) + """, c AS (SELECT content_hash AS asset_id, folder_id, file_id, CASE WHEN file_id % 2 = 0 THEN file_id ELSE -1 END AS preferred_id FROM files WHERE NOT trashed) SELECT asset_id, arg_min(file_id, struct_pack(o := preferred_id <> file_id, f := folder_id, i := file_id)) AS file_id, NOT min(preferred_id <> file_id) AS preferred FROM c GROUP BY 1""")
def canonical_sources(spark, sf_dir):
    """The source that stands for each asset: the preferred one, else the least."""
    f = fx.files(spark, sf_dir, "content_hash", "folder_id", "file_id", "trashed").where("not trashed")
    return records.canonical_source(f.selectExpr("content_hash AS asset_id", "folder_id", "file_id", "CASE WHEN file_id % 2 = 0 THEN file_id ELSE -1 END AS preferred_id"))


@query(fx.with_(fx.FILES) + """, g AS (SELECT content_hash, arg_min(file_id, struct_pack(f := folder_id, i := file_id)) AS canonical_file_id FROM files GROUP BY 1)
SELECT g.content_hash, f.file_name, f.mime_type, f.file_extension, f.size_bytes, 'PENDING' AS upload_status, concat('{"hash_algorithm":"SHA-256","canonical_file_id":', canonical_file_id, ',"media_category":"', CASE WHEN mime_type LIKE 'image/%' THEN 'image' WHEN mime_type LIKE 'video/%' THEN 'video' WHEN mime_type = 'application/pdf' OR mime_type LIKE '%presentation%' THEN 'document'
 WHEN file_extension IN ('jpg', 'jpeg', 'png', 'webp') THEN 'image' WHEN file_extension IN ('mp4', 'mov') THEN 'video' WHEN file_extension IN ('pdf', 'pptx') THEN 'document' ELSE 'other' END, '"}') AS metadata FROM g JOIN files f ON f.file_id = g.canonical_file_id""")
def asset_rows(spark, sf_dir):
    """Rows of new assets from groups of equal contents."""
    f = fx.files(spark, sf_dir, "content_hash", "folder_id", "file_id", "file_name", "mime_type", "file_extension", "size_bytes")
    g = records.canonical_source(f.selectExpr("content_hash AS asset_id", "folder_id", "file_id", "CAST(NULL AS BIGINT) AS preferred_id")).selectExpr("asset_id AS content_hash", "file_id AS canonical_file_id")
    return records.asset_rows(g, f).select("content_hash", "file_name", "mime_type", "file_extension", "size_bytes", "upload_status", "metadata")


@query(fx.with_(fx.FILES) + """SELECT DISTINCT content_hash, 'd' AS destination_folder_id, CASE file_extension WHEN 'png' THEN 'Images' WHEN 'pdf' THEN 'Documents' END AS category_folder, 'NOT_STARTED' AS upload_status FROM files WHERE (file_extension = 'png' AND mime_type = 'image/png') OR (file_extension = 'pdf' AND mime_type = 'application/pdf')""")
def lifecycle_rows(spark, sf_dir):
    """First destination rows of approved assets (here png and pdf); others are dropped."""
    f = fx.files(spark, sf_dir, "content_hash", "file_extension", "mime_type").where("file_extension in ('png', 'pdf', 'heic')")
    return records.lifecycle_rows(f.distinct(), "d", "v1").select("content_hash", "destination_folder_id", "category_folder", "upload_status")


@query(fx.with_(fx.INDEX) + """SELECT asset_id AS job_id, asset_id, concat('{"content_sha256":"h', asset_id, '"', CASE WHEN indexing_status = 'INDEXED' THEN ',"evidence":"prepared local media and trusted metadata"' ELSE '' END, '}') AS provenance, CASE WHEN indexing_status = 'INDEXED' THEN content_type END AS content_type, CASE WHEN indexing_status = 'INDEXED' THEN 'STAGED' ELSE 'FAILED' END AS result_state FROM idx""")
def staging_rows(spark, sf_dir):
    """Staging records of jobs with and without a result."""
    i = fx.index(spark, sf_dir).select("asset_id", "content_type", "indexing_status")
    jobs = i.select(F.col("asset_id").alias("job_id"), "asset_id", F.lit("f").alias("file_name"), F.lit("image").alias("media_type"), F.concat(F.lit("h"), "asset_id").alias("content_hash"))
    return records.staging_rows(jobs, i.where("indexing_status = 'INDEXED'").select("asset_id", "content_type")).select("job_id", "asset_id", "provenance", "content_type", "result_state")


COMPARED = ["file_name", "mime_type", "file_extension", "size_bytes", "relative_path", "accessibility_status", "trashed", "is_missing", "is_folder", "folder_id"]


@query(fx.with_(fx.FILES) + "SELECT file_id, CASE WHEN file_id % 10 = 0 THEN 'INSERT' WHEN file_id % 6 = 0 OR file_id % 4 = 0 THEN 'UPDATE' ELSE 'UNCHANGED' END AS action, CASE WHEN file_id % 10 = 0 THEN '' ELSE array_to_string(list_filter([CASE WHEN file_id % 6 = 0 THEN 'mime_type' END, CASE WHEN file_id % 4 = 0 THEN 'size_bytes' END], lambda x: x IS NOT NULL), ',') END AS changed FROM files")
def changed_fields(spark, sf_dir):
    """The plan of an import with the names of the fields that differ."""
    f = fx.files(spark, sf_dir, "file_id", *COMPARED)
    old = f.where("file_id % 10 <> 0").withColumns({"mime_type": F.expr("CASE WHEN file_id % 6 = 0 THEN NULL ELSE mime_type END"), "size_bytes": F.expr("CASE WHEN file_id % 4 = 0 THEN size_bytes + 1 ELSE size_bytes END")})
    return records.changed_fields(old, f, "file_id", COMPARED)


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'NEW' ELSE o_orderstatus END AS status FROM orders")
def update_from(spark, sf_dir):
    o = fx.table(spark, sf_dir, "orders").selectExpr("o_orderkey AS id", "o_orderstatus AS status")
    return records.update_from(o, o.where("id % 3 = 0").select("id", F.lit("NEW").alias("status")), "id", "status")


@query("SELECT 'left' AS kind, CAST(count(*) AS BIGINT) AS n, CAST(count(o_orderkey) AS BIGINT) AS found FROM customer LEFT JOIN orders ON c_custkey = o_custkey UNION ALL SELECT 'inner', count(*), count(o_orderkey) FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_orderstatus = 'F'")
def embedded_join(spark, sf_dir):
    """Customers with their orders: left without a filter on orders, inner with one."""
    c, o = fx.table(spark, sf_dir, "customer").selectExpr("c_custkey AS k"), fx.table(spark, sf_dir, "orders").selectExpr("o_custkey AS k", "o_orderkey", "o_orderstatus")
    n = lambda kind, df: df.agg(F.count("*").alias("n"), F.count("o_orderkey").alias("found")).select(F.lit(kind).alias("kind"), "n", "found")
    return n("left", records.linked(c, o, "k")).unionByName(n("inner", records.linked(c, o, "k", F.col("o_orderstatus") == "F")))


@query(fx.with_(fx.FILES) + """, f AS (SELECT file_id AS id, size_bytes, CASE WHEN file_id % 5 <> 0 THEN file_id % 97 END AS updated_at FROM files), t AS (SELECT CAST(count(*) AS BIGINT) AS total, CAST(greatest(1, ceil(count(*) / 20.0)) AS BIGINT) AS total_pages FROM f)
SELECT s.*, total, total_pages, CAST(2 AS BIGINT) AS page FROM ((SELECT 'newest' AS sort, id FROM f ORDER BY updated_at DESC NULLS LAST, id LIMIT 20 OFFSET 20) UNION ALL (SELECT 'oldest', id FROM f ORDER BY updated_at ASC NULLS LAST, id LIMIT 20 OFFSET 20)
 UNION ALL (SELECT 'smallest', id FROM f ORDER BY size_bytes ASC NULLS LAST, id LIMIT 20 OFFSET 20) UNION ALL (SELECT 'largest', id FROM f ORDER BY size_bytes DESC NULLS LAST, id LIMIT 20 OFFSET 20)) s, t""")
def page_envelopes(spark, sf_dir):
    """The second page in each of the four orders, with its envelope (the limit is the page's)."""
    f = fx.files(spark, sf_dir, "file_id", "size_bytes").selectExpr("file_id AS id", "size_bytes", "CASE WHEN file_id % 5 <> 0 THEN file_id % 97 END AS updated_at")
    one = lambda s: records.page(f, s, 2, 20).select(F.lit(s).alias("sort"), "id", "total", "total_pages", "page")
    return one("newest").unionByName(one("oldest")).unionByName(one("smallest")).unionByName(one("largest"))


@query("SELECT n_regionkey AS region, CAST(count(*) AS BIGINT) AS n, concat('[', string_agg(concat('{\"name\":\"', n_name, '\",\"id\":', n_nationkey, '}'), ',' ORDER BY n_name), ']') AS doc FROM nation GROUP BY 1")
def ordered_json(spark, sf_dir):
    """Rows of each key as an ordered JSON array."""
    n = fx.table(spark, sf_dir, "nation").selectExpr("n_regionkey AS region", "n_name AS name", "n_nationkey AS id")
    return records.ordered_json(n, "region", ("name", "id"), "name")


@query(fx.with_(fx.FILES) + ", g AS (SELECT count(*) AS n FROM files GROUP BY checksum, size_bytes HAVING count(*) > 1) SELECT CAST(count(*) AS BIGINT) AS groups, CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS surplus FROM g")
def duplicate_surplus(spark, sf_dir):
    return records.surplus(fx.files(spark, sf_dir, "checksum", "size_bytes"), "checksum", "size_bytes")


@query(fx.with_(fx.FILES, _REASON) + "SELECT decision, reason_code, file_extension, mime_type, accessibility_status, trashed, is_missing, size_bytes = 0 AS empty, CAST(count(*) AS BIGINT) AS n FROM decisions WHERE NOT is_folder GROUP BY ALL")
def rule_preview(spark, sf_dir):
    """Files by the eight things a change of rules is judged by."""
    keys = ("decision", "reason_code", "file_extension", "mime_type", "accessibility_status", "trashed", "is_missing")
    return _decided(spark, sf_dir).where("not is_folder").groupBy(*keys, (F.col("size_bytes") == 0).alias("empty")).agg(F.count("*").alias("n"))


@query(fx.with_(fx.FILES, _REASON) + """SELECT file_extension, p AS previous, decision, reason_code, CAST(count(*) AS BIGINT) AS n FROM (SELECT *, CASE file_id % 3 WHEN 0 THEN 'TAKE' WHEN 1 THEN 'SKIP' ELSE 'PENDING' END AS p FROM decisions WHERE NOT is_folder) WHERE p <> decision GROUP BY ALL""")
def decision_differences(spark, sf_dir):
    """Where the rules decide otherwise than the earlier classification."""
    p = F.expr("CASE file_id % 3 WHEN 0 THEN 'supported_media' WHEN 1 THEN 'unsupported' ELSE 'inaccessible' END")
    previous = checks.remapped(p, {"supported_media": "TAKE", "unsupported": "SKIP", "inaccessible": "PENDING"})
    return _decided(spark, sf_dir).where("not is_folder").withColumn("previous", previous).where("previous <> decision").groupBy("file_extension", "previous", "decision", "reason_code").agg(F.count("*").alias("n"))


@query(fx.with_(fx.FILES) + """SELECT folder_id, CAST(count(*) FILTER (WHERE file_extension IN ('mp4', 'mov')) AS BIGINT) AS videos, CAST(count(*) FILTER (WHERE file_extension IN ('pdf', 'pptx')) AS BIGINT) AS documents, CAST(count(DISTINCT CASE WHEN file_id % 2 = 0 THEN content_hash END) AS BIGINT) AS verified_assets FROM files WHERE mime_type = 'application/octet-stream' GROUP BY 1""")
def folder_categories(spark, sf_dir):
    """Per folder: files of a category and distinct verified assets (of files whose MIME type says nothing)."""
    f = fx.files(spark, sf_dir, "folder_id", "file_id", "file_extension", "mime_type", "content_hash").where("mime_type = 'application/octet-stream'")
    kind = rules.media_category("mime_type", "file_extension")
    return f.groupBy("folder_id").agg(F.count_if(kind == "video").alias("videos"), F.count_if(kind == "document").alias("documents"), F.count_distinct(F.when(F.col("file_id") % 2 == 0, F.col("content_hash"))).alias("verified_assets"))


@query(fx.with_(fx.FILES) + "SELECT folder_id, CAST(count(DISTINCT file_extension) AS BIGINT) AS categories, CAST(count(DISTINCT file_id) AS BIGINT) AS files FROM files GROUP BY 1")
def categories_per_source(spark, sf_dir):
    return fx.files(spark, sf_dir, "folder_id", "file_id", "file_extension").groupBy("folder_id").agg(F.count_distinct("file_extension").alias("categories"), F.count_distinct("file_id").alias("files"))


@query("SELECT vec_id AS asset_id, vec_id % 3 <> 0 AS has_embedding, vec_id % 3 <> 0 AS has_metadata, CASE WHEN vec_id % 3 <> 0 THEN 'INDEXED' ELSE 'FAILED_RETRYABLE' END AS status FROM embeddings")
def atomic_completion(spark, sf_dir):
    """Embedding, metadata and status together, or none of them."""
    e = fx.table(spark, sf_dir, "embeddings").selectExpr("vec_id AS asset_id", "to_json(embedding) AS v", "CASE WHEN vec_id % 3 = 0 THEN '[]' ELSE '{}' END AS m")
    v = checks.json_vector("v", 64)
    out = records.together(e, v.isNotNull() & checks.is_json_object("m"), v, F.col("m"))
    return out.select("asset_id", F.col("embedding").isNotNull().alias("has_embedding"), F.col("metadata").isNotNull().alias("has_metadata"), "status")


@query("SELECT event_id, event_id % 4 < 2 AND event_id % 3 <> 0 AS hit FROM events")
def vector_cache(spark, sf_dir):
    """Requests whose vector is stored for the same model and young enough."""
    e = fx.table(spark, sf_dir, "events")
    requests = e.selectExpr("event_id", "concat('t', event_id) AS text", "CASE WHEN event_id % 4 < 2 THEN 'm' ELSE 'n' END AS model")
    cache = e.select(F.expr("concat('t', event_id)").alias("text"), F.lit("m").alias("model"), F.expr(f"CASE WHEN event_id % 3 = 0 THEN {NOW} - INTERVAL 15 MINUTES ELSE {NOW} - INTERVAL 14 MINUTES END").alias("created_at"))
    return records.cached(requests, cache, _now()).select("event_id", "hit")


def _length_model():
    """A stand-in for a model: characters and words of a text."""
    return lambda s: s.map(lambda t: [float(len(t or "")), float(len((t or "").split(" ")))])


@query("SELECT doc_id, CAST(length(text) AS BIGINT) AS chars, CAST(len(string_split(text, ' ')) AS BIGINT) AS words FROM documents")
def model_slot(spark, sf_dir):
    """A column made by a model that is plugged in (here one that counts)."""
    d = records.with_model(fx.table(spark, sf_dir, "documents").select("doc_id", "text"), _length_model, "text", "v", "array<double>")
    return d.select("doc_id", F.get("v", F.lit(0)).cast("long").alias("chars"), F.get("v", F.lit(1)).cast("long").alias("words"))


@query("SELECT doc_id, sha256(concat(sha256(concat(md5(lang), '||p|m|1')), '|', sha256(lang), '|r|t', doc_id)) AS fingerprint FROM documents")
def review_fingerprints(spark, sf_dir):
    """Fingerprint of a manual review: of the content and model, of the searchable text, and of who reviewed it when."""
    return fx.table(spark, sf_dir, "documents").select("doc_id", hashing.review_fingerprint(hashing.fingerprint(F.md5("lang"), F.lit(None).cast("string"), "p", "m", "1"), F.col("lang"), F.lit("r"), F.concat(F.lit("t"), "doc_id")).alias("fingerprint"))


# small columns


@query("SELECT doc_id, concat('a/', lang, '/f', doc_id) AS path, CAST(3 AS INT) AS depth, concat(substr(lang, 1, 1), '***@', source, '.x') AS email, concat(lang, '_', source, '_1') AS cache_key FROM documents")
def paths_and_keys(spark, sf_dir):
    p = text.joined_path(F.lit("/a/"), F.col("lang"), F.concat(F.lit("f"), "doc_id"))
    return fx.table(spark, sf_dir, "documents").select("doc_id", p.alias("path"), text.path_depth(p).alias("depth"), text.masked_email(F.concat("lang", F.lit("@"), "source", F.lit(".x"))).alias("email"), text.cache_key(F.concat("lang", F.lit("/"), "source", F.lit("?1"))).alias("cache_key"))


@query("SELECT doc_id, concat(lang, '_', source) AS header, CASE WHEN doc_id % 2 = 0 THEN concat('said ', lang) END AS transcript FROM documents")
def headers_and_transcripts(spark, sf_dir):
    d = fx.table(spark, sf_dir, "documents").select("doc_id", F.concat("lang", F.lit('"'), "source").alias("h"), F.expr("CASE WHEN doc_id % 2 = 0 THEN concat('  said \n ', lang, ' ') ELSE ' ' END").alias("t"))
    return d.select("doc_id", shape.header_name("h").alias("header"), shape.transcript("t").alias("transcript"))


@query("SELECT event_id, strftime(ts + INTERVAL 8 HOUR, '%Y-%m-%dT%H:%M:%S') || '+08:00' AS local, CAST(round(event_id * 0.15) AS BIGINT) AS first_at, CAST(round(event_id * 0.85) AS BIGINT) AS last_at FROM events WHERE event_id % 10 <> 5 UNION ALL SELECT event_id, strftime(ts + INTERVAL 8 HOUR, '%Y-%m-%dT%H:%M:%S') || '+08:00', CAST((event_id * 15 + 50) // 100 AS BIGINT), CAST((event_id * 85 + 50) // 100 AS BIGINT) FROM events WHERE event_id % 10 = 5")
def local_times(spark, sf_dir):
    """Times of a zone with its offset, and positions at fixed fractions."""
    e = fx.table(spark, sf_dir, "events")
    at = lambda p: F.floor((F.col("event_id") * p + 50) / 100).cast("long")
    return e.select("event_id", text.with_offset("ts", "Asia/Singapore", "+08:00").alias("local"), at(15).alias("first_at"), at(85).alias("last_at"))


@query("SELECT id, CASE id % 8 WHEN 0 THEN 'NOT_FOUND' WHEN 1 THEN 'TRASHED' WHEN 2 THEN 'WRONG_PARENT' WHEN 3 THEN 'WRONG_NAME' WHEN 4 THEN 'WRONG_SIZE' WHEN 5 THEN 'WRONG_MIME' WHEN 6 THEN 'WRONG_CHECKSUM' END AS reason, CASE WHEN id % 2 = 0 THEN 'editor' WHEN id % 3 = 0 THEN 'viewer' ELSE 'unknown' END AS role FROM (SELECT o_orderkey AS id FROM orders)")
def destination_checks(spark, sf_dir):
    """Why an uploaded file doesn't count as verified, and a role from capabilities."""
    o = fx.table(spark, sf_dir, "orders").selectExpr("o_orderkey AS id", "o_orderkey % 8 AS k").selectExpr(
        "id", "CASE WHEN k <> 0 THEN 'f' END AS found_id", "k = 1 AS found_trashed", "CASE WHEN k = 2 THEN 'x' ELSE 'd' END AS found_parent", "CASE WHEN k = 3 THEN 'x' ELSE 'n' END AS found_name", "'n' AS planned_name", "CASE WHEN k = 4 THEN 2 ELSE 1 END AS found_size", "1 AS expected_size",
        "CASE WHEN k = 5 THEN 'x' ELSE 'A/B' END AS found_mime", "'a/b' AS expected_mime", "CASE WHEN k = 6 THEN 'x' END AS found_md5", "'m' AS expected_md5", "id % 2 = 0 AS can_edit", "id % 3 = 0 AS can_view",
    )
    return o.select("id", shape.destination_verification("d").alias("reason"), shape.permission_role(("can_edit", "editor"), ("can_view", "viewer")).alias("role"))


@query(fx.with_(fx.FILES) + "SELECT folder_id, file_id, CAST(row_number() OVER (PARTITION BY folder_id ORDER BY size_bytes, file_id) AS INT) AS n FROM files")
def numbered_files(spark, sf_dir):
    """Rows numbered within their folder."""
    return shape.numbered(fx.files(spark, sf_dir, "folder_id", "file_id", "size_bytes"), "folder_id", "size_bytes", "file_id").select("folder_id", "file_id", "n")


@query(fx.with_(fx.DESTINATIONS) + """, d AS (SELECT asset_id, min(CASE WHEN upload_status = 'VERIFIED' AND destination_file_id IS NOT NULL THEN id END) AS first, count(*) AS n FROM destinations GROUP BY 1)
SELECT c_custkey AS asset_id, CASE WHEN c_custkey % 4 <> 0 THEN 'g' || first END AS file_id, CASE WHEN c_custkey % 4 <> 0 AND first IS NOT NULL THEN concat('n', c_custkey, '.jpg') END AS file_name, CASE WHEN c_custkey % 4 = 0 THEN 'inactive_asset' WHEN first IS NOT NULL THEN 'destination' WHEN n > 0 THEN 'no_verified_destination_or_fallback' ELSE 'no_destination' END AS reason,
 CASE WHEN c_custkey % 4 <> 0 AND first IS NOT NULL THEN left(md5(concat('g', first)), 16) END AS version_tag FROM customer LEFT JOIN d ON c_custkey = d.asset_id""")
def location_details(spark, sf_dir):
    """Where an asset's file is, with its name and a tag of its version."""
    c = fx.table(spark, sf_dir, "customer").selectExpr("c_custkey AS asset_id", "c_custkey % 4 <> 0 AS active", "concat('n', c_custkey, '.jpg') AS file_name")
    at = lifecycle.resolve_location(c, fx.destinations(spark, sf_dir)).join(c.select("asset_id", "file_name"), "asset_id")
    found = F.col("file_id").isNotNull()
    return at.select("asset_id", "file_id", F.when(found, F.col("file_name")).alias("file_name"), "reason", F.when(found, F.left(F.md5("file_id"), F.lit(16))).alias("version_tag"))


@query("""SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 'AWAITING_RETRY' WHEN doc_id % 5 = 0 THEN 'SKIPPED' WHEN doc_id > f THEN 'LINKED_DUPLICATE' ELSE 'PLANNED' END AS outcome FROM (SELECT doc_id, min(CASE WHEN doc_id % 9 <> 0 AND doc_id % 5 <> 0 THEN doc_id END) OVER (PARTITION BY text) AS f FROM documents)""")
def adapter_outcomes(spark, sf_dir):
    """Each new or changed file through decision, hash, canonical link and outcome, as one plan."""
    d = fx.table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("h"), F.expr("doc_id % 9 = 0").alias("failed"), F.expr("doc_id % 5 = 0").alias("skip"))
    first = d.where("not failed and not skip").groupBy("h").agg(F.min("doc_id").alias("f"))
    return d.join(first, "h", "left").select("doc_id", F.when(F.col("failed"), "AWAITING_RETRY").when(F.col("skip"), "SKIPPED").when(F.col("doc_id") > F.col("f"), "LINKED_DUPLICATE").otherwise("PLANNED").alias("outcome"))
