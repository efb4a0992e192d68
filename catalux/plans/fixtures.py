"""Catalogue tables derived from the driver's tables, as frames and as the same SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

EXTENSIONS = ("jpg", "jpeg", "png", "webp", "mp4", "mov", "pdf", "pptx", "heic")
MIMES = ("image/jpeg", "image/jpeg", "image/png", "image/webp", "video/mp4", "video/quicktime", "application/pdf", "application/vnd.openxmlformats-officedocument.presentationml.presentation", "image/heic")
CONTENT_TYPES = ("Consultation", "Patient Testimonial", "Educational", "Other")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: tuple[str, ...], i: str) -> str:
    return f"CASE {i} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in enumerate(values)) + " END"


#: Columns of a file, in SQL that both engines read.
_FILE = {
    "file_id": "doc_id",
    "folder_id": "doc_id % 25",
    "file_extension": _pick(EXTENSIONS, "(doc_id % 9)"),
    "file_name": f"concat(CASE WHEN doc_id % 31 = 0 THEN '~$' WHEN doc_id % 37 = 0 THEN '._' ELSE 'f' END, CAST(doc_id AS {{s}}), '.', {_pick(EXTENSIONS, '(doc_id % 9)')})",
    "mime_type": f"CASE WHEN doc_id % 11 = 0 THEN 'application/octet-stream' WHEN doc_id % 41 = 0 THEN 'application/vnd.google-apps.shortcut' ELSE {_pick(MIMES, '(doc_id % 9)')} END",
    "size_bytes": "CASE WHEN doc_id % 13 = 0 THEN 0 ELSE n_chars END",
    "relative_path": "concat('Top\\\\', source, '//', CASE WHEN doc_id % 7 = 0 THEN 'Archive' ELSE lang END)",
    "accessibility_status": "CASE WHEN doc_id % 29 = 0 THEN 'inaccessible' ELSE 'accessible' END",
    "trashed": "(doc_id % 17 = 0)",
    "is_missing": "(doc_id % 19 = 0)",
    "is_folder": "(doc_id % 23 = 0)",
    "content_hash": "sha256(text)",
    "checksum": "md5(text)",
}


def files(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The files of the catalogue; only the named columns, so that texts are read only for digests."""
    sql = {c: x.replace("{s}", "STRING").replace("sha256(text)", "sha2(text, 256)") for c, x in _FILE.items()}
    return table(spark, sf_dir, "documents").selectExpr(*[f"{sql[c]} AS {c}" for c in columns or sql])


FILES = "files AS (SELECT " + ", ".join(f"{x.replace('{s}', 'VARCHAR').replace(chr(92) * 2, chr(92))} AS {c}" for c, x in _FILE.items()) + " FROM documents)"


def folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").selectExpr("CAST(n_nationkey AS BIGINT) AS folder_id", "n_name AS name", "n_regionkey <> 4 AS active")


FOLDERS = "folders AS (SELECT CAST(n_nationkey AS BIGINT) AS folder_id, n_name AS name, n_regionkey <> 4 AS active FROM nation)"

_DESTINATION = {
    "id": "o_orderkey",
    "asset_id": "o_custkey",
    "destination_folder_id": "concat('d', CAST(o_orderkey % 3 AS {s}))",
    "upload_status": "CASE o_orderstatus WHEN 'F' THEN 'VERIFIED' WHEN 'O' THEN CASE o_orderkey % 5 WHEN 0 THEN 'QUEUED' WHEN 1 THEN 'FAILED_RETRYABLE' WHEN 2 THEN 'CLAIMED' ELSE 'NOT_STARTED' END ELSE 'FAILED_PERMANENT' END",
    "destination_file_id": "CASE WHEN o_orderstatus = 'F' AND o_orderkey % 7 <> 0 THEN concat('g', CAST(o_orderkey AS {s})) END",
    "attempts": "CAST(o_orderkey % 6 AS INT)",
    "claim_owner": "CASE WHEN o_orderkey % 5 = 2 AND o_orderstatus = 'O' THEN 'w' END",
    "claim_expires_at": "CASE WHEN o_orderkey % 5 = 2 AND o_orderstatus = 'O' THEN CAST(o_orderdate AS TIMESTAMP) END",
    "next_retry_at": "CASE WHEN o_orderkey % 5 = 1 AND o_orderstatus = 'O' THEN CAST(o_orderdate AS TIMESTAMP) END",
    "last_attempt_at": "CAST(NULL AS TIMESTAMP)",
    "created_at": "CAST(o_orderdate AS TIMESTAMP)",
}


def destinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(*[f"{x.replace('{s}', 'STRING')} AS {c}" for c, x in _DESTINATION.items()])


DESTINATIONS = "destinations AS (SELECT " + ", ".join(f"{x.replace('{s}', 'VARCHAR')} AS {c}" for c, x in _DESTINATION.items()) + " FROM orders)"

_INDEX = {
    "asset_id": "doc_id",
    "content_type": _pick(CONTENT_TYPES, "(doc_id % 4)"),
    "treatment": "CASE doc_id % 3 WHEN 0 THEN 'Long Hair Transplant' WHEN 1 THEN 'Scalp therapy' END",
    "subject": "CASE doc_id % 5 WHEN 0 THEN 'Female patient' WHEN 1 THEN 'Male patient' END",
    "doctor_name": "CASE doc_id % 7 WHEN 0 THEN 'Dr Hair' WHEN 1 THEN 'Dr Other' END",
    "indexing_status": "CASE WHEN doc_id % 10 = 3 THEN 'PENDING' ELSE 'INDEXED' END",
    "searchable_text": "text",
}


def index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr(*[f"{x} AS {c}" for c, x in _INDEX.items()])


INDEX = "idx AS (SELECT " + ", ".join(f"{x} AS {c}" for c, x in _INDEX.items()) + " FROM documents)"


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").selectExpr("CAST(vec_id AS BIGINT) AS asset_id", "CAST(label AS STRING) AS model", "embedding")


EMBEDDINGS = "emb AS (SELECT CAST(vec_id AS BIGINT) AS asset_id, CAST(label AS VARCHAR) AS model, embedding FROM embeddings)"

#: A fixed query vector of 64 numbers.
VECTOR = [round(((i * 37) % 19 - 9) / 10, 1) for i in range(64)]


def with_(*parts: str) -> str:
    return "WITH " + ", ".join(parts) + " "
