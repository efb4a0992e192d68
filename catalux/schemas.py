"""Row schemas and allowed-value sets of the media catalogue."""

from __future__ import annotations

from pyspark.sql import types as T

INVENTORY_ITEM = T.StructType([T.StructField(n, T.LongType() if n == "size" else T.StringType()) for n in (
    "file_id", "name", "mime_type", "file_extension", "size", "created_time", "modified_time", "parent_folder_id", "relative_folder_path", "web_view_link", "accessibility_status", "classification", "md5_checksum",
)])
INVENTORY_ERROR = T.StructType([T.StructField("item_id", T.StringType()), T.StructField("failure_category", T.StringType()), T.StructField("http_status", T.IntegerType()), T.StructField("message", T.StringType())])
SUMMARY_FIELDS = ("total_items", "folders_scanned", "folders", "files", "supported_media", "unsupported_files", "inaccessible_items", "errors")
INVENTORY_REPORT = T.StructType([
    T.StructField("generated_at_utc", T.StringType()),
    T.StructField("root", T.StructType([T.StructField(n, T.StringType()) for n in ("file_id", "name", "mime_type")])),
    T.StructField("summary", T.StructType([T.StructField(n, T.LongType()) for n in SUMMARY_FIELDS])),
    T.StructField("items", T.ArrayType(INVENTORY_ITEM)),
    T.StructField("errors", T.ArrayType(INVENTORY_ERROR)),
])
ONBOARDING_ROW = T.StructType([T.StructField(n, T.StringType()) for n in ("source_name", "account_name", "folder_url", "notes", "active", "expected_folder_id", "clinical_content", "processing_enabled")])

#: Fixed values of the catalogue's status columns and of the rules.
OUTCOMES = ("UNCHANGED", "SKIPPED", "LINKED_DUPLICATE", "UPLOADED_VERIFIED", "FAILED", "AWAITING_RETRY", "INACCESSIBLE", "REMOVED_FROM_SOURCE", "PLANNED")
UNRESOLVED = ("FAILED", "AWAITING_RETRY", "INACCESSIBLE")
TRUSTED_STATES = ("HASHED", "DUPLICATE", "UPLOADED", "VERIFIED")
FAILURES = ("SOURCE_CHANGED", "SOURCE_NOT_FOUND", "SOURCE_ACCESS_DENIED", "DESTINATION_ACCESS_DENIED", "DESTINATION_CONFLICT", "UPLOAD_FAILED", "MANUAL_REVIEW_REQUIRED")
PPTX = "application/vnd.openxmlformats-officedocument.presentationml.presentation"
#: extension, MIME type, category, content analysis allowed
FORMATS = (
    ("jpg", "image/jpeg", "image", True),
    ("jpeg", "image/jpeg", "image", True),
    ("png", "image/png", "image", True),
    ("webp", "image/webp", "image", True),
    ("mp4", "video/mp4", "video", True),
    ("mov", "video/quicktime", "video", True),
    ("pdf", "application/pdf", "document", False),
    ("pptx", PPTX, "document", False),
)
