"""TAKE/SKIP rules: one ordered chain of conditions, with a small policy table as literals."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..schemas import FORMATS, PPTX

FOLDER = "application/vnd.google-apps.folder"
SHORTCUT = "application/vnd.google-apps.shortcut"
NATIVE_PREFIX = "application/vnd.google-apps."


@dataclass(frozen=True)
class Rules:
    formats: tuple[tuple[str, str, str, bool], ...] = FORMATS
    excluded_names: tuple[str, ...] = ()
    excluded_paths: tuple[str, ...] = ()
    reject_dotfiles: bool = False


def _lookup(key: Column, rules: Rules, at: int) -> Column:
    return F.create_map(*[F.lit(x) for f in rules.formats for x in (f[0], f[at])])[key]


def reason_code(rules: Rules = Rules()) -> Column:
    """Reason of the first rule that applies.

    Columns: file_name, mime_type, file_extension, relative_path, accessibility_status (strings), size_bytes (long),
    trashed, is_missing, is_folder (boolean), and raw_type_ok (boolean), which tells wrong types in the raw record from nulls.
    """
    name, low = F.coalesce("file_name", F.lit("")), F.lower(F.coalesce("file_name", F.lit("")))
    mime, ext, path = text.mime_type("mime_type"), text.extension("file_extension"), text.path("relative_path")
    status = F.col("accessibility_status")
    flags_missing = F.col("trashed").isNull() | F.col("is_missing").isNull() | F.col("is_folder").isNull()
    invalid = (F.trim(name) == "") | flags_missing | ~F.coalesce(status.isin("accessible", "inaccessible"), F.lit(False)) | ~F.coalesce("raw_type_ok", F.lit(True))
    temporary = low.startswith("~$") | low.startswith(".~lock.") | low.rlike(r"\.(tmp|temp|part|crdownload)$")
    system = low.isin(".ds_store", "thumbs.db", "desktop.ini", "icon\r") | low.startswith("._") | (F.lit(rules.reject_dotfiles) & low.startswith("."))
    required = _lookup(ext, rules, 1)
    names = tuple(p.strip().lower() for p in rules.excluded_names)
    paths = tuple("/".join(x for x in p.replace("\\", "/").split("/") if x).lower() for p in rules.excluded_paths)
    chain = (
        ((F.coalesce("is_folder", F.lit(False))) | (mime == FOLDER), "FOLDER_ITEM"),
        (F.coalesce(status == "inaccessible", F.lit(False)), "INACCESSIBLE"),
        (invalid, "INVALID_METADATA"),
        (F.col("trashed"), "TRASHED_FILE"),
        (F.col("is_missing"), "MISSING_FILE"),
        (mime == SHORTCUT, "GOOGLE_DRIVE_SHORTCUT"),
        (mime.startswith(NATIVE_PREFIX), "GOOGLE_NATIVE_FILE"),
        (temporary, "TEMPORARY_FILE"),
        (system, "SYSTEM_FILE"),
        (text.matches_any(low, names), "EXCLUDED_FILENAME"),
        (text.matches_any(path, paths), "EXCLUDED_PATH"),
        (required.isNull(), "UNSUPPORTED_EXTENSION"),
        (mime == "", "INVALID_METADATA"),
        (mime != required, "UNSUPPORTED_MIME_TYPE"),
        (F.col("size_bytes").isNull() | (F.col("size_bytes") < 0), "INVALID_SIZE"),
        (F.col("size_bytes") == 0, "ZERO_BYTE_FILE"),
    )
    out = F.when(chain[0][0], chain[0][1])
    for condition, reason in chain[1:]:
        out = out.when(condition, reason)
    return out.otherwise("SUPPORTED_FORMAT")


def decide(files: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """``files`` with decision, target_status, reason_code, normal forms and the policy of the format."""
    if "raw_type_ok" not in files.columns:
        files = files.withColumn("raw_type_ok", F.lit(True))
    df = files.withColumn("reason_code", reason_code(rules))
    reason, ext = F.col("reason_code"), text.extension("file_extension")
    past_extension = reason.isin("UNSUPPORTED_MIME_TYPE", "INVALID_SIZE", "ZERO_BYTE_FILE", "SUPPORTED_FORMAT") | (
        (reason == "INVALID_METADATA") & (text.mime_type("mime_type") == "") & (F.trim(F.coalesce("file_name", F.lit(""))) != "") & F.col("raw_type_ok") & _lookup(ext, rules, 1).isNotNull()
        & F.coalesce(F.col("accessibility_status").isin("accessible", "inaccessible"), F.lit(False)) & F.col("trashed").isNotNull() & F.col("is_missing").isNotNull() & F.col("is_folder").isNotNull()
    )
    return df.withColumns({
        "decision": F.when(reason.isin("FOLDER_ITEM", "INACCESSIBLE"), "PENDING").when(reason == "SUPPORTED_FORMAT", "TAKE").otherwise("SKIP"),
        "target_status": F.when(reason == "FOLDER_ITEM", "DISCOVERED").when(reason == "INACCESSIBLE", "INACCESSIBLE").when(reason == "SUPPORTED_FORMAT", "READY").otherwise("SKIPPED"),
        "normalized_extension": ext,
        "normalized_mime_type": text.mime_type("mime_type"),
        "media_category": F.when(past_extension, _lookup(ext, rules, 2)),
        "accepted_for_ai_analysis": F.when(past_extension, _lookup(ext, rules, 3)).otherwise(False),
    })


def media_category(mime: Column | str, ext: Column | str) -> Column:
    """MIME type first, extension where that says nothing."""
    m, e = text.mime_type(mime), text.extension(ext)
    kinds = lambda k: [f[0] for f in FORMATS if f[2] == k]
    by_mime = F.when(m.startswith("image/"), "image").when(m.startswith("video/"), "video").when((m == "application/pdf") | (m == PPTX) | F.contains(m, F.lit("presentation")), "document")
    return by_mime.when(e.isin(kinds("image")), "image").when(e.isin(kinds("video")), "video").when(e.isin(kinds("document")), "document").otherwise("other")


def category_filter(category: str, mime: str = "mime_type", ext: str = "file_extension") -> Column:
    """Rows of a category by MIME type or extension, either sufficing; 'other' is what none of the three takes."""
    m, e = F.lower(F.coalesce(mime, F.lit(""))), F.lower(F.coalesce(ext, F.lit("")))
    one = {
        "image": m.startswith("image/") | e.isin("jpg", "jpeg", "png", "webp"),
        "video": m.startswith("video/") | e.isin("mp4", "mov"),
        "document": F.coalesce(F.col(mime).isin("application/pdf", PPTX), F.lit(False)) | F.contains(m, F.lit("presentation")) | e.isin("pdf", "pptx"),
    }
    return ~(one["image"] | one["video"] | one["document"]) if category == "other" else one[category]


def error_class(status: Column | str) -> Column:
    """struct(error, retryable) of a read's HTTP status; null counts as permanent."""
    s = text.col(status)
    known = lambda c: F.coalesce(c, F.lit(False))
    name = F.when(known(s == 404), "SOURCE_NOT_FOUND").when(known(s.isin(401, 403)), "SOURCE_ACCESS_DENIED").when(known(s == 429), "RATE_LIMITED").when(known(s >= 500), "FAILED_RETRYABLE").otherwise("FAILED_PERMANENT")
    return F.struct(name.alias("error"), known((s == 429) | (s >= 500)).alias("retryable"))


def transfer_error_class(status: Column | str) -> Column:
    """struct(error, retryable) of a transfer's HTTP status."""
    s = text.col(status)
    again = F.coalesce(s.isin(429, 500, 502, 503, 504), F.lit(False))
    return F.struct(F.when(again, "RETRYABLE").when(F.coalesce(s.isin(401, 403), F.lit(False)), "DESTINATION_ACCESS_DENIED").otherwise("PERMANENT").alias("error"), again.alias("retryable"))
