"""Row checks and gates: strict items, domains, completeness, vocabularies, reviews, eligibility, access."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text
from ..schemas import FORMATS, INVENTORY_ITEM
from .inventory import ZONED, errors_of
from .shape import first_reason
from .sync import instant

SHA256, MD5, UUID = r"^[0-9a-f]{64}$", r"^[0-9a-f]{32}$", r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"
LEVELS = ("DESTINATION_METADATA_VERIFIED", "PROVIDER_CHECKSUM_VERIFIED", "DESTINATION_SHA256_VERIFIED")


def known(c: Column) -> Column:
    """A condition of which null counts as false."""
    return F.coalesce(c, F.lit(False))


def blank(c: Column | str) -> Column:
    return F.trim(F.coalesce(c, F.lit(""))) == ""


def json_item_errors(raw: str, keys: tuple[str, ...], texts: tuple[str, ...], number: str, moment: str) -> Column:
    """Errors of an item given as JSON: its exact keys, texts that are not blank, a whole number from 0, a moment with a zone."""
    have = F.array_sort(F.json_object_keys(raw))
    of = lambda k: F.get_json_object(raw, f"$.{k}")
    rules = [("keys", ~have.eqNullSafe(F.array(*map(F.lit, sorted(keys)))))] + [(k, blank(of(k))) for k in texts]
    when = of(moment)
    rules += [(number, ~known(of(number).rlike(r"^[0-9]+$"))), (moment, when.isNotNull() & ~known(when.rlike(ZONED) & F.try_to_timestamp(when).isNotNull()))]
    return errors_of(*rules)


def incomplete_destination() -> Column:
    """Why a destination row breaks its status' completeness rule; null if it doesn't."""
    status, no = F.col("upload_status"), lambda c: F.col(c).isNull()
    done = status.isin("UPLOADED", "VERIFIED")
    return first_reason(
        (done & no("destination_file_id"), "FILE_ID_MISSING"), (done & no("upload_completed_at"), "COMPLETION_TIME_MISSING"),
        ((status == "VERIFIED") & no("verified_at"), "VERIFICATION_TIME_MISSING"), ((status == "VERIFIED") & ~known(F.col("verification_level").isin(*LEVELS)), "VERIFICATION_LEVEL_INVALID"),
        ((status == "FAILED_RETRYABLE") & ~known(F.col("retryable")), "NOT_RETRYABLE"), ((status == "FAILED_RETRYABLE") & no("failure_code"), "FAILURE_CODE_MISSING"),
    )


def incomplete_hash() -> Column:
    """The same for hashing: a digest and a time exactly when it is done, and then no failure."""
    done = F.col("hash_status") == "HASHED"
    complete = F.col("content_sha256").isNotNull() & F.col("hash_completed_at").isNotNull()
    none = F.col("content_sha256").isNull() & F.col("hash_completed_at").isNull()
    return first_reason((done & ~complete, "DIGEST_OR_TIME_MISSING"), (done & (F.col("hash_failure_code").isNotNull() | ~known(~F.col("hash_retryable"))), "FAILURE_ON_HASHED"), (~done & ~none, "DIGEST_WITHOUT_STATUS"))


def domain_violations(df: DataFrame, key: str, allowed: dict[str, tuple[str, ...]], counters: tuple[str, ...], digests: tuple[str, ...], ordered: tuple[tuple[str, str], ...]) -> DataFrame:
    """(key, rule) of each broken rule: values outside a domain, counters below 0, digests of a wrong form, times out of order. Nulls pass."""
    rules = [(f"{c}:domain", ~F.col(c).isin(*v)) for c, v in allowed.items()] + [(f"{c}:negative", F.col(c) < 0) for c in counters]
    rules += [(f"{c}:digest", ~F.col(c).rlike(SHA256)) for c in digests] + [(f"{a}:after:{b}", F.col(a) > F.col(b)) for a, b in ordered]
    broken = F.filter(F.array(*[F.when(known(c), F.lit(n)) for n, c in rules]), lambda x: x.isNotNull())
    return df.select(key, F.explode(broken).alias("rule"))


def null_preflight(tables: dict[str, tuple[DataFrame, tuple[str, ...]]]) -> DataFrame:
    """One row: how many of the (table, column) probes have nulls, and their names in order."""
    probe = lambda name, df, cs: df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cs]).select(F.explode(F.array(*[F.struct(F.lit(f"{name}.{c}").alias("name"), F.col(c).alias("n")) for c in cs])).alias("p")).select("p.*")
    every = reduce(DataFrame.unionByName, [probe(n, df, cs) for n, (df, cs) in tables.items()])
    return every.where("n > 0").agg(F.count("*").alias("failing"), F.array_join(F.array_sort(F.collect_list("name")), ", ").alias("names"))  # a row per column


def backfilled(df: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), v) for c, v in defaults.items()})


def remapped(c: Column, names: dict[str, str]) -> Column:
    """Legacy values by their new names; others stay."""
    return F.coalesce(F.create_map(*[F.lit(x) for p in names.items() for x in p])[c], c)


def quoted_values(expression: Column) -> Column:
    """The distinct literals of a constraint expression, in order."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(expression, F.lit(r"'([^']*)'"), 1)))


def is_membership(expression: Column, column: str) -> Column:
    """Whether an expression only says that ``column`` is one of some literals: nothing is left without these parts."""
    rest = F.regexp_replace(F.regexp_replace(F.lower(expression), r"'[^']*'(::text)?", ""), rf"\b({column}|check|any|array|in|or|text)\b", "")
    return F.regexp_replace(rest, r"[\s()\[\],=:]", "") == ""


def review_errors(content_types: tuple[str, ...], reviewers: tuple[str, ...]) -> Column:
    """All errors of a reviewed row: fields, vocabulary, provenance."""
    moment = F.col("reviewed_at")
    return errors_of(
        ("asset_id must be a UUID", ~known(F.col("asset_id").rlike(UUID))), ("content_type is missing", blank("content_type")), ("content_type is not in the list", ~blank("content_type") & ~F.trim("content_type").isin(*content_types)),
        ("short_caption is missing", blank("short_caption")), ("ai_description is missing", blank("ai_description")), ("reviewed_by is not approved", ~known(F.col("reviewed_by").isin(*reviewers))),
        ("reviewed_at must be a time with a zone", ~known(moment.rlike(ZONED) & F.try_to_timestamp(moment).isNotNull())),
    )


def reviewed_manifest(rows: DataFrame, order: str, content_types: tuple[str, ...], reviewers: tuple[str, ...]) -> DataFrame:
    """``rows`` with errors; later rows of an asset have one more. The first is found by an aggregate, not by a sort."""
    first = rows.where("asset_id is not null").groupBy("asset_id").agg(F.min(order).alias("_first"))
    df = rows.join(first, "asset_id", "left")
    again = F.when(known(F.col(order) > F.col("_first")), F.array(F.lit("asset_id is there already"))).otherwise(F.array().cast("array<string>"))
    return df.withColumn("errors", F.concat(review_errors(content_types, reviewers), again)).drop("_first")


def review_status() -> Column:
    """complete, incomplete (only empty fields) or invalid."""
    empty = F.filter("errors", lambda e: F.endswith(e, F.lit("is missing")))
    return F.when(F.size("errors") == 0, "complete").when(F.size("errors") == F.size(empty), "incomplete").otherwise("invalid")


def manifest_mix(rows: DataFrame, expected: dict[str, int]) -> DataFrame:
    """(file_extension, expected, actual, ok) of each format that is expected or there, after distinct assets."""
    have = rows.dropDuplicates(["asset_id"]).groupBy("file_extension").agg(F.count("*").alias("actual"))
    want = rows.sparkSession.createDataFrame(list(expected.items()), "file_extension string, expected long")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return want.join(have, "file_extension", "full").select("file_extension", zero("expected").alias("expected"), zero("actual").alias("actual"), (zero("expected") == zero("actual")).alias("ok"))


def download_mismatch() -> Column:
    """Why a downloaded file is not the catalogued one."""
    return first_reason((~F.col("got_size").eqNullSafe(F.col("size_bytes")), "SIZE_MISMATCH"), (~F.lower("got_hash").eqNullSafe(F.lower("content_hash")), "DIGEST_MISMATCH"))


def hash_preflight() -> Column:
    """Why a source must not be hashed: its current state (cur_*) against the inventory's (inv_*). Absent values are not compared."""
    differs = lambda c: F.col(f"inv_{c}") != F.col(f"cur_{c}")
    return first_reason(
        (F.col("cur_trashed"), "SOURCE_TRASHED"), (~F.col("cur_can_download"), "SOURCE_ACCESS_DENIED"), (F.startswith(F.col("cur_mime"), F.lit("application/vnd.google-apps.")), "NATIVE_FORMAT"),
        *[(differs(c), f"{c.upper()}_CHANGED") for c in ("id", "mime", "size", "version", "revision")], (instant("inv_modified") != instant("cur_modified"), "MODIFIED_TIME_CHANGED"),
    )


def may_be_hashed() -> Column:
    free = F.col("hash_status").isin("NOT_STARTED", "QUEUED", "FAILED_RETRYABLE")
    return known((F.col("decision") == "TAKE") & (F.col("processing_status") == "READY") & ~F.col("trashed") & ~F.col("is_missing") & free & (F.col("size_bytes") > 0))


def may_be_canonical(asset_hash: str = "asset_hash") -> Column:
    h = F.lower("content_hash")
    return known((F.col("hash_status") == "HASHED") & h.rlike(SHA256) & (h == F.lower(asset_hash)) & (F.col("decision") == "TAKE") & ~F.col("trashed") & ~F.col("is_missing") & (F.col("accessibility_status") == "accessible"))


def route(ext: Column | str, mime: Column | str) -> Column:
    """Destination folder of a format with its MIME type; null for any other."""
    e, m = text.extension(ext), text.mime_type(mime)
    names = {"image": "Images", "video": "Videos", "document": "Documents"}
    return F.create_map(*[F.lit(x) for f in FORMATS for x in (f"{f[0]}|{f[1]}", names[f[2]])])[F.concat_ws("|", e, m)]


def item_class() -> Column:
    """folder, supported_media or unsupported, of rows that ``rules.decide`` has seen."""
    return F.when(F.col("is_folder"), "folder").when(F.col("reason_code") == "SUPPORTED_FORMAT", "supported_media").otherwise("unsupported")


def matching(name: str | None = None, ext: str | None = None, **equal: str | None) -> Column:
    """Library filters: part of the file name and extension whatever their case (``%`` and ``_`` as they are), and equal columns."""
    plain = lambda s: s.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    out = F.lit(True)
    if name:
        out = out & F.col("file_name").ilike(f"%{plain(name)}%")
    if ext:
        out = out & F.col("file_extension").ilike(plain(ext))
    for c, v in equal.items():
        if v is not None:
            out = out & (F.col(c) == v)
    return out


def visible(rows: DataFrame, users: DataFrame, caller: str, admin_only: bool = False) -> DataFrame:
    """The rows a caller sees, with what the caller may do: none unless active, none of an admin's table unless admin. Users of one id are one row."""
    me = users.where((F.col("user_id") == caller) & F.col("active")).limit(1)
    if admin_only:
        me = me.where("role = 'ADMIN'")
    return rows.crossJoin(F.broadcast(me.select((known(F.col("can_download")) | (F.col("role") == "ADMIN")).alias("can_download"), (known(F.col("can_view_clinical")) | (F.col("role") == "ADMIN")).alias("can_view_clinical")))).where("can_view_clinical or not clinical")  # one row at most


def provider_error(status: Column, kind: Column) -> Column:
    """retryable or permanent, of a provider's error by its HTTP status or, without one, by its kind."""
    again = status.isin(408, 409, 429) | (status >= 500)
    return F.when(known(F.when(status.isNotNull(), again).otherwise(kind.isin("timeout", "connection"))), "retryable").otherwise("permanent")


def first_code(message: Column, codes: tuple[str, ...], otherwise: str) -> Column:
    """The first of ``codes``, in their order, that a message has."""
    out = F.lit(otherwise)
    for c in reversed(codes):
        out = F.when(known(F.contains(message, F.lit(c))), c).otherwise(out)
    return out


def json_vector(c: Column | str, dimension: int) -> Column:
    """A JSON array of ``dimension`` numbers as floats; null if it is anything else."""
    x = F.from_json(text.col(c), "array<double>")
    return F.when(known((F.json_array_length(c) == dimension) & (F.size(x) == dimension) & ~F.exists(x, lambda v: v.isNull())), x.cast("array<float>"))


def is_json_object(c: Column | str) -> Column:
    return known(F.startswith(F.ltrim(text.col(c)), F.lit("{")) & F.json_object_keys(text.col(c)).isNotNull())


def wrong_types(raw: Column | str) -> Column:
    """Fields of an inventory item (JSON text) whose JSON type isn't allowed, in the item's order; null if the text is no JSON object.

    Texts may be null, a size may be null or a whole number (a truth value or a number with a point is none); every other type is wrong.
    The item is read once, as a variant, so that "3" and 3 differ.
    """
    v = F.try_parse_json(text.col(raw))
    found = []
    for f in INVENTORY_ITEM:
        kind = F.schema_of_variant(F.try_variant_get(v, f"$.{f.name}", "variant"))
        allowed = ("VOID", "BIGINT") if isinstance(f.dataType, T.LongType) else ("VOID", "STRING")
        found.append(F.when(kind.isNotNull() & ~kind.isin(*allowed), f.name))
    wrong = F.filter(F.array(*found), lambda x: x.isNotNull())
    return F.when(F.coalesce(F.startswith(F.schema_of_variant(v), F.lit("OBJECT")), F.lit(False)), wrong)
