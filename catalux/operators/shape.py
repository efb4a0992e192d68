"""Ordered checks, buckets, samples and nested rows of the catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..schemas import FAILURES
from .sync import instant


def first_reason(*checks: tuple[Column, str]) -> Column:
    """Name of the first condition that holds; null where none does. A null condition doesn't hold."""
    out = F.when(F.coalesce(checks[0][0], F.lit(False)), checks[0][1])
    for c, name in checks[1:]:
        out = out.when(F.coalesce(c, F.lit(False)), name)
    return out


def source_preflight() -> Column:
    """Why a source must not be transferred: current state (cur_*) against what was hashed (exp_*). Absent values are not compared."""
    differs = lambda c: F.col(f"exp_{c}").isNotNull() & F.col(f"cur_{c}").isNotNull() & (F.col(f"exp_{c}") != F.col(f"cur_{c}"))
    return first_reason(
        (F.col("cur_id").isNull() & ~F.coalesce("access_denied", F.lit(False)), "SOURCE_NOT_FOUND"),
        (F.col("access_denied"), "SOURCE_ACCESS_DENIED"),
        (F.col("trashed"), "SOURCE_TRASHED"),
        (~F.col("cur_id").eqNullSafe(F.col("exp_id")), "IDENTITY_CHANGED"),
        (F.col("exp_size").isNull() | (F.col("exp_size") < 0), "EXPECTED_SIZE_MISSING"),
        (~F.col("cur_size").eqNullSafe(F.col("exp_size")), "SIZE_CHANGED"),
        (F.lower("exp_mime").isNull() | ~F.lower("cur_mime").eqNullSafe(F.lower("exp_mime")), "MIME_CHANGED"),
        (F.col("exp_modified").isNotNull() & F.col("cur_modified").isNotNull() & (instant("exp_modified") != instant("cur_modified")), "MODIFIED_TIME_CHANGED"),
        (differs("version"), "VERSION_CHANGED"),
        (~F.coalesce(F.lower("content_hash").rlike("^[0-9a-f]{64}$"), F.lit(False)), "EXPECTED_HASH_MISSING"),
    )


def destination_verification(folder: str) -> Column:
    """Why an uploaded file doesn't count as verified; null if it does."""
    return first_reason(
        (F.col("found_id").isNull(), "NOT_FOUND"), (F.col("found_trashed"), "TRASHED"), (~F.col("found_parent").eqNullSafe(F.lit(folder)), "WRONG_PARENT"), (~F.col("found_name").eqNullSafe(F.col("planned_name")), "WRONG_NAME"),
        (~F.col("found_size").eqNullSafe(F.col("expected_size")), "WRONG_SIZE"), (~F.lower("found_mime").eqNullSafe(F.lower("expected_mime")), "WRONG_MIME"), (F.col("found_md5") != F.col("expected_md5"), "WRONG_CHECKSUM"),
    )


def outcome_bucket(status: str = "hash_status") -> Column:
    s = F.col(status)
    return F.when(s == "HASHED", "HASHED").when(s == "SOURCE_CHANGED", "SOURCE_CHANGED").when(s == "FAILED_RETRYABLE", "RETRYABLE_FAILURE").when(s.isin("FAILED_PERMANENT", "SOURCE_NOT_FOUND", "SOURCE_ACCESS_DENIED", "SOURCE_TRASHED"), "PERMANENT_FAILURE").otherwise("OTHER")


def is_exception(status: str, failure: str, retry: str) -> Column:
    return F.coalesce(retry, F.lit(False)) | F.coalesce(F.coalesce(F.nullif(failure, F.lit("")), status).isin(*FAILURES), F.lit(False))


def permission_role(*capabilities: tuple[str, str], otherwise: str = "unknown") -> Column:
    """Role of the first capability column that is true, as (column, role) pairs from the strongest on."""
    return F.coalesce(first_reason(*[(F.col(c), r) for c, r in capabilities]), F.lit(otherwise))


def distribution(df: DataFrame, c: str) -> DataFrame:
    """Counts by value, nulls as '(none)'."""
    return df.groupBy(F.coalesce(F.lower(F.trim(c)), F.lit("(none)")).alias(c)).agg(F.count("*").alias("n"))


def stratified_sample(df: DataFrame, by: str, sizes: dict[str, int], *order: str) -> DataFrame:
    """The first rows of each stratum, as many as stated (a sampling operator). Only the first of a stratum are kept while sorting."""
    out = None
    for value, n in sizes.items():
        part = df.where(F.col(by) == value).orderBy(*order).limit(n)
        out = part if out is None else out.unionByName(part)
    return out


def with_links(assets: DataFrame, links: DataFrame, destinations: DataFrame) -> DataFrame:
    """Assets with ordered lists of their own files and destinations, and the first of each."""
    f = links.groupBy("asset_id").agg(F.array_sort(F.collect_list("file_id")).alias("files"))
    d = destinations.groupBy("asset_id").agg(F.array_sort(F.collect_list(F.struct("id", "upload_status", "destination_file_id"))).alias("destinations"))
    return assets.join(f, "asset_id", "left").join(d, "asset_id", "left").withColumns({"first_file": F.get("files", F.lit(0)), "first_destination": F.get("destinations", F.lit(0))})


def in_rank_order(ranked: DataFrame, rows: DataFrame, key: str, rank: str = "rank") -> DataFrame:
    """Rows of a page of ranked keys, in the page's order; keys without a row are left out."""
    return ranked.select(key, rank).join(rows, key).orderBy(rank)


def integrity(files: DataFrame, links: DataFrame, assets: DataFrame) -> DataFrame:
    """One row: links without a file, links without an asset, assets without a link, assets that repeat."""
    n = lambda df, name: df.agg(F.count("*").alias(name))
    parts = (
        n(links.join(files, "file_id", "left_anti"), "links_without_file"), n(links.join(assets, "asset_id", "left_anti"), "links_without_asset"),
        n(assets.join(links, "asset_id", "left_anti"), "assets_without_link"), assets.agg((F.count("*") - F.count_distinct("asset_id")).alias("repeated_assets")),
    )
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(F.broadcast(p))  # one row each
    return out


def run_totals(outcomes: DataFrame, run: str, names: tuple[str, ...]) -> DataFrame:
    """Counts of each outcome as columns, by run."""
    return outcomes.groupBy(run).agg(F.count("*").alias("total"), *[F.count_if(F.col("outcome") == n).alias(n.lower()) for n in names])


def latest_by(df: DataFrame, key: str, *order: str) -> DataFrame:
    """The row of each key that is last in a stated order."""
    cols = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*cols), F.struct(*order)).alias("x")).select(key, "x.*")


def header_name(c: str) -> Column:
    """A name that is safe in a header: printable ASCII without quotes and backslashes, 'download' if nothing is left."""
    x = F.trim(F.regexp_replace(F.col(c), r'[^\x20-\x7e]|["\\]', "_"))
    return F.when(F.coalesce(x, F.lit("")) == "", "download").otherwise(x)


def transcript(c: str, cap: int = 2000) -> Column:
    return F.nullif(text.collapse(c, cap), F.lit(""))


def token_cost(prompt: str, completion: str, prompt_price: float, completion_price: float) -> Column:
    """Estimated cost, prices per million tokens, six decimals."""
    million = F.lit(1_000_000).cast("decimal(10,0)")
    part = lambda c, p: F.coalesce(c, F.lit(0)).cast("decimal(18,0)") * F.lit(str(p)).cast("decimal(10,6)") / million
    return F.round(part(prompt, prompt_price) + part(completion, completion_price), 6).cast("decimal(18,6)")


def numbered(df: DataFrame, key: str, *order: str) -> DataFrame:
    return df.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
