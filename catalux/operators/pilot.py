"""Manifests of approved assets: many at once, each judged as a whole.

``assets`` has manifest_id, position, asset_id, extension, risk_flag, approved and, for ``mix_errors``, destination_category and enhanced;
``manifests`` has manifest_id and tier. Of the rows of an asset the first by position counts, so that repeating an id never widens
what is approved. A manifest's rows are counted before they are shuffled, so a manifest of any size is one small row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .checks import UUID, known

#: Tiers of a manifest, and the flag that keeps an asset out of the lower one.
TIERS = ("low-risk", "clinical")
NEVER_SENT = "DO_NOT_SEND_EXTERNALLY"


def _uuid(c: str) -> Column:
    return known(F.lower(F.col(c)).rlike(UUID))


def first_rows(assets: DataFrame) -> DataFrame:
    """The first row of each asset of a manifest; rows of one position: the least by their other columns. Ids are lower-cased."""
    rest = [c for c in assets.columns if c not in ("manifest_id", "asset_id", "position")]
    least = F.min(F.struct("position", *rest)).alias("x")
    return assets.withColumn("asset_id", F.lower("asset_id")).groupBy("manifest_id", "asset_id").agg(least).select("manifest_id", "asset_id", "x.*")


def verdicts(manifests: DataFrame, assets: DataFrame, most: int, default_tier: str | None = None) -> DataFrame:
    """(manifest_id, tier, assets, reason) of each manifest; reason null: accepted. Ids of manifests are unique.

    ``default_tier`` stands for an absent tier. A malformed id refuses the manifest, before its size and its flags count.
    """
    per = first_rows(assets).groupBy("manifest_id").agg(F.count("*").alias("assets"), F.count_if(~_uuid("asset_id")).alias("_bad"), F.count_if(F.col("risk_flag") == NEVER_SENT).alias("_never"))
    tier = F.coalesce("tier", F.lit(default_tier).cast("string"))
    n = lambda c: F.coalesce(c, F.lit(0))
    reason = (
        F.when(~known(F.col("tier").isin(*TIERS)), "TIER_UNKNOWN").when(n("assets") == 0, "NO_ASSETS").when(n("_bad") > 0, "ASSET_ID_NOT_UUID")
        .when(n("assets") > most, "TOO_MANY_ASSETS").when((F.col("tier") == "low-risk") & (n("_never") > 0), "NEVER_SENT_ASSET_IN_LOW_RISK")
    )
    df = manifests.select("manifest_id", tier.alias("tier")).join(per, "manifest_id", "left")
    return df.select("manifest_id", "tier", n("assets").cast("long").alias("assets"), reason.alias("reason"))


def approved(judged: DataFrame, assets: DataFrame, approved_only: bool = True) -> DataFrame:
    """(manifest_id, asset_id, position) that accepted manifests allow."""
    rows = first_rows(assets)
    rows = rows.where(known(F.col("approved"))) if approved_only else rows
    return rows.join(judged.where("reason is null").select("manifest_id"), "manifest_id", "left_semi").select("manifest_id", "asset_id", "position")


def requested(allowed: DataFrame, requests: DataFrame) -> DataFrame:
    """(manifest_id, asset_id, reason) of each different request (manifest_id, asset_id): null if it is among ``allowed``."""
    asked = requests.select("manifest_id", F.lower("asset_id").alias("asset_id")).distinct()
    there = allowed.select("manifest_id", "asset_id", F.lit(True).alias("_ok"))
    reason = F.when(~_uuid("asset_id"), "NOT_A_UUID").when(F.col("_ok").isNull(), "ABSENT_OR_NOT_APPROVED")
    return asked.join(there, ["manifest_id", "asset_id"], "left").select("manifest_id", "asset_id", reason.alias("reason"))


def mix_errors(assets: DataFrame, mix: dict[str, int], routes: dict[str, str], enhanced: tuple[str, ...]) -> DataFrame:
    """(manifest_id, assets, repeated, misrouted, reason) of each manifest with rows; reason null: as agreed.

    As many rows as ``mix`` adds up to, different assets, each format as often as agreed, each row routed to its format's category, and
    a row picked for the enhanced check of every format in ``enhanced``. An absent id is an id; a row of a format without a category is
    misrouted, whether it has a category or none.
    """
    want = F.create_map(*[F.lit(x) for pair in routes.items() for x in pair])
    is_ext = lambda e: F.col("extension") == e
    per = assets.groupBy("manifest_id").agg(
        F.count("*").alias("assets"), (F.count("*") - F.count_distinct(F.coalesce("asset_id", F.lit("")))).alias("repeated"),
        F.count_if(~known(F.col("destination_category") == F.try_element_at(want, F.coalesce("extension", F.lit(""))))).alias("misrouted"),
        F.struct(*[F.count_if(is_ext(e)).alias(f"x{i}") for i, e in enumerate(mix)]).alias("mix"), F.struct(F.lit(0).alias("_"), *[F.count_if(is_ext(e) & F.col("enhanced")).alias(f"x{i}") for i, e in enumerate(enhanced)]).alias("picked"),
    )
    wrong, none = F.lit(False), F.lit(False)
    for i, n in enumerate(mix.values()):
        wrong = wrong | (F.col(f"mix.x{i}") != n)
    for i in range(len(enhanced)):
        none = none | (F.col(f"picked.x{i}") == 0)
    reason = F.when(F.col("assets") != sum(mix.values()), "SIZE").when(F.col("repeated") > 0, "ASSETS_NOT_UNIQUE").when(wrong, "FORMAT_MIX").when(F.col("misrouted") > 0, "CATEGORY_ROUTING").when(none, "NO_ENHANCED_CHECK")
    return per.select("manifest_id", "assets", "repeated", "misrouted", reason.alias("reason"))
