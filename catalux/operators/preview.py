"""What a change of the rules would do to the catalogue, and whether a catalogue is fit for a run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import rules

#: What files are grouped by where the rules decide otherwise than the catalogue says.
CHANGE_KEYS = ("extension", "mime_type", "current_decision", "current_status", "proposed_decision", "proposed_status", "reason_code", "accepted_for_analysis")


def proposed(files: DataFrame, policy: rules.Rules = rules.Rules()) -> DataFrame:
    """``files`` (the rules' columns, current_decision, current_status) beside what the rules say; a file that was inaccessible stays so."""
    status = F.when(F.col("current_status") == "INACCESSIBLE", "inaccessible").when(F.col("accessibility_status").isin("accessible", "inaccessible"), F.col("accessibility_status")).otherwise("accessible")
    df = rules.decide(files.withColumn("accessibility_status", status), policy)
    same = F.col("current_decision").eqNullSafe(F.col("decision")) & F.col("current_status").eqNullSafe(F.col("target_status"))
    return df.withColumn("changed", ~same)


def changes(judged: DataFrame) -> DataFrame:
    """Files of ``proposed`` whose decision or status would change, counted by ``CHANGE_KEYS``."""
    known = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("(missing)"))
    columns = (known("normalized_extension"), known("normalized_mime_type"), known("current_decision"), known("current_status"), F.col("decision"), F.col("target_status"), F.col("reason_code"), F.col("accepted_for_ai_analysis"))
    return judged.where("changed").groupBy(*[c.alias(n) for c, n in zip(columns, CHANGE_KEYS, strict=True)]).agg(F.count("*").alias("n"))


def summary(judged: DataFrame) -> DataFrame:
    """One row of counters over ``proposed``; duplicate identities are the rows beyond the first of a folder and file."""
    both = lambda d, s, x, y: F.count_if((F.col(d) == x) & (F.col(s) == y))
    skip, reason = F.col("decision") == "SKIP", F.col("reason_code")
    return judged.agg(
        F.count("*").alias("total_rows"), both("current_decision", "current_status", "TAKE", "READY").alias("current_take_ready"), both("current_decision", "current_status", "SKIP", "SKIPPED").alias("current_skip_skipped"),
        both("decision", "target_status", "TAKE", "READY").alias("proposed_take_ready"), both("decision", "target_status", "SKIP", "SKIPPED").alias("proposed_skip_skipped"),
        F.count_if(~F.col("changed")).alias("unchanged"), F.count_if("changed").alias("changed"), F.count_if(reason == "INACCESSIBLE").alias("inaccessible"), F.count_if(reason == "FOLDER_ITEM").alias("folder_rows"),
        F.count_if((reason == "GOOGLE_NATIVE_FILE") & skip).alias("native_skip"), F.count_if((F.col("normalized_extension") == "heic") & skip).alias("heic_skip"),
        (F.count("*") - F.count_distinct(F.struct("folder_id", "file_id"))).alias("duplicate_identities"),
    )


def preflight(assets: DataFrame, links: DataFrame, files: DataFrame, candidates: DataFrame, destinations: DataFrame, expected: int, expected_destinations: int) -> DataFrame:
    """One row of counters before a run, and the first reason against it (null: none).

    Candidates and destination rows must be as many as expected, destinations clean (no claims, leases, transfers or ids), assets and
    links as many as candidates, and every link's asset and file there.
    """
    n = lambda df, name: df.agg(F.count("*").alias(name))
    orphan = links.join(assets.select("asset_id", F.lit(True).alias("_a")).distinct(), "asset_id", "left").join(files.select("file_id", F.lit(True).alias("_f")).distinct(), "file_id", "left")
    dirty = destinations.agg(
        F.count("*").alias("asset_destinations"), F.count("claim_owner").alias("active_claims"), F.count("claim_expires_at").alias("active_leases"), F.count_if(F.col("upload_status") == "UPLOADED").alias("uploaded_rows"),
        F.count_if(F.col("upload_status") == "VERIFIED").alias("verified_rows"), F.count("destination_file_id").alias("destination_file_ids"),
    )
    out = n(candidates, "canonical_candidates")
    for part in (dirty, n(assets, "assets"), n(links, "asset_sources"), n(orphan.where("_a is null or _f is null"), "orphan_relationships")):
        out = out.crossJoin(F.broadcast(part))  # one row each
    unsafe = F.col("active_claims") + F.col("active_leases") + F.col("uploaded_rows") + F.col("verified_rows") + F.col("destination_file_ids") > 0
    reason = (
        F.when(F.col("canonical_candidates") != expected, "CANDIDATE_COUNT_MISMATCH").when(F.col("asset_destinations") != expected_destinations, "DESTINATION_COUNT_MISMATCH").when(unsafe, "UNSAFE_DESTINATION_STATE")
        .when((F.col("assets") != F.col("canonical_candidates")) | (F.col("asset_sources") != F.col("canonical_candidates")), "RELATIONSHIP_COUNT_MISMATCH").when(F.col("orphan_relationships") > 0, "ORPHAN_RELATIONSHIP")
    )
    return out.withColumn("reason", reason)
