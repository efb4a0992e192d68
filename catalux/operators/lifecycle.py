"""Upload lifecycle and work queues as transforms of a state snapshot. ``now`` is a parameter; one writer is assumed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DELAYS = (1, 2, 4, 8, 16)


def destination_action() -> Column:
    """CREATE, RECOVER, SKIP, RETRY or MANUAL_REVIEW from upload_status, destination_id, matches (count) and match_id (of a single one)."""
    status, has = F.coalesce("upload_status", F.lit("NOT_STARTED")), F.coalesce(F.col("destination_id") != "", F.lit(False))
    n = F.coalesce("matches", F.lit(0))
    own = F.coalesce((n == 1) & (F.col("match_id") == F.col("destination_id")), F.lit(False))
    return (
        F.when(n > 1, "MANUAL_REVIEW")
        .when(status == "VERIFIED", F.when(has & (n == 1), "SKIP").otherwise("MANUAL_REVIEW"))
        .when(has, F.when(own, "RECOVER").otherwise("MANUAL_REVIEW"))
        .when(n == 1, "RECOVER")
        .when(status == "FAILED_RETRYABLE", "RETRY")
        .when(status.isin("FAILED_PERMANENT", "DESTINATION_CONFLICT", "MANUAL_REVIEW_REQUIRED"), "MANUAL_REVIEW")
        .otherwise("CREATE")
    )


def claim(queue: DataFrame, now: Column, owner: str, limit: int, lease_seconds: int, most_attempts: int = 5) -> DataFrame:
    """The first ``limit`` (1 to 100) due rows, claimed: state after the claim, with previous_status.

    Wrong parameters claim nothing. The limit is the feature: a top-k by a total order, so each task keeps ``limit`` rows.
    """
    if not (1 <= limit <= 100 and 30 <= lease_seconds <= 3600 and owner.strip()):
        return queue.limit(0).withColumn("previous_status", F.col("upload_status"))
    expired = F.col("claim_expires_at") <= now
    due = F.col("upload_status").isin("NOT_STARTED", "QUEUED", "FAILED_RETRYABLE") | (F.col("upload_status").isin("CLAIMED", "UPLOADING") & expired)
    free = (F.col("claim_expires_at").isNull() | expired) & (F.col("next_retry_at").isNull() | (F.col("next_retry_at") <= now))
    first = F.when(F.col("upload_status") == "QUEUED", 0).when(F.col("upload_status") == "FAILED_RETRYABLE", 1).otherwise(2)
    chosen = queue.where((F.col("attempts") < most_attempts) & due & free).orderBy(first, F.coalesce("next_retry_at", "last_attempt_at", "created_at").asc_nulls_last(), F.col("created_at").asc_nulls_last(), "id").limit(limit)
    return chosen.withColumn("previous_status", F.col("upload_status")).withColumns({
        "upload_status": F.lit("CLAIMED"), "attempts": F.col("attempts") + 1, "last_attempt_at": now, "claim_owner": F.lit(owner.strip()),
        "claim_expires_at": now + F.make_dt_interval(secs=F.lit(lease_seconds)), "next_retry_at": F.lit(None).cast("timestamp"),
    })


def guarded_update(state: DataFrame, guard: Column, new: dict[str, Column]) -> DataFrame:
    """Compare-and-set: rows where ``guard`` holds get the new values, and ``updated`` tells."""
    hold = F.coalesce(guard, F.lit(False))
    return state.withColumns({**{c: F.when(hold, v).otherwise(F.col(c)) for c, v in new.items()}, "updated": hold})


def renew(state: DataFrame, now: Column, owner: str, lease_seconds: int) -> DataFrame:
    guard = (F.col("claim_owner") == owner) & (F.col("claim_expires_at") > now)
    return guarded_update(state, guard, {"claim_expires_at": now + F.make_dt_interval(secs=F.lit(lease_seconds))})


def release(state: DataFrame, now: Column, owner: str, status: str = "QUEUED") -> DataFrame:
    guard = (F.col("claim_owner") == owner) & (F.col("claim_expires_at") > now)
    return guarded_update(state, guard, {"upload_status": F.lit(status), "claim_owner": F.lit(None).cast("string"), "claim_expires_at": F.lit(None).cast("timestamp")})


def fail(state: DataFrame, now: Column, retryable: Column, most_attempts: int = 5, minutes: int = 5) -> DataFrame:
    """RETRY in five minutes while attempts are left and the failure is retryable, else FAILED."""
    again = F.coalesce(retryable, F.lit(False)) & (F.col("attempts") < most_attempts)
    return state.withColumns({"status": F.when(again, "RETRY").otherwise("FAILED"), "next_attempt_at": F.when(again, now + F.make_dt_interval(mins=F.lit(minutes)))})


def acquire_lock(locks: DataFrame, requests: DataFrame, now: Column) -> DataFrame:
    """(lock_name, owner, acquired) per request; one request a lock. A lock is free if absent, expired, or the owner's own."""
    name = F.nullif(F.trim("lock_name"), F.lit(""))
    r = requests.select(name.alias("lock_name"), "owner", "lease_seconds")
    held = locks.select("lock_name", F.col("owner").alias("held_by"), "expires_at")
    free = F.col("held_by").isNull() | (F.col("expires_at") <= now) | (F.col("held_by") == F.col("owner"))
    ok = F.col("lock_name").isNotNull() & F.col("owner").isNotNull() & F.col("lease_seconds").between(60, 21600) & free
    return r.join(held, "lock_name", "left").select("lock_name", "owner", F.coalesce(ok, F.lit(False)).alias("acquired"))


def retry_delay(attempt: Column, retry_after: Column | None = None) -> Column:
    """Seconds before the next attempt, without jitter: 1, 2, 4, 8, 16, at least what the server asked for; null when spent."""
    base = F.get(F.array(*map(F.lit, DELAYS)), attempt - 1)
    delay = base if retry_after is None else F.greatest(base, F.coalesce(retry_after, F.lit(0)))
    return F.when(attempt.between(1, len(DELAYS)), delay)


def stop_conditions(results: DataFrame, run: str, order: str) -> DataFrame:
    """Per attempt: runs of byte mismatches and of exhausted retries, share of severe outcomes so far, and the first reason to stop.

    A run's attempts are one window's (a batch of at most a few hundred in practice); ``longruns`` has the same for any length.
    """
    w = Window.partitionBy(run).orderBy(order)
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    island = lambda c: F.sum(F.when(F.col(c), 0).otherwise(1)).over(so_far)
    df = results.withColumns({"_m": island("mismatch"), "_e": island("exhausted"), "attempted": F.count("*").over(so_far), "severe_so_far": F.sum(F.col("severe").cast("long")).over(so_far)})
    run_of = lambda c, g: F.sum(F.col(c).cast("long")).over(Window.partitionBy(run, g).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    df = df.withColumns({"mismatches": run_of("mismatch", "_m"), "exhaustions": run_of("exhausted", "_e")})
    return df.withColumn("stop_reason", stop_reason_of()).drop("_m", "_e")


def stop_reason_of() -> Column:
    """The first reason to stop, of mismatches, exhaustions, severe_so_far and attempted."""
    return F.when(F.col("mismatches") >= 2, "TWO_CONSECUTIVE_BYTE_MISMATCHES").when(F.col("exhaustions") >= 3, "THREE_CONSECUTIVE_RETRY_EXHAUSTIONS").when(F.col("severe_so_far") * 100 >= F.col("attempted") * 5, "SEVERE_RATE_5_PERCENT")


def resolve_location(assets: DataFrame, destinations: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """(asset_id, file_id, reason): first verified destination by id, else, if ``sources`` is given, the first usable source."""
    d = destinations.groupBy("asset_id").agg(F.count("*").alias("n"), F.min(F.when((F.col("upload_status") == "VERIFIED") & F.col("destination_file_id").isNotNull(), F.struct("id", "destination_file_id"))).alias("d"))
    df = assets.select("asset_id", "active").join(d, "asset_id", "left")
    source = F.lit(None).cast("string")
    if sources is not None:
        s = sources.where("not trashed and not is_missing").groupBy("asset_id").agg(F.min(F.struct("file_id")).alias("s"))
        df, source = df.join(s, "asset_id", "left"), F.col("s.file_id").cast("string")
    verified = F.col("d.destination_file_id")
    reason = F.when(~F.col("active"), "inactive_asset").when(verified.isNotNull(), "destination").when(source.isNotNull(), "source_fallback").when(F.col("n").isNotNull(), "no_verified_destination_or_fallback").otherwise("no_destination")
    return df.select("asset_id", F.when(F.col("active"), F.coalesce(verified, source)).alias("file_id"), reason.alias("reason"))


def reconcile_destinations(rows: DataFrame, canonical: DataFrame, folder: str, expected: int) -> DataFrame:
    """One row of counters over the lifecycle table, with set differences against the canonical assets, and whether all is clean."""
    a = rows.agg(
        F.count("*").alias("asset_destinations"), F.count_if(F.col("upload_status") == "NOT_STARTED").alias("not_started"), F.count("claim_owner").alias("active_claims"),
        F.count_if(F.col("upload_status") == "UPLOADED").alias("uploaded_rows"), F.count_if(F.col("upload_status") == "VERIFIED").alias("verified_rows"), F.count("destination_file_id").alias("destination_file_ids"),
        F.count("next_retry_at").alias("retry_scheduled"), F.count_if(F.col("upload_status").isin("FAILED_PERMANENT", "DESTINATION_CONFLICT", "MANUAL_REVIEW_REQUIRED")).alias("terminal_failures"),
        (F.count("*") - F.count_distinct("asset_id", "destination_folder_id")).alias("duplicate_lifecycle_rows"), F.count_if(~F.col("destination_folder_id").eqNullSafe(F.lit(folder))).alias("outside_destination_scope"),
    )
    ids, known = rows.select("asset_id").distinct(), canonical.select("asset_id").distinct()
    outside = ids.join(known, "asset_id", "left_anti").agg(F.count("*").alias("outside_canonical_set"))
    without = known.join(ids, "asset_id", "left_anti").agg(F.count("*").alias("canonical_without_rows"))
    df = a.crossJoin(F.broadcast(outside)).crossJoin(F.broadcast(without))  # one row each
    zero = ("active_claims", "uploaded_rows", "verified_rows", "destination_file_ids", "retry_scheduled", "terminal_failures", "duplicate_lifecycle_rows", "outside_destination_scope", "outside_canonical_set", "canonical_without_rows")
    clean = (F.col("asset_destinations") == expected) & (F.col("not_started") == expected)
    for c in zero:
        clean = clean & (F.col(c) == 0)
    return df.withColumn("clean", clean)
