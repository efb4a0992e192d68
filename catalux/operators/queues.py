"""Claims, events, locks and stages as transforms of a snapshot; ``now`` is a parameter and one writer is assumed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lifecycle import guarded_update
from .shape import first_reason


def _lease(now: Column, seconds: int) -> Column:
    return now + F.make_dt_interval(secs=F.lit(seconds))


def claim_hash(files: DataFrame, ids: list, now: Column, owner: str, lease_seconds: int = 900) -> DataFrame:
    """``files`` after the named ones were claimed for hashing where that is allowed: due, or hashing with an expired lease."""
    due = F.col("hash_status").isin("NOT_STARTED", "QUEUED", "FAILED_RETRYABLE") | ((F.col("hash_status") == "HASHING") & (F.col("claim_expires_at") <= now))
    right = bool(owner.strip()) and 30 <= lease_seconds <= 3600
    guard = F.lit(right) & F.col("file_id").isin(ids) & (F.col("decision") == "TAKE") & (F.col("processing_status") == "READY") & due
    none = F.lit(None).cast("string")
    return guarded_update(files, guard, {"attempts": F.col("attempts") + 1, "claim_owner": F.lit(owner.strip()), "claim_expires_at": _lease(now, lease_seconds), "failure_code": none, "hash_status": F.lit("HASHING")})


def claim_index_batch(jobs: DataFrame, now: Column, owner: str, limit: int = 1, lease_seconds: int = 900, assets: list | None = None, most_attempts: int = 5) -> DataFrame:
    """The claimed jobs (asset_id, attempts, status) of an index queue; of 1 to 200. Wrong parameters claim nothing."""
    if not (1 <= limit <= 200 and 30 <= lease_seconds <= 3600 and owner.strip()):
        return jobs.limit(0).select("asset_id", "attempts", "status")
    due = F.col("status").isin("PENDING", "QUEUED", "FAILED_RETRYABLE") | ((F.col("status") == "PROCESSING") & (F.col("claim_expires_at") <= now))
    mine = jobs.where((F.col("attempts") < most_attempts) & due & (F.lit(True) if assets is None else F.col("asset_id").isin(assets)))
    mine = mine.orderBy(F.when(F.col("status") == "FAILED_RETRYABLE", 0).otherwise(1), F.col("created_at").asc_nulls_last(), "asset_id").limit(limit)
    return mine.select("asset_id", (F.col("attempts") + 1).alias("attempts"), F.lit("PROCESSING").alias("status"))


def claim_one(jobs: DataFrame, now: Column, owner: str, lease_seconds: int = 1800) -> DataFrame:
    """The oldest due job, claimed; attempts have no cap here, and a lease is a minute at least."""
    due = (F.col("status").isin("QUEUED", "RETRY") & (F.coalesce("next_attempt_at", now) <= now)) | ((F.col("status") == "PROCESSING") & (F.col("claim_expires_at") < now))
    one = jobs.where(due).orderBy(F.col("created_at").asc_nulls_last(), "id").limit(1)
    return one.withColumns({"status": F.lit("PROCESSING"), "claim_owner": F.lit(owner), "claim_expires_at": _lease(now, max(60, lease_seconds)), "attempts": F.col("attempts") + 1})


def recovery_events(queue: DataFrame, now: Column) -> DataFrame:
    """An event for each row whose lease ran out while it was worked on."""
    lost = queue.where(F.col("upload_status").isin("CLAIMED", "UPLOADING") & (F.col("claim_expires_at") <= now))
    return lost.select("asset_id", F.col("id").alias("destination_id"), F.lit("CLAIM_RECOVERED").alias("event_type"), F.lit("WARNING").alias("event_status"), F.to_json(F.struct(F.col("upload_status").alias("previous_status"), "claim_owner")).alias("details"))


def in_scope(queue: DataFrame, folder: str | None = None, assets: DataFrame | None = None) -> DataFrame:
    """The part of a queue that a run may claim: of a folder, and of the allowed assets."""
    out = queue if folder is None else queue.where(F.col("destination_folder_id") == folder)
    return out if assets is None else out.join(assets.select("asset_id").distinct(), "asset_id", "left_semi")


#: Legacy status of an asset by that of its destination (fixed values).
LEGACY_STATUS = {"NOT_STARTED": "PENDING", "QUEUED": "PENDING", "CLAIMED": "UPLOADING", "UPLOADING": "UPLOADING", "UPLOADED": "UPLOADED", "VERIFIED": "VERIFIED", "FAILED_RETRYABLE": "FAILED", "FAILED_PERMANENT": "FAILED"}


def initialized(rows: DataFrame) -> DataFrame:
    """An event for each new destination row."""
    details = F.to_json(F.struct("migration_version", "verification_level"))
    return rows.select("asset_id", F.col("id").alias("destination_id"), F.lit("LIFECYCLE_INITIALIZED").alias("event_type"), F.lit("SUCCESS").alias("event_status"), details.alias("details"))


def legacy_status(c: str = "upload_status") -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for p in LEGACY_STATUS.items() for x in p])[F.col(c)], F.lit("PENDING"))


def locks_after(locks: DataFrame, acquired: DataFrame, released: DataFrame, now: Column) -> DataFrame:
    """The lock table after requests (lock_name, owner, lease_seconds) that were granted and releases (lock_name, owner).

    A release takes the lock of its owner away; a granted request replaces the lock of its name, at most one a name.
    """
    kept = locks.join(released.select("lock_name", "owner").distinct(), ["lock_name", "owner"], "left_anti").join(acquired.select("lock_name"), "lock_name", "left_anti")
    new = acquired.select("lock_name", "owner", (now + F.make_dt_interval(secs=F.col("lease_seconds"))).alias("expires_at"))
    return kept.select("lock_name", "owner", "expires_at").unionByName(new)


def next_stage(done: DataFrame, stages: tuple[str, ...], source: str = "source_id") -> DataFrame:
    """(source, next_stage, resumed): the first stage that has not succeeded; null when all have."""
    ok = done.groupBy(source).agg(F.collect_set(F.when(F.col("succeeded"), F.col("stage"))).alias("ok"))  # at most all stages
    left = F.filter(F.array(*map(F.lit, stages)), lambda s: ~F.array_contains("ok", s))
    return ok.select(source, F.get(left, F.lit(0)).alias("next_stage"), (F.size("ok") > 0).alias("resumed"))


def job_states(jobs: DataFrame, states: tuple[str, ...], status: str = "status") -> DataFrame:
    """One row: the jobs of each state, and all."""
    return jobs.agg(F.count("*").alias("total"), *[F.count_if(F.col(status) == s).alias(s.lower()) for s in states])


def stop_reason() -> Column:
    """Why a run must stop, over the counters that ``lifecycle.stop_conditions`` makes and four facts about the last row."""
    severe = (F.col("attempted") > 0) & (F.col("severe_so_far") * 20 >= F.col("attempted"))
    return first_reason(
        (F.col("claim_held"), "ACTIVE_CLAIM_NOT_RELEASED"), (F.col("tables_changed"), "CANONICALIZATION_TABLE_CHANGED"), (F.col("others_changed"), "NONSELECTED_ROW_CHANGED"), (F.col("mismatches") >= 2, "TWO_CONSECUTIVE_BYTE_MISMATCHES"),
        (F.col("exhaustions") >= 3, "THREE_CONSECUTIVE_RETRY_EXHAUSTIONS"), (severe, "SOURCE_CHANGE_OR_PERMANENT_FAILURE_RATE_5_PERCENT"), (F.col("rate_limited"), "PERSISTENT_HTTP_429"),
    )


def cohort_reconciliation(rows: DataFrame, cohort: DataFrame, size: int, outside: int) -> DataFrame:
    """One row of counts and ``clean``: the cohort all verified with ids of their own, the rest untouched, no claims and no retries."""
    df = rows.join(cohort.select("id").distinct().withColumn("_in", F.lit(True)), "id", "left").withColumn("_in", F.coalesce("_in", F.lit(False)))
    idle = (F.col("upload_status") == "NOT_STARTED") & F.col("destination_file_id").isNull()
    out = df.agg(
        F.count_if("_in").alias("cohort_rows"), F.count_if(F.col("_in") & (F.col("upload_status") == "VERIFIED")).alias("cohort_verified"), F.count_distinct(F.when(F.col("_in"), F.col("destination_file_id"))).alias("cohort_file_ids"),
        F.count_if(~F.col("_in")).alias("outside_rows"), F.count_if(~F.col("_in") & idle).alias("outside_untouched"), F.count_if(F.col("claim_owner").isNotNull() | F.col("claim_expires_at").isNotNull()).alias("claims"), F.count("next_retry_at").alias("retries"),
    )
    whole = (F.col("cohort_rows") == size) & (F.col("cohort_verified") == size) & (F.col("cohort_file_ids") == size)
    return out.withColumn("clean", whole & (F.col("outside_rows") == outside) & (F.col("outside_untouched") == outside) & (F.col("claims") == 0) & (F.col("retries") == 0))


def insert_or_reuse(existing: DataFrame, incoming: DataFrame, key: str, same: tuple[str, ...]) -> DataFrame:
    """(key, outcome): INSERTED, REUSED where the stored row agrees in ``same``, else CONFLICT."""
    old = existing.select(key, F.struct(*same).alias("_old"), F.lit(True).alias("_there"))
    outcome = F.when(F.col("_there").isNull(), "INSERTED").when(F.col("_old").eqNullSafe(F.struct(*same)), "REUSED").otherwise("CONFLICT")
    return incoming.join(old, key, "left").select(key, outcome.alias("outcome"))


def link_identity() -> Column:
    """What becomes of a sign-in (uid, email, email_verified) against the link of its e-mail (link_uid) and of its uid (uid_email)."""
    return (
        F.when(~F.coalesce("email_verified", F.lit(False)), "UNVERIFIED").when(F.col("user_id").isNull(), "UNKNOWN_USER").when(~F.coalesce("active", F.lit(False)), "INACTIVE_USER")
        .when(F.col("uid_email") != F.col("email"), "UID_LINKED_ELSEWHERE").when(F.col("link_uid").isNull(), "LINKED").when(F.col("link_uid") == F.col("uid"), "UNCHANGED").otherwise("USER_LINKED_ELSEWHERE")
    )


def single_folder(rows: DataFrame, folder) -> DataFrame:
    """One row: whether a batch is of one folder only, and how many rows are not."""
    other = F.count_if(~F.col("folder_id").eqNullSafe(F.lit(folder)))
    return rows.agg(F.count("*").alias("rows"), other.alias("foreign_rows"), (other == 0).alias("accepted"))


def upload_chunks(size: str, sent: str, chunk: int) -> dict[str, Column]:
    """Plan of a resumable upload: chunks in all, the next range, and whether everything was sent."""
    n, done = F.col(size), F.least(F.col(sent), F.col(size))
    return {"chunks": F.ceil(n / F.lit(chunk)).cast("long"), "next_start": done.cast("long"), "next_end": (F.least(done + chunk, n) - 1).cast("long"), "complete": done >= n}
