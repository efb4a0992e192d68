"""Queries of incremental runs: a stored catalogue against what a scan of its folders discovers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .. import storage
from ..operators import leases, longruns, sync_run
from ..sources import buckets
from . import fixtures as fx
from .catalogue import _REASON, RULES, SQL, _snapshots, query

_STORED_SIZE = "CASE WHEN file_id % 7 = 0 THEN size_bytes + 1 ELSE size_bytes END"
_STORED_HASH = "CASE WHEN file_id % 13 = 0 THEN NULL WHEN file_id % 7 = 0 THEN md5(concat('old', file_id)) ELSE content_hash END"
_STATUS = "CASE WHEN file_id % 13 = 0 THEN 'AWAITING_RETRY' ELSE 'COMPLETED' END"


def _inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Discovered files and the stored tables: a tenth is new, a tenth is gone, a seventh has changed, some failed in the run before."""
    seen = ["folder_id", "file_name", "mime_type", "file_extension", "relative_path", "checksum"]
    f = fx.files(spark, sf_dir, "file_id", "size_bytes", "content_hash", *seen)
    stored = f.where("file_id % 10 <> 0").selectExpr("file_id", *seen, f"{_STORED_SIZE} AS size_bytes", "'2024-01-01T00:00:00Z' AS modified_at", f"{_STORED_HASH} AS content_hash", "false AS is_missing", "'TAKE' AS decision", "CAST(NULL AS STRING) AS skip_reason",
                                                     "CASE WHEN file_id % 13 = 0 THEN 'FAILED_RETRYABLE' ELSE 'HASHED' END AS hash_status", "'NEW' AS sync_classification", f"{_STATUS} AS sync_status", "CAST(file_id % 5 AS INT) AS attempts", "CAST(NULL AS STRING) AS failure_reason")
    discovered = f.where("file_id % 10 <> 1").selectExpr("file_id", "size_bytes", *seen, "'2024-01-01T01:00:00+01:00' AS modified_at", "file_id % 29 <> 0 AS accessible", "content_hash", "CASE WHEN file_id % 43 = 0 THEN 'read error' END AS failure", "file_id % 2 = 0 AS retryable")
    hashed = stored.where("content_hash is not null")
    assets = hashed.groupBy("content_hash").agg({"file_id": "min"}).withColumnRenamed("min(file_id)", "first_file_id")
    links = hashed.join(assets, "content_hash").selectExpr("content_hash", "file_id", "CASE WHEN file_id = first_file_id THEN 'ORIGINAL' ELSE 'DUPLICATE' END AS relationship_type")
    assets = assets.selectExpr("content_hash", "first_file_id", "CAST(NULL AS STRING) AS mime_type", "CAST(NULL AS STRING) AS file_extension", "CAST(NULL AS BIGINT) AS size_bytes")
    return discovered, {**sync_run.empty(spark), "files": stored, "assets": assets, "links": links}


def _judged(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dict[str, DataFrame]]:
    discovered, state = _inputs(spark, sf_dir)
    return sync_run.judge(discovered, state, RULES), state


def _tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    judged, state = _judged(spark, sf_dir)
    return sync_run.tables(storage.materialize(judged, "judged"), state, "root", "v1")


_RUN = (
    "plain AS (SELECT * REPLACE (false AS is_folder, 'accessible' AS accessibility_status, false AS trashed, false AS is_missing) FROM files), "
    + _REASON.replace("FROM files)", "FROM plain)").replace("SELECT *, CASE\n", "SELECT *, CASE ")
    + f""", stored AS (SELECT file_id, {_STORED_HASH} AS h, {_STATUS} AS status FROM files WHERE file_id % 10 <> 0),
classed AS (SELECT d.*, h AS s_hash, status, s.file_id IS NOT NULL AS known, CASE WHEN d.file_id % 10 = 1 THEN 'REMOVED_FROM_SOURCE' WHEN d.file_id % 29 = 0 THEN 'INACCESSIBLE' WHEN s.file_id IS NULL THEN 'NEW' WHEN d.file_id % 7 = 0 THEN 'CHANGED' ELSE 'UNCHANGED' END AS classification
  FROM decisions d LEFT JOIN stored s USING (file_id)),
worked AS (SELECT *, CASE WHEN classification = 'UNCHANGED' AND status = 'AWAITING_RETRY' THEN 'NEW' WHEN classification IN ('NEW', 'CHANGED') THEN classification END AS work FROM classed),
hashed AS (SELECT *, work IS NOT NULL AND decision = 'TAKE' AS taken, CASE WHEN work IS NOT NULL AND decision = 'TAKE' AND file_id % 43 <> 0 THEN content_hash END AS hash, least(5, CASE WHEN known THEN file_id % 5 ELSE 0 END + 1) AS tries FROM worked),
judged AS (SELECT *, hash IS NOT NULL AND hash NOT IN (SELECT h FROM stored WHERE h IS NOT NULL) AND file_id = min(CASE WHEN hash IS NOT NULL THEN file_id END) OVER (PARTITION BY hash) AS creates FROM hashed),
outcomes AS (SELECT *, CASE WHEN work IS NULL THEN classification WHEN NOT taken THEN 'SKIPPED' WHEN hash IS NULL AND file_id % 2 = 0 AND tries < 5 THEN 'AWAITING_RETRY' WHEN hash IS NULL THEN 'FAILED' WHEN creates THEN 'PLANNED' ELSE 'LINKED_DUPLICATE' END AS outcome FROM judged)"""
)
_ALL = fx.with_(fx.FILES, _RUN)


@query(_ALL + "SELECT file_id, classification, outcome, CASE WHEN outcome = 'SKIPPED' THEN reason_code WHEN outcome IN ('AWAITING_RETRY', 'FAILED') THEN 'read error' END AS reason FROM outcomes")
def sync_run_outcomes(spark, sf_dir):
    """What a run makes of every file: rules, hashes, canonical assets and failures in one plan."""
    return _judged(spark, sf_dir)[0].select("file_id", "classification", "outcome", "reason")


@query(_ALL + """SELECT file_id, CASE WHEN hash IS NOT NULL THEN hash WHEN outcome IN ('AWAITING_RETRY', 'FAILED') THEN NULL ELSE s_hash END AS content_hash, outcome = 'REMOVED_FROM_SOURCE' AS is_missing, CASE WHEN work IS NOT NULL THEN decision ELSE 'TAKE' END AS decision,
 CASE WHEN outcome = 'SKIPPED' THEN reason_code END AS skip_reason, CASE WHEN hash IS NOT NULL THEN 'HASHED' WHEN outcome = 'AWAITING_RETRY' THEN 'FAILED_RETRYABLE' WHEN outcome = 'FAILED' THEN 'FAILED_PERMANENT' WHEN known AND file_id % 13 = 0 THEN 'FAILED_RETRYABLE' WHEN known THEN 'HASHED' END AS hash_status,
 CASE WHEN outcome = 'INACCESSIBLE' THEN 'NEW' ELSE coalesce(work, classification) END AS sync_classification, CASE WHEN outcome = 'INACCESSIBLE' THEN status WHEN outcome IN ('AWAITING_RETRY', 'FAILED') THEN outcome ELSE 'COMPLETED' END AS sync_status,
 CAST(CASE WHEN outcome IN ('AWAITING_RETRY', 'FAILED') THEN tries WHEN known THEN file_id % 5 ELSE 0 END AS BIGINT) AS attempts FROM outcomes WHERE outcome <> 'INACCESSIBLE' OR known""")
def sync_run_files(spark, sf_dir):
    """The files table after the run."""
    return _tables(spark, sf_dir)["files"].selectExpr("file_id", "content_hash", "is_missing", "decision", "skip_reason", "hash_status", "sync_classification", "sync_status", "CAST(attempts AS BIGINT) AS attempts")


@query(_ALL + """, old AS (SELECT h AS content_hash, file_id, CASE WHEN file_id = min(file_id) OVER (PARTITION BY h) THEN 'ORIGINAL' ELSE 'DUPLICATE' END AS relationship_type FROM stored WHERE h IS NOT NULL)
SELECT content_hash, file_id, relationship_type FROM old LEFT JOIN outcomes o USING (file_id) WHERE o.hash IS NULL OR o.hash = old.content_hash
UNION ALL SELECT hash, file_id, CASE WHEN creates THEN 'ORIGINAL' ELSE 'DUPLICATE' END FROM outcomes o WHERE hash IS NOT NULL AND (s_hash IS NULL OR s_hash <> hash)""".replace("SELECT content_hash, file_id, relationship_type FROM old", "SELECT old.content_hash, file_id, relationship_type FROM old"))
def sync_run_links(spark, sf_dir):
    """Links of contents and files after the run; a changed file's old link is gone."""
    return _tables(spark, sf_dir)["links"]


@query(_ALL + """SELECT mime_type, category_folder, CAST(count(*) AS BIGINT) AS n FROM (SELECT lower(mime_type) AS mime_type, CASE WHEN mime_type LIKE 'image/%' THEN 'Images' WHEN mime_type LIKE 'video/%' THEN 'Videos' ELSE 'Documents' END AS category_folder FROM outcomes WHERE creates) GROUP BY ALL""")
def sync_run_destinations(spark, sf_dir):
    """Destination rows of the run's new assets, counted by route."""
    t = _tables(spark, sf_dir)
    return t["destinations"].join(t["assets"].select("content_hash", "mime_type"), "content_hash").groupBy("mime_type", "category_folder").count().withColumnRenamed("count", "n")


@query(_ALL + """SELECT CAST(count(DISTINCT folder_id) AS BIGINT) AS sources_checked, CAST(count(*) FILTER (file_id % 10 <> 1) AS BIGINT) AS files_discovered, CAST(count(*) FILTER (classification = 'NEW') AS BIGINT) AS new_files_detected, CAST(count(*) FILTER (classification = 'CHANGED') AS BIGINT) AS changed_files_detected,
 CAST(count(*) FILTER (classification = 'UNCHANGED') AS BIGINT) AS unchanged_files_ignored, CAST(count(*) FILTER (outcome = 'SKIPPED') AS BIGINT) AS files_skipped, CAST(count(hash) AS BIGINT) AS files_hashed, CAST(count(*) FILTER (outcome = 'LINKED_DUPLICATE') AS BIGINT) AS exact_duplicates_found,
 CAST(count(*) FILTER (creates) AS BIGINT) AS unique_assets_created, CAST(count(hash) AS BIGINT) AS relationships_created_or_reused, CAST(count(*) FILTER (outcome = 'LINKED_DUPLICATE') AS BIGINT) AS existing_assets_reused, CAST(count(*) FILTER (outcome = 'FAILED') AS BIGINT) AS failed_files,
 CAST(count(*) FILTER (outcome = 'AWAITING_RETRY') AS BIGINT) AS retried_files, CAST(count(*) FILTER (outcome IN ('FAILED', 'AWAITING_RETRY')) AS BIGINT) AS unresolved_exceptions, CAST(count(*) FILTER (classification = 'REMOVED_FROM_SOURCE') AS BIGINT) AS removed_from_source,
 CAST(count(*) FILTER (classification = 'INACCESSIBLE') AS BIGINT) AS inaccessible FROM outcomes""")
def sync_run_totals(spark, sf_dir):
    """Counters of the run."""
    return sync_run.totals(_judged(spark, sf_dir)[0])


_REQUESTS = {
    "item_id": "user_id % 40", "at": "{ms}", "number": "event_id", "kind": "CASE WHEN event_id % 5 < 3 THEN 'CLAIM' WHEN event_id % 5 = 3 THEN 'RENEW' ELSE 'RELEASE' END",
    "owner": "concat('w', event_id % 3)", "seconds": "CAST(600 + event_id % 7 * 3600 AS INT)",
}
_UNTIL = 1706400000000


@query("WITH RECURSIVE r AS (SELECT " + ", ".join(f"{x.replace('{ms}', 'epoch_us(ts) // 1000')} AS {c if c != 'at' else 'ms'}" for c, x in _REQUESTS.items()) + f""" FROM events),
n AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY ms, number) AS k FROM r),
w AS (SELECT item_id, CAST(0 AS BIGINT) AS k, CAST(NULL AS VARCHAR) AS owner, CAST(NULL AS BIGINT) AS ends, CAST(NULL AS BIGINT) AS ms, CAST(NULL AS VARCHAR) AS event, CAST(NULL AS VARCHAR) AS who, CAST(NULL AS VARCHAR) AS lost, CAST(NULL AS BIGINT) AS lost_at FROM (SELECT DISTINCT item_id FROM n)
 UNION ALL SELECT item_id, k, CASE WHEN event IN ('UPLOAD_CLAIMED', 'CLAIM_RENEWED') THEN who WHEN event = 'CLAIM_RELEASED' THEN NULL ELSE owner END, CASE WHEN event IN ('UPLOAD_CLAIMED', 'CLAIM_RENEWED') THEN ms + 1000 * seconds WHEN event = 'CLAIM_RELEASED' THEN NULL ELSE ends END, ms, event, who, lost, lost_at
 FROM (SELECT item_id, k, ms, seconds, who, owner, ends, lost, lost_at, CASE WHEN kind = 'CLAIM' AND owner IS NULL THEN 'UPLOAD_CLAIMED' WHEN kind = 'RENEW' AND owner = who THEN 'CLAIM_RENEWED' WHEN kind = 'RELEASE' AND owner = who THEN 'CLAIM_RELEASED' ELSE 'CLAIM_REFUSED' END AS event
  FROM (SELECT n.item_id, n.k, n.ms, n.kind, n.seconds, n.owner AS who, CASE WHEN w.ends > n.ms THEN w.owner END AS owner, CASE WHEN w.ends > n.ms THEN w.ends END AS ends, CASE WHEN w.ends <= n.ms THEN w.owner END AS lost, CASE WHEN w.ends <= n.ms THEN w.ends END AS lost_at FROM w JOIN n ON n.item_id = w.item_id AND n.k = w.k + 1)))
SELECT item_id, ms AS "at", event, who AS owner, CASE WHEN event = 'CLAIM_RELEASED' THEN NULL ELSE ends END AS expires_at FROM w WHERE k > 0 UNION ALL SELECT item_id, lost_at, 'CLAIM_RECOVERED', lost, NULL FROM w WHERE lost IS NOT NULL
UNION ALL SELECT item_id, ends, 'CLAIM_RECOVERED', owner, NULL FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY k DESC) AS last FROM w) WHERE last = 1 AND ends <= {_UNTIL}""")
def lease_history(spark, sf_dir):
    """What every request for a lease did, and the leases that ran out."""
    r = fx.table(spark, sf_dir, "events").selectExpr(*[f"{x.replace('{ms}', 'unix_millis(CAST(ts AS TIMESTAMP))')} AS {c}" for c, x in _REQUESTS.items()])
    return leases.history(r, _UNTIL)


@query(SQL["upsert_snapshot"])
def bucketed_upsert(spark, sf_dir):
    """Upsert on a key, in buckets: those without incoming keys are not written."""
    f = fx.files(spark, sf_dir, "file_id", "size_bytes")
    t = buckets.Buckets(spark, storage.new_path(spark, "buckets"), "file_id", ("file_id", "size_bytes", "first_seen", "last_seen"), 32)
    t.write(f.where("file_id % 3 <> 0").selectExpr("*", "TIMESTAMP '2024-01-01' AS first_seen", "TIMESTAMP '2024-01-01' AS last_seen"), "stored")
    t.upsert(f.where("file_id % 4 = 0").selectExpr("file_id", "size_bytes + 5 AS size_bytes", "TIMESTAMP '2024-02-01' AS observed_at"), "upserted")
    return t.read()


@query(SQL["snapshot_diff"])
def bucketed_diff(spark, sf_dir):
    """Classes of files by comparing digests of buckets first."""
    sides = []
    for name, files in zip(("discovered", "stored"), _snapshots(spark, sf_dir), strict=True):
        t = buckets.Buckets(spark, storage.new_path(spark, f"buckets-{name}"), "file_id", buckets.COMPARED, 32)
        t.write(buckets.comparable(files), "v")
        sides.append(t)
    return buckets.classified(*sides)


@query("""WITH x AS (SELECT 0 AS run, event_id, event_type = 'error' AS mismatch, event_type = 'view' AS exhausted, event_id % 60 = 0 AS severe FROM events),
g AS (SELECT *, sum(CASE WHEN mismatch THEN 0 ELSE 1 END) OVER w AS gm, sum(CASE WHEN exhausted THEN 0 ELSE 1 END) OVER w AS ge, count(*) OVER w AS attempted, sum(severe::INT) OVER w AS severe_so_far FROM x WINDOW w AS (PARTITION BY run ORDER BY event_id ROWS UNBOUNDED PRECEDING)),
r AS (SELECT *, sum(mismatch::INT) OVER (PARTITION BY run, gm ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS mismatches, sum(exhausted::INT) OVER (PARTITION BY run, ge ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS exhaustions FROM g)
SELECT event_id, CAST(attempted AS BIGINT) AS attempted, CAST(severe_so_far AS BIGINT) AS severe_so_far, CAST(mismatches AS BIGINT) AS mismatches, CAST(exhaustions AS BIGINT) AS exhaustions, CASE WHEN mismatches >= 2 THEN 'TWO_CONSECUTIVE_BYTE_MISMATCHES' WHEN exhaustions >= 3 THEN 'THREE_CONSECUTIVE_RETRY_EXHAUSTIONS' WHEN severe_so_far * 100 >= attempted * 5 THEN 'SEVERE_RATE_5_PERCENT' END AS stop_reason FROM r""")
def long_run_conditions(spark, sf_dir):
    """Stop conditions of all events as one run, whose parts lie in several tasks."""
    e = fx.table(spark, sf_dir, "events").selectExpr("0 AS run", "event_id", "event_type = 'error' AS mismatch", "event_type = 'view' AS exhausted", "event_id % 60 = 0 AS severe")
    return longruns.stop_conditions(e, "run", "event_id").select("event_id", "attempted", "severe_so_far", "mismatches", "exhaustions", "stop_reason")
