"""Queries of audits: drift of a catalogue, manifests of approved assets, counts before and after, imports field by field."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import drift, pilot, records, rules, shape, sync
from ..sources import readers
from . import fixtures as fx
from .catalogue import _CLASSIFY, _SNAPSHOTS, _snapshots, query


@query(fx.with_(fx.FILES) + """, f AS (SELECT 'folder' AS category, CAST(x.folder_id AS VARCHAR) AS object_name, 'present' AS expected, 'absent' AS actual, 'MISSING' AS status, 'Register the folder.' AS recommendation FROM (SELECT DISTINCT folder_id FROM files) x WHERE folder_id NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey <> 4)
UNION ALL SELECT 'source record', CAST(file_id AS VARCHAR), concat('mime_type=', mime_type, '; size_bytes=', size_bytes, '; relative_path=given'), CASE WHEN file_id % 33 = 0 THEN 'absent' ELSE concat('mime_type=', CASE WHEN file_id % 10 = 0 THEN 'NULL' ELSE mime_type END, '; size_bytes=', size_bytes + CASE WHEN file_id % 14 = 0 THEN 1 ELSE 0 END, '; relative_path=', CASE WHEN file_id % 35 = 0 THEN '  ' ELSE relative_path END) END,
 CASE WHEN file_id % 33 = 0 THEN 'MISSING' ELSE 'MISMATCH' END, 'Import the record again.' FROM files WHERE file_id % 33 = 0 OR file_id % 10 = 0 OR file_id % 14 = 0 OR file_id % 35 = 0
UNION ALL SELECT 'constraint', concat(o_orderpriority, '.', o_orderkey), concat('definition~', p, '; validated=true'), concat('definition=', d, '; validated=', CASE WHEN o_orderkey % 9 = 0 THEN 'false' ELSE 'true' END), 'MISMATCH', 'Validate the rule.'
 FROM (SELECT *, concat('check ', o_orderstatus, ' ', o_orderkey % 5) AS d, CASE WHEN o_orderkey % 4 = 0 THEN 'check F [0-3]' ELSE 'check [FO] [0-9]+' END AS p FROM orders) WHERE NOT regexp_full_match(d, p) OR o_orderkey % 9 = 0
UNION ALL SELECT 'default', CAST(c_custkey AS VARCHAR), concat('value~', coalesce(p, 'NULL')), concat('value=', coalesce(v, 'NULL')), 'MISMATCH', 'Align the default.'
 FROM (SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 THEN '[A-L].*' END AS p, CASE WHEN c_custkey % 6 <> 0 THEN c_mktsegment END AS v FROM customer) WHERE CASE WHEN p IS NULL THEN v IS NOT NULL ELSE NOT regexp_full_match(coalesce(v, ''), p) END
UNION ALL SELECT 'data integrity', concat('content_hash=', content_hash), 'exactly 1 row', CAST(count(*) AS VARCHAR), 'MISMATCH', 'Keep one record of each content.' FROM files WHERE content_hash IS NOT NULL GROUP BY content_hash HAVING count(*) > 1)
SELECT *, 0 AS "at" FROM f UNION ALL SELECT 'OVERALL', 'catalogue', 'all that is required is there', CASE WHEN n > 0 THEN concat(n, ' issue(s)') ELSE 'complete' END, CASE WHEN n > 0 THEN 'MISMATCH' ELSE 'PASS' END, CASE WHEN n > 0 THEN 'Resolve every finding, then check again.' ELSE 'No action required.' END, 1 FROM (SELECT count(*) AS n FROM f)""")
def catalogue_drift(spark, sf_dir):
    """Folders, source records, rules, defaults and repeated contents against what is expected, with a verdict."""
    f = fx.files(spark, sf_dir, "file_id", "folder_id", "mime_type", "size_bytes", "relative_path", "content_hash")
    live = f.where("file_id % 33 <> 0").selectExpr("file_id", "CASE WHEN file_id % 10 <> 0 THEN mime_type END AS mime_type", "size_bytes + CASE WHEN file_id % 14 = 0 THEN 1 ELSE 0 END AS size_bytes", "CASE WHEN file_id % 35 = 0 THEN '  ' ELSE relative_path END AS relative_path")
    o = fx.table(spark, sf_dir, "orders")
    named = ("o_orderpriority", "o_orderkey")
    rule = o.selectExpr(*named, "CASE WHEN o_orderkey % 4 = 0 THEN 'check F [0-3]' ELSE 'check [FO] [0-9]+' END AS definition")
    has = o.selectExpr(*named, "concat('check ', o_orderstatus, ' ', o_orderkey % 5) AS definition", "o_orderkey % 9 <> 0 AS validated")
    c = fx.table(spark, sf_dir, "customer")
    return drift.report(
        drift.findings("folder", f.select("folder_id").distinct(), fx.folders(spark, sf_dir).where("active"), ("folder_id",), {}, "Register the folder."),
        drift.findings("source record", f, live, ("file_id",), {"mime_type": drift.SAME, "size_bytes": drift.SAME, "relative_path": drift.GIVEN}, "Import the record again."),
        drift.findings("constraint", rule, has, named, {"definition": drift.PATTERN, "validated": drift.TRUE}, "Validate the rule."),
        drift.findings("default", c.selectExpr("c_custkey", "CASE WHEN c_custkey % 3 <> 0 THEN '[A-L].*' END AS value"), c.selectExpr("c_custkey", "CASE WHEN c_custkey % 6 <> 0 THEN c_mktsegment END AS value"), ("c_custkey",), {"value": drift.PATTERN}, "Align the default."),
        drift.repeated("data integrity", f, "content_hash", "Keep one record of each content."),
    )


_ID = "concat(lpad(CAST({} AS {{s}}), 8, '0'), '-0000-4000-8000-', {})"
#: Rows of manifests: 24 documents each, pairs of one id but in every fifth; a few ids are none.
_PILOT = {
    "manifest_id": "doc_id - doc_id % 24",
    "position": "doc_id",
    "asset_id": f"CASE WHEN doc_id % 601 = 5 THEN 'none' ELSE {_ID.format('doc_id - CASE WHEN (doc_id - doc_id % 24) % 5 = 0 THEN 0 ELSE doc_id % 2 END', chr(39) + '0' * 12 + chr(39))} END",
    "risk_flag": "CASE WHEN doc_id % 200 < 2 THEN 'DO_NOT_SEND_EXTERNALLY' ELSE 'NONE' END",
    "approved": "doc_id % 3 <> 0",
}
_TIER = "CASE (doc_id - doc_id % 24) % 7 WHEN 0 THEN NULL WHEN 1 THEN 'public' WHEN 2 THEN 'clinical' ELSE 'low-risk' END"


def _pilot(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    d = fx.table(spark, sf_dir, "documents")
    return d.selectExpr("doc_id - doc_id % 24 AS manifest_id", f"{_TIER} AS tier").distinct(), d.selectExpr(*[f"{x.replace('{s}', 'STRING')} AS {c}" for c, x in _PILOT.items()])


_VERDICT = "WITH m AS (SELECT DISTINCT doc_id - doc_id % 24 AS manifest_id, coalesce(" + _TIER + ", 'clinical') AS tier FROM documents), r AS (SELECT " + ", ".join(f"{x.replace('{s}', 'VARCHAR')} AS {c}" for c, x in _PILOT.items()) + """ FROM documents),
one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY manifest_id, asset_id ORDER BY position) AS k FROM r) WHERE k = 1),
v AS (SELECT manifest_id, tier, CAST(count(asset_id) AS BIGINT) AS assets, CASE WHEN tier NOT IN ('low-risk', 'clinical') THEN 'TIER_UNKNOWN' WHEN count(asset_id) = 0 THEN 'NO_ASSETS' WHEN bool_or(asset_id = 'none') THEN 'ASSET_ID_NOT_UUID' WHEN count(asset_id) > 12 THEN 'TOO_MANY_ASSETS'
 WHEN tier = 'low-risk' AND bool_or(risk_flag = 'DO_NOT_SEND_EXTERNALLY') THEN 'NEVER_SENT_ASSET_IN_LOW_RISK' END AS reason FROM m LEFT JOIN one USING (manifest_id) GROUP BY 1, 2),
ok AS (SELECT manifest_id, asset_id, position FROM one JOIN (SELECT manifest_id FROM v WHERE reason IS NULL) USING (manifest_id) WHERE approved)"""


def _judged(assets: DataFrame, manifests: DataFrame) -> DataFrame:
    return pilot.verdicts(manifests, assets, 12, "clinical")


@query(_VERDICT + " SELECT * FROM v")
def pilot_verdicts(spark, sf_dir):
    """Manifests of approved assets, each accepted or refused as a whole."""
    manifests, assets = _pilot(spark, sf_dir)
    return _judged(assets, manifests)


@query(_VERDICT + " SELECT * FROM ok")
def pilot_approved(spark, sf_dir):
    """The assets that accepted manifests allow, each once."""
    manifests, assets = _pilot(spark, sf_dir)
    return pilot.approved(_judged(assets, manifests), assets)


@query(_VERDICT + """, q AS (SELECT DISTINCT manifest_id, lower(CASE WHEN position % 10 = 0 THEN concat('x', asset_id) ELSE upper(asset_id) END) AS asset_id FROM r)
SELECT q.manifest_id, q.asset_id, CASE WHEN q.asset_id LIKE 'x%' OR q.asset_id = 'none' THEN 'NOT_A_UUID' WHEN ok.asset_id IS NULL THEN 'ABSENT_OR_NOT_APPROVED' END AS reason FROM q LEFT JOIN ok ON q.manifest_id = ok.manifest_id AND q.asset_id = ok.asset_id""")
def pilot_requested(spark, sf_dir):
    """Requested ids against the allow-list of their manifest."""
    manifests, assets = _pilot(spark, sf_dir)
    asked = assets.selectExpr("manifest_id", "CASE WHEN position % 10 = 0 THEN concat('x', asset_id) ELSE upper(asset_id) END AS asset_id")
    return pilot.requested(pilot.approved(_judged(assets, manifests), assets), asked)


_MIX = {"jpg": 1, "jpeg": 1, "png": 1, "webp": 1, "mp4": 1, "mov": 1, "pdf": 1, "pptx": 1, "heic": 1}
_ROUTES = {"jpg": "Images", "jpeg": "Images", "png": "Images", "webp": "Images", "mp4": "Videos", "mov": "Videos", "pdf": "Documents", "pptx": "Documents", "heic": "Images"}
_ROUTE = "CASE WHEN file_extension IN ('mp4', 'mov') THEN 'Videos' WHEN file_extension IN ('pdf', 'pptx') THEN 'Documents' ELSE 'Images' END"
_SELECTION = {
    "manifest_id": "file_id - file_id % 9",
    "asset_id": "CASE WHEN file_id % 60 = 1 THEN file_id - 1 ELSE file_id END",
    "extension": "CASE WHEN file_id % 70 = 0 THEN 'gif' ELSE file_extension END",
    "destination_category": f"CASE WHEN file_id % 80 <> 0 THEN {_ROUTE} END",
    "enhanced": "file_id % 5 <> 0",
}


@query(fx.with_(fx.FILES) + ", s AS (SELECT " + ", ".join(f"{x} AS {c}" for c, x in _SELECTION.items()) + """ FROM files WHERE file_id % 100 <> 0),
p AS (SELECT manifest_id, count(*) AS assets, count(*) - count(DISTINCT asset_id) AS repeated, count(*) FILTER (destination_category IS NULL OR extension = 'gif') AS misrouted, count(DISTINCT extension) AS formats, count(*) FILTER (extension = 'gif') AS gifs, count(*) FILTER (extension = 'jpeg' AND enhanced) AS a, count(*) FILTER (extension = 'mp4' AND enhanced) AS b FROM s GROUP BY 1)
SELECT manifest_id, CAST(assets AS BIGINT) AS assets, CAST(repeated AS BIGINT) AS repeated, CAST(misrouted AS BIGINT) AS misrouted, CASE WHEN assets <> 9 THEN 'SIZE' WHEN repeated > 0 THEN 'ASSETS_NOT_UNIQUE' WHEN formats < 9 OR gifs > 0 THEN 'FORMAT_MIX' WHEN misrouted > 0 THEN 'CATEGORY_ROUTING' WHEN a = 0 OR b = 0 THEN 'NO_ENHANCED_CHECK' END AS reason FROM p""")
def pilot_mix(spark, sf_dir):
    """Selections of nine files: size, different assets, formats, routes and enhanced checks."""
    f = fx.files(spark, sf_dir, "file_id", "file_extension").where("file_id % 100 <> 0").selectExpr(*[f"{x} AS {c}" for c, x in _SELECTION.items()])
    return pilot.mix_errors(f, _MIX, _ROUTES, ("jpeg", "mp4"))


@query(fx.with_(fx.FILES, _SNAPSHOTS, _CLASSIFY) + "SELECT n.classification, CAST(count(c.file_id) AS BIGINT) AS files FROM (VALUES ('NEW'), ('CHANGED'), ('UNCHANGED'), ('REMOVED_FROM_SOURCE'), ('INACCESSIBLE')) n(classification) LEFT JOIN c ON n.classification = c.classification GROUP BY 1")
def change_counts(spark, sf_dir):
    """Files of each class of change."""
    return sync.class_counts(sync.classify(*_snapshots(spark, sf_dir)))


@query("""WITH b AS (SELECT 'files' AS relation, count(*) AS n FROM documents UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'customers', count(*) FROM customer),
a AS (SELECT 'files' AS relation, count(*) AS n FROM documents WHERE doc_id % 6 <> 0 UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'events', count(*) FROM events)
SELECT coalesce(b.relation, a.relation) AS relation, CAST(b.n AS BIGINT) AS rows_before, CAST(a.n AS BIGINT) AS rows_after FROM b FULL JOIN a ON b.relation = a.relation WHERE b.n IS DISTINCT FROM a.n""")
def count_changes(spark, sf_dir):
    """Relations whose numbers of rows differ between two states."""
    t = lambda n: fx.table(spark, sf_dir, n)
    before = sync.table_counts({"files": t("documents"), "orders": t("orders"), "customers": t("customer")})
    return sync.count_changes(before, sync.table_counts({"files": t("documents").where("doc_id % 6 <> 0"), "orders": t("orders"), "events": t("events")}))


_OWNED = {
    "file_name": "file_name", "mime_type": "mime_type", "file_extension": "file_extension", "size_bytes": "size_bytes", "checksum": "checksum", "created_at": "'2024-01-01T00:00:00Z'", "modified_at": "'2024-01-02T00:00:00Z'",
    "view_link": "concat('v', file_id)", "thumbnail_link": "CASE WHEN file_id % 2 = 0 THEN concat('t', file_id) END", "parent_folder_id": "concat('p', folder_id)", "relative_path": "relative_path", "decision": "'TAKE'", "processing_status": "'READY'",
    "processing_error": "CAST(NULL AS {s})", "skip_reason": "CAST(NULL AS {s})", "trashed": "trashed", "is_missing": "is_missing",
}
#: Values of the stored rows, where they are others; a time in another zone is the same instant.
_STORED = {
    "file_name": "upper(file_name)", "mime_type": "CAST(NULL AS {s})", "file_extension": "concat(file_extension, 'x')", "size_bytes": "size_bytes + 1", "checksum": "CAST(NULL AS {s})", "created_at": "'2024-01-01T05:30:00+05:30'", "modified_at": "'2024-01-02T00:00:01Z'",
    "view_link": "CAST(NULL AS {s})", "thumbnail_link": "'t'", "parent_folder_id": "'p'", "relative_path": "''", "decision": "'SKIP'", "processing_status": "'SKIPPED'", "processing_error": "'e'", "skip_reason": "'TRASHED_FILE'", "trashed": "NOT trashed", "is_missing": "NOT is_missing",
}


def _old(dialect: str) -> list[str]:
    return [f"CASE WHEN file_id % {k} = 0 THEN {_STORED[c]} ELSE {x} END AS {c}".replace("{s}", dialect) for k, (c, x) in enumerate(_OWNED.items(), 3)]


@query(fx.with_(fx.FILES) + ", o AS (SELECT file_id, " + ", ".join(_old("VARCHAR")) + " FROM files WHERE file_id % 21 <> 1), n AS (SELECT file_id, " + ", ".join(f"{x} AS {c}".replace("{s}", "VARCHAR") for c, x in _OWNED.items()) + " FROM files), p AS (SELECT n.file_id, o.file_id IS NULL AS fresh, list_filter([" + ", ".join(f"CASE WHEN {f'CAST(o.{c} AS TIMESTAMPTZ) IS DISTINCT FROM CAST(n.{c} AS TIMESTAMPTZ)' if c.endswith('_at') else f'o.{c} IS DISTINCT FROM n.{c}'} THEN '{c}' END" for c in _OWNED) + "], lambda x: x IS NOT NULL) AS d FROM n LEFT JOIN o ON n.file_id = o.file_id) SELECT file_id, CASE WHEN fresh THEN 'INSERT' WHEN len(d) > 0 THEN 'UPDATE' ELSE 'UNCHANGED' END AS action, CASE WHEN fresh THEN '' ELSE array_to_string(d, ',') END AS changed FROM p")
def import_changes(spark, sf_dir):
    """The plan of an import over all fields that a report owns, several of which may differ at once."""
    f = fx.files(spark, sf_dir, "file_id", "folder_id", "file_name", "mime_type", "file_extension", "size_bytes", "checksum", "relative_path", "trashed", "is_missing")
    new = f.selectExpr("file_id", *[f"{x} AS {c}".replace("{s}", "STRING") for c, x in _OWNED.items()])
    return records.import_changes(f.where("file_id % 21 <> 1").selectExpr("file_id", *_old("STRING")), new)


_IS = {
    "image": "(mime_type LIKE 'image/%' OR file_extension IN ('jpg', 'jpeg', 'png', 'webp'))",
    "video": "(mime_type LIKE 'video/%' OR file_extension IN ('mp4', 'mov'))",
    "document": "(mime_type = 'application/pdf' OR mime_type LIKE '%presentation%' OR file_extension IN ('pdf', 'pptx'))",
}


@query(fx.with_(fx.FILES) + "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS category, file_id FROM files WHERE {w}" for c, w in (*_IS.items(), ("other", f"NOT ({' OR '.join(_IS.values())})"))) + ")")
def category_filters(spark, sf_dir):
    """The files of each of the four categories; one by MIME type and another by extension is in two."""
    f = fx.files(spark, sf_dir, "file_id", "mime_type", "file_extension")
    names = ("image", "video", "document", "other")
    inside = F.filter(F.array(*[F.when(rules.category_filter(c), F.lit(c)) for c in names]), lambda x: x.isNotNull())
    return f.select(F.explode(inside).alias("category"), "file_id")


@query(fx.with_(fx.FILES, _SNAPSHOTS, _CLASSIFY) + "SELECT file_id, classification FROM c WHERE classification = 'UNCHANGED' AND file_id % 4 IN (0, 1) AND (file_id % 8 <> 0 OR file_id % 3 = 0)")
def trusted_unchanged(spark, sf_dir):
    """Unchanged files whose stored state and digest can be relied on."""
    d, s = _snapshots(spark, sf_dir)
    stored = s.selectExpr("file_id", "CASE file_id % 4 WHEN 0 THEN 'HASHED' WHEN 2 THEN 'QUEUED' END AS hash_status", "CASE WHEN file_id % 4 = 1 THEN 'VERIFIED' ELSE 'NEW' END AS processing_status", "CASE WHEN file_id % 8 = 0 THEN '' ELSE 'h' END AS content_hash", "CASE WHEN file_id % 3 = 0 THEN 'g' END AS destination_file_id")
    return sync.trusted_unchanged(sync.classify(d, s), stored)


@query("SELECT o_custkey AS customer, o_orderkey AS id, CASE WHEN o_orderkey % 4 <> 0 THEN 'old' ELSE 'new' END AS origin FROM orders WHERE o_orderkey % 4 <> 0 OR o_orderkey % 3 = 0")
def insert_missing(spark, sf_dir):
    """Incoming rows of keys that are there already are ignored."""
    o = fx.table(spark, sf_dir, "orders").selectExpr("o_custkey AS customer", "o_orderkey AS id")
    return sync.insert_missing(o.where("id % 4 <> 0").withColumn("origin", F.lit("old")), o.where("id % 3 = 0").withColumn("origin", F.lit("new")), "customer", "id")


@query(fx.with_(fx.FILES) + "SELECT file_id, size_bytes, CAST(user_id AS BIGINT) AS rank FROM (SELECT event_id AS file_id, event_id AS user_id FROM events) e JOIN files USING (file_id)")
def rows_in_rank_order(spark, sf_dir):
    """Rows of ranked ids; ids without a row are left out."""
    ranked = fx.table(spark, sf_dir, "events").selectExpr("event_id AS file_id", "CAST(event_id AS BIGINT) AS rank")
    return shape.in_rank_order(ranked, fx.files(spark, sf_dir, "file_id", "size_bytes"), "file_id").select("file_id", "size_bytes", "rank")


@query("SELECT id FROM (SELECT event_id AS id, ts FROM events WHERE event_type = 'view' ORDER BY ts DESC, event_id DESC LIMIT 1)")
def latest_run(spark, sf_dir):
    """The latest run whose metadata has a report's fingerprint."""
    e = fx.table(spark, sf_dir, "events").selectExpr("event_id AS id", "ts AS created_at", "to_json(named_struct('report_sha256', event_type, 'n', user_id)) AS metadata")
    return readers.latest_run(e, "view").select("id")
