"""Preflights reason by reason, sources that can't stand for an asset, and locations."""

import json
import uuid

import pytest

from catalux.operators import destinations, preview

QUEUE = "asset_id long, claim_owner string, claim_expires_at timestamp, upload_status string, destination_file_id string"


def flight(spark, assets=(1, 2), links=((1, 10), (2, 20)), files=(10, 20), candidates=(1, 2), queue=(), expected=2, rows=0):
    one = lambda ids, name: spark.createDataFrame([(i,) for i in ids], f"{name} long")
    link = spark.createDataFrame(list(links), "asset_id long, file_id long")
    return preview.preflight(one(assets, "asset_id"), link, one(files, "file_id"), one(candidates, "asset_id"), spark.createDataFrame(list(queue), QUEUE), expected, rows).first()


@pytest.mark.parametrize("given, reason", [
    ({}, None), ({"expected": 3, "queue": [(1, "w", None, "VERIFIED", "g")]}, "CANDIDATE_COUNT_MISMATCH"), ({"queue": [(1, None, None, "NOT_STARTED", None)]}, "DESTINATION_COUNT_MISMATCH"),
    ({"queue": [(1, "w", None, "NOT_STARTED", None)], "rows": 1, "links": ()}, "UNSAFE_DESTINATION_STATE"), ({"queue": [(1, None, None, "UPLOADED", None)], "rows": 1}, "UNSAFE_DESTINATION_STATE"),
    ({"queue": [(1, None, None, "NOT_STARTED", "g")], "rows": 1}, "UNSAFE_DESTINATION_STATE"), ({"queue": [(1, None, None, None, None)], "rows": 1}, None),
    ({"assets": (1, 2, 3)}, "RELATIONSHIP_COUNT_MISMATCH"), ({"links": ((1, 10), (2, 21))}, "ORPHAN_RELATIONSHIP"), ({"links": ((1, 10), (None, 20))}, "ORPHAN_RELATIONSHIP"), ({"assets": (), "links": (), "files": (), "candidates": (), "expected": 0}, None),
])
def test_preflight(spark, given, reason):
    assert flight(spark, **given).reason == reason


SOURCE = "file_id long, folder_id long, file_name string, mime_type string, file_extension string, size_bytes long, content_hash string, decision string, processing_status string, accessibility_status string, trashed boolean, is_missing boolean"
H = "AB" * 32


def test_only_valid_sources_stand_for_an_asset(spark):
    good = dict(folder_id=1, file_name="My clip.MOV", mime_type="Video/QuickTime", file_extension=".MOV", size_bytes=5, content_hash=H, decision="TAKE", processing_status="READY", accessibility_status="OK", trashed=False, is_missing=None)
    bad = [{"trashed": True}, {"is_missing": True}, {"decision": "SKIP"}, {"processing_status": "SKIPPED"}, {"accessibility_status": "ERROR"}, {"size_bytes": -1}, {"size_bytes": None}, {"mime_type": "video/mp4"}, {"content_hash": "00"}, {"content_hash": None}]
    names = [x.split()[0] for x in SOURCE.split(", ")]
    rows = [{"file_id": i, **good, **b} for i, b in enumerate(bad)] + [{"file_id": 50, **good, "folder_id": 2}, {"file_id": 70, **good}, {"file_id": 71, **good}]
    sources = spark.createDataFrame([tuple(r[n] for n in names) for r in rows], SOURCE)
    assets = spark.createDataFrame([(1, H), (2, H.lower()), (3, None)], "asset_id long, content_hash string")
    links = spark.createDataFrame([(1, r["file_id"]) for r in rows] + [(1, 70)] + [(2, i) for i in range(len(bad))] + [(3, 70), (9, 70)], "asset_id long, file_id long")
    got = destinations.plan(assets, links, sources, "root", "v1", original_names=True).collect()
    assert [(r.asset_id, r.selected_file_id) for r in got] == [(1, 70)]
    r = got[0]
    assert r.id == str(uuid.uuid5(uuid.NAMESPACE_URL, "destination-record:1|root|v1")) and r.source_sha256 == H.lower()
    assert r.relative_path == f"Videos/{r.filename}" and r.filename.startswith("My-clip__") and r.filename.endswith(".mov")
    assert json.loads(r.source_snapshot) == {"file_id": 70, "folder_id": 1, "hash_algorithm": "SHA-256", "expected_bytes": 5, "mime_type": "video/quicktime", "file_extension": "mov"}
    assert destinations.plan(assets, links, sources.limit(0), "root", "v1").count() == 0


def test_locations(spark):
    assets = spark.createDataFrame([(i, i != 5, None if i == 2 else f"a{i}", None, "x", 9) for i in range(1, 7)], "asset_id long, active boolean, file_name string, mime_type string, file_extension string, size_bytes long")
    d = spark.createDataFrame([(11, 1, "VERIFIED", "g2", "", "t"), (10, 1, "VERIFIED", "g1", "named", None), (9, 1, "VERIFIED", "", "no", None), (12, 2, "VERIFIED", "g3", None, None), (13, 3, "QUEUED", "g", None, None), (14, 5, "VERIFIED", "g", None, None)], "id long, asset_id long, upload_status string, destination_file_id string, destination_filename string, verified_at string")
    s = spark.createDataFrame([(3, 31, "s", None, "y", 0, True, False), (3, 32, "", "m/t", "", 0, None, None), (4, 41, "s4", "m/u", "z", 3, False, False)], "asset_id long, file_id long, file_name string, mime_type string, file_extension string, size_bytes long, trashed boolean, is_missing boolean")
    rows = lambda df: {r.asset_id: tuple(r)[1:] for r in df.collect()}
    none, stream = (None,) * 6, "application/octet-stream"
    alone = {1: ("destination", "g1", "named", stream, "x", 9, "10"), 2: ("destination", "g3", "download", stream, "x", 9, "12"), 3: ("no_verified_destination_or_fallback", *none), 4: ("no_destination", *none), 5: ("inactive_asset", *none), 6: ("no_destination", *none)}
    assert rows(destinations.located(assets, d)) == alone
    both = {**alone, 3: ("source_fallback", "32", "a3", "m/t", "x", 9, "source"), 4: ("source_fallback", "41", "s4", "m/u", "z", 3, "source")}
    assert rows(destinations.located(assets, d, s)) == both
