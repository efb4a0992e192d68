"""Drift, manifests of approved assets, imports field by field."""

import uuid

from catalux.operators import drift, pilot, records, sync

A, B, C = (str(uuid.UUID(int=i, version=4)) for i in (1, 2, 3))


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_drift_of_each_rule(spark):
    want = spark.createDataFrame([("a", "x", "[0-9]+"), ("b", None, None), ("c", "x", "y"), ("d", "x", "y|yy"), (None, "x", "y")], "k string, same string, pat string")
    have = spark.createDataFrame([("a", "x", "12", True, "n"), ("b", None, None, True, "n"), ("d", "x", "yyy", None, " "), ("e", "q", "q", False, "n")], "k string, same string, pat string, on boolean, note string")
    r = {"same": drift.SAME, "pat": drift.PATTERN, "on": drift.TRUE, "note": drift.GIVEN}
    found = drift.findings("part", want, have, ("k",), r, "mend")
    assert rows(found.select("object_name", "actual", "status")) == [("NULL", "absent", "MISSING"), ("c", "absent", "MISSING"), ("d", "same=x; pat=yyy; on=NULL; note= ", "MISMATCH")]
    assert {x.expected for x in found.where("object_name = 'd'").collect()} == {"same=x; pat~y|yy; on=true; note=given"}
    only = lambda rule, field: [x.object_name for x in drift.findings("p", want.where("k in ('a', 'b', 'd')"), have, ("k",), {field: rule}, "").collect()]
    assert (only(drift.SAME, "same"), only(drift.PATTERN, "pat"), only(drift.TRUE, "on"), only(drift.GIVEN, "note")) == ([], ["d"], ["d"], ["d"])


def test_verdict_of_a_clean_and_of_an_empty_catalogue(spark):
    have = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    for rows_ in (have, have.limit(0)):
        out = drift.report(drift.findings("p", rows_, rows_, ("k",), {"v": drift.SAME}, "mend"), drift.repeated("r", rows_, "k", "mend")).collect()
        assert [(x.category, x.actual, x.status, x["at"]) for x in out] == [("OVERALL", "complete", "PASS", 1)]
    twice = drift.report(drift.repeated("r", have.union(have.where("k = 1")).union(have.selectExpr("CAST(NULL AS INT)", "v")), "k", "mend")).orderBy("at").collect()
    assert [(x.object_name, x.actual) for x in twice] == [("k=1", "2"), ("catalogue", "1 issue(s)")]


def test_manifests(spark):
    manifests = spark.createDataFrame([(1, "low-risk"), (2, "low-risk"), (3, None), (4, "x"), (5, "clinical"), (6, "clinical"), (7, "clinical")], "manifest_id long, tier string")
    assets = spark.createDataFrame(
        [
            (1, 1, A.upper(), "OK", True), (1, 2, A, pilot.NEVER_SENT, True), (1, 3, B, "OK", False),  # the later row of A doesn't count
            (2, 1, A, pilot.NEVER_SENT, True), (3, 1, A, None, None), (4, 1, A, "OK", True), (6, 1, None, "OK", True), (7, 1, A, "OK", True), (7, 2, B, "OK", True), (7, 3, C, "OK", True),
        ],
        "manifest_id long, position int, asset_id string, risk_flag string, approved boolean",
    )
    judged = pilot.verdicts(manifests, assets, 2)
    assert rows(judged.select("manifest_id", "assets", "reason")) == rows(spark.createDataFrame([(1, 2, None), (2, 1, "NEVER_SENT_ASSET_IN_LOW_RISK"), (3, 1, "TIER_UNKNOWN"), (4, 1, "TIER_UNKNOWN"), (5, 0, "NO_ASSETS"), (6, 1, "ASSET_ID_NOT_UUID"), (7, 3, "TOO_MANY_ASSETS")], "a long, b long, c string"))
    assert {x.manifest_id: x.reason for x in pilot.verdicts(manifests, assets, 2, "clinical").collect()}[3] is None
    allowed = pilot.approved(judged, assets)
    assert rows(allowed) == [(1, A, 1)]
    assert rows(pilot.approved(judged, assets, approved_only=False)) == rows(spark.createDataFrame([(1, A, 1), (1, B, 3)], "a long, b string, c int"))
    asked = spark.createDataFrame([(1, A), (1, A.upper()), (1, B), (2, A), (1, "no"), (1, None)], "manifest_id long, asset_id string")
    assert rows(pilot.requested(allowed, asked)) == sorted([(1, A, None), (1, B, "ABSENT_OR_NOT_APPROVED"), (2, A, "ABSENT_OR_NOT_APPROVED"), (1, "no", "NOT_A_UUID"), (1, None, "NOT_A_UUID")], key=repr)
    assert pilot.verdicts(manifests.limit(0), assets.limit(0), 2).count() == 0


def test_mix_reasons_in_their_order(spark):
    good = [("jpg", "I", True), ("jpg", "I", False), ("mp4", "V", True)]
    cases = {
        1: (good, ["a", "b", "c"]), 2: (good[:2], ["a", "b"]), 3: (good, ["a", None, None]), 4: ([("jpg", "I", True), ("mp4", "V", True), ("mp4", "V", False)], "abc"), 5: ([("jpg", "I", True), ("jpg", None, True), ("mp4", "V", True)], "abc"),
        6: ([("jpg", "I", True), ("jpg", "I", True), ("mp4", "V", None)], "abc"), 7: ([("jpg", "I", True), ("gif", "I", True), (None, None, True)], "aab"),
    }
    df = spark.createDataFrame([(m, i, *x) for m, (xs, ids) in cases.items() for i, x in zip(ids, xs, strict=True)], "manifest_id int, asset_id string, extension string, destination_category string, enhanced boolean")
    got = {r.manifest_id: r.reason for r in pilot.mix_errors(df, {"jpg": 2, "mp4": 1}, {"jpg": "I", "mp4": "V"}, ("jpg", "mp4")).collect()}
    assert got == {1: None, 2: "SIZE", 3: "ASSETS_NOT_UNIQUE", 4: "FORMAT_MIX", 5: "CATEGORY_ROUTING", 6: "NO_ENHANCED_CHECK", 7: "ASSETS_NOT_UNIQUE"}


def test_mix_counts_a_format_without_a_route_as_misrouted(spark):
    df = spark.createDataFrame([(1, "a", "gif", None, True), (1, "b", None, None, True), (1, "c", "jpg", None, True), (1, "d", "jpg", "I", True)], "manifest_id int, asset_id string, extension string, destination_category string, enhanced boolean")
    assert [tuple(r) for r in pilot.mix_errors(df, {"jpg": 4}, {"jpg": "I"}, ()).select("misrouted", "reason").collect()] == [(3, "FORMAT_MIX")]


def test_import_compares_instants_and_nulls(spark):
    names = [f for f in records.IMPORT_FIELDS if f not in ("file_id", "trashed")]
    row = lambda i, **kw: tuple({"file_id": i, "trashed": False, **dict.fromkeys(names, "x"), "created_at": "2024-01-01T00:00:00Z", **kw}[c] for c in records.IMPORT_FIELDS)
    schema = ", ".join(f"{c} {'long' if c == 'file_id' else 'boolean' if c == 'trashed' else 'string'}" for c in records.IMPORT_FIELDS)
    old = spark.createDataFrame([row(1), row(2, created_at="2024-01-01T02:00:00+02:00"), row(3, skip_reason=None), row(4, modified_at=None, trashed=None)], schema)
    new = spark.createDataFrame([row(1), row(2), row(3), row(4), row(5)], schema)
    assert rows(records.import_changes(old.withColumn("extra", old.file_id), new)) == [(1, "UNCHANGED", ""), (2, "UNCHANGED", ""), (3, "UPDATE", "skip_reason"), (4, "UPDATE", "modified_at,trashed"), (5, "INSERT", "")]


def test_counts(spark):
    one, none = spark.range(3), spark.range(0)
    before = sync.table_counts({"a": one, "b": none, "c": one})
    assert rows(sync.count_changes(before, before)) == []
    assert rows(sync.count_changes(before, sync.table_counts({"a": none, "b": none, "d": one}))) == sorted([("a", 3, 0), ("c", 3, None), ("d", None, 3)], key=repr)
    counts = sync.class_counts(spark.createDataFrame([(1, "NEW"), (2, "NEW")], "file_id long, classification string"))
    assert {r.classification: r.files for r in counts.collect()} == {"NEW": 2, "CHANGED": 0, "UNCHANGED": 0, "REMOVED_FROM_SOURCE": 0, "INACCESSIBLE": 0}
