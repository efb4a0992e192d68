"""Incremental runs: rows by hand, a stream in batches with replays, and a crash before the marker."""

import pytest

from catalux.operators import sync_run
from catalux.sources import readers, writers
from catalux.streaming import incremental

BAD = "application/octet-stream"


def found(spark, *rows):
    """(file_id, folder_id, size, hash, failure, retryable, accessible, mime)"""
    full = [(i, f, f"f{i}.jpg", mime, "jpg", size, "a/b", "2024-01-01T00:00:00Z", None, ok, h, failure, retryable) for i, f, size, h, failure, retryable, ok, mime in rows]
    return spark.createDataFrame(full, sync_run.DISCOVERED)


def row(i, folder=1, size=10, h="a", failure=None, retryable=None, ok=True, mime="image/jpeg"):
    return (i, folder, size, h and h * 64, failure, retryable, ok, mime)


def run(spark, state, *rows, **more):
    judged = held(spark, sync_run.judge(found(spark, *rows), state, **more))
    return sync_run.tables(judged, state, "root", "v1")


def held(spark, df):
    return spark.createDataFrame(df.collect(), df.schema)


def outcomes(out):
    return {r.file_id: (r.classification, r.outcome, r.reason) for r in out["outcomes"].collect()}


def test_rows_of_two_runs(spark):
    one = run(spark, sync_run.empty(spark), row(1), row(2), row(3, h="b"), row(4, mime=BAD), row(5, h=None, failure="timeout", retryable=True), row(6, h=None, failure="gone", retryable=False), row(7, ok=False), row(8, folder=2, h="c"))
    assert outcomes(one) == {
        1: ("NEW", "PLANNED", None), 2: ("NEW", "LINKED_DUPLICATE", None), 3: ("NEW", "PLANNED", None), 4: ("NEW", "SKIPPED", "UNSUPPORTED_MIME_TYPE"), 5: ("NEW", "AWAITING_RETRY", "timeout"),
        6: ("NEW", "FAILED", "gone"), 7: ("INACCESSIBLE", "INACCESSIBLE", None), 8: ("NEW", "PLANNED", None),
    }
    state = {t: held(spark, one[t]) for t in ("files", "assets", "links", "destinations")}
    assert {r.file_id for r in state["files"].collect()} == {1, 2, 3, 4, 5, 6, 8} and state["destinations"].count() == 3
    # folder 2 isn't in the second batch and stays; 1 has changed to what 3 holds, 3 is gone, 5 succeeds at last, 6 fails again, 2 is unchanged
    two = run(spark, state, row(1, size=11, h="b"), row(2), row(4, mime=BAD), row(5, h="d"), row(6, h=None, failure="gone", retryable=True), row(7))
    assert outcomes(two) == {
        1: ("CHANGED", "LINKED_DUPLICATE", None), 2: ("UNCHANGED", "UNCHANGED", None), 3: ("REMOVED_FROM_SOURCE", "REMOVED_FROM_SOURCE", None), 4: ("UNCHANGED", "UNCHANGED", None),
        5: ("UNCHANGED", "PLANNED", None), 6: ("UNCHANGED", "AWAITING_RETRY", "gone"), 7: ("NEW", "LINKED_DUPLICATE", None),
    }
    assert sorted((r.content_hash[0], r.file_id, r.relationship_type) for r in two["links"].collect()) == [("a", 2, "DUPLICATE"), ("a", 7, "DUPLICATE"), ("b", 1, "DUPLICATE"), ("b", 3, "ORIGINAL"), ("c", 8, "ORIGINAL"), ("d", 5, "ORIGINAL")]
    files = {r.file_id: r for r in two["files"].collect()}
    assert files[3].is_missing and files[6].attempts == 2 and files[5].sync_status == "COMPLETED" and files[8].sync_classification == "NEW"
    assert sorted((r.file_id, r.event_type, r.event_status) for r in two["events"].collect()) == [(1, "SOURCE_CHANGED", "INFO"), (1, "UPLOAD_VERIFIED", "SUCCESS"), (5, "LIFECYCLE_INITIALIZED", "SUCCESS"), (6, "UPLOAD_FAILED", "WARNING"), (7, "UPLOAD_VERIFIED", "SUCCESS")]
    assert two["totals"].first().asDict() == {
        "sources_checked": 1, "files_discovered": 6, "new_files_detected": 1, "changed_files_detected": 1, "unchanged_files_ignored": 4, "files_skipped": 0, "files_hashed": 3, "exact_duplicates_found": 2,
        "unique_assets_created": 1, "relationships_created_or_reused": 3, "existing_assets_reused": 2, "failed_files": 0, "retried_files": 1, "unresolved_exceptions": 1, "removed_from_source": 1, "inaccessible": 0,
    }


def test_attempts_end(spark):
    state, seen = sync_run.empty(spark), []
    for _ in range(6):
        out = run(spark, state, row(1, h=None, failure="busy", retryable=True))
        seen.append(outcomes(out)[1][1])
        state = {t: held(spark, out[t]) for t in ("files", "assets", "links", "destinations")}
    assert seen == ["AWAITING_RETRY"] * 4 + ["FAILED"] * 2


def test_stream_equals_batches_and_replays_change_nothing(spark, tmp_path):
    folder, source = f"{tmp_path}/tables", f"{tmp_path}/in"
    batches = [[row(1), row(2, h="b"), row(3, folder=2)], [row(1, size=12, h="b"), row(4, folder=1, h="e")]]
    state = sync_run.empty(spark)
    each = incremental.synchronize(folder, "root")
    for n, rows in enumerate(batches):
        found(spark, *rows).coalesce(1).write.mode("append").json(source)
        stream = incremental.arrived(spark, source, found(spark).schema)
        incremental.process_available(stream, f"{tmp_path}/checkpoint", each).awaitTermination()
        out = run(spark, state, *rows)
        state = {t: held(spark, out[t]) for t in ("files", "assets", "links", "destinations")}
        for t in ("files", "assets", "links", "destinations", "outcomes", "events"):
            have = readers.published(spark, folder, t)
            want = state.get(t, out[t])
            assert sorted(map(repr, have.select(want.columns).collect())) == sorted(map(repr, want.collect())), (n, t)
    before = readers.versions(spark, folder)
    assert before == {"batch-0", "batch-1"}
    rows = sorted(map(repr, readers.published(spark, folder, "files").collect()))
    each(found(spark, *batches[0]), 0)  # a replay
    each(found(spark, row(9)), 1)
    assert readers.versions(spark, folder) == before and sorted(map(repr, readers.published(spark, folder, "files").collect())) == rows
    report = readers.published(spark, folder, "report").first()
    assert (report.batch, report.recorded, report.status, report.changed_files_detected) == (1, 3, "RECONCILED", 1)


def test_a_crash_before_the_marker_leaves_the_version_before(spark, tmp_path, monkeypatch):
    folder = f"{tmp_path}/tables"
    each = incremental.synchronize(folder, "root")
    each(found(spark, row(1)), 0)
    publish = writers.publish

    def broken(tables, *where):
        publish({"files": tables["files"]}, f"{tmp_path}/elsewhere", "x")
        raise RuntimeError("lost")

    monkeypatch.setattr(writers, "publish", broken)
    with pytest.raises(RuntimeError):
        each(found(spark, row(2)), 1)
    monkeypatch.setattr(writers, "publish", publish)
    assert [r.file_id for r in readers.published(spark, folder, "files").collect()] == [1]
    each(found(spark, row(1), row(2)), 1)
    assert sorted(r.file_id for r in readers.published(spark, folder, "files").collect()) == [1, 2]


def test_another_writer_is_noticed(spark, tmp_path, monkeypatch):
    folder = f"{tmp_path}/tables"
    each = incremental.synchronize(folder, "root")
    judge = sync_run.judge

    def slow(*a, **k):
        monkeypatch.setattr(sync_run, "judge", judge)
        incremental.synchronize(folder, "root")(found(spark, row(5)), 7)
        return judge(*a, **k)

    monkeypatch.setattr(sync_run, "judge", slow)
    with pytest.raises(incremental.Overlap):
        each(found(spark, row(1)), 0)
    assert readers.versions(spark, folder) == {"batch-7"}


def test_empty_batch(spark):
    out = run(spark, sync_run.empty(spark))
    assert outcomes(out) == {} and out["totals"].first().files_discovered == 0
