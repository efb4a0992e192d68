"""Readers, writers and streams on small files."""

import json

import pytest

from catalux.schemas import INVENTORY_ITEM
from catalux.sources import readers, writers
from catalux.streaming import incremental
from catalux.operators import inventory


def item(i, kind="supported_media"):
    return {"file_id": str(i), "name": f"n{i}", "mime_type": "image/jpeg", "file_extension": "jpg", "size": i, "created_time": None, "modified_time": None, "parent_folder_id": "r", "relative_folder_path": "", "web_view_link": "", "accessibility_status": "accessible", "classification": kind, "md5_checksum": None}


def test_inventory_report(spark, tmp_path):
    items = [item(1), item(2, "folder"), item(3, "unsupported")]
    summary = {"total_items": 3, "folders_scanned": 2, "folders": 1, "files": 2, "supported_media": 2, "unsupported_files": 1, "inaccessible_items": 0, "errors": 1}
    (tmp_path / "a.json").write_text(json.dumps({"generated_at_utc": "2024-01-01T00:00:00Z", "root": {"file_id": "r", "name": "R", "mime_type": "m"}, "summary": summary, "items": items, "errors": [{"item_id": "9", "failure_category": "HTTP", "http_status": 500, "message": "x"}]}))
    report = readers.inventory_json(spark, str(tmp_path / "a.json"), "r")
    assert report.first().root_matches
    assert [tuple(r) for r in inventory.summary_mismatches(report).collect()] == [("supported_media", 2, 1)]
    rows = readers.inventory_items(report)
    assert rows.count() == 3 and readers.inventory_errors(report).first().item_id == "9"
    rows.drop("position").coalesce(1).write.option("header", True).csv(str(tmp_path / "c"))
    again = readers.inventory_csv(spark, str(tmp_path / "c"))
    assert again.na.fill("").exceptAll(rows.drop("position").na.fill("")).count() == 0 and readers.schema_mismatches(again, INVENTORY_ITEM) == []
    assert inventory.positional_mismatches(rows, rows.replace("n3", "other", ["name"]), "position", ["name"]).first().position == 2


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, "token password=abc ok", [1])], "id int, details string, xs array<int>")
    writers.scan_report(df, str(tmp_path / "s"))
    with pytest.raises(Exception, match="exists"):
        writers.scan_report(df, str(tmp_path / "s"))
    writers.events(df, str(tmp_path / "e"))
    writers.events(df, str(tmp_path / "e"))
    assert [r.details for r in spark.read.parquet(str(tmp_path / "e")).collect()] == ["token password=[REDACTED] ok"] * 2
    writers.completed(df, df, str(tmp_path / "v"), "v1")
    assert spark.read.json(str(tmp_path / "v/_published")).first().version == "v1"
    (tmp_path / "b.bin").write_bytes(b"abc")
    assert readers.bytes_of(spark, str(tmp_path), "*.bin").first().content_hash.startswith("ba7816bf")


def test_streams(spark, tmp_path):
    schema = "asset_id long, mime_type string"
    from pyspark.sql.types import _parse_datatype_string

    kind = _parse_datatype_string(schema)
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text('{"asset_id": 1, "mime_type": "image/png"}\n{"asset_id": 2, "mime_type": "text/plain"}\n{"asset_id": 3, "mime_type": "video/mp4"}\n')
    jobs = []
    known = lambda: spark.createDataFrame([(3,)], "asset_id long")
    each = incremental.enqueue(known, lambda df, n: jobs.extend((r.asset_id, r.status) for r in df.collect()))
    for _ in range(2):  # the second time nothing is new
        incremental.process_available(incremental.arrived(spark, str(tmp_path / "in"), kind), str(tmp_path / "cp"), each).awaitTermination()
    assert sorted(jobs) == [(1, "PENDING"), (2, "SKIPPED")]
    incremental.append_available(incremental.arrived(spark, str(tmp_path / "in"), kind), str(tmp_path / "out"), str(tmp_path / "cp2")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_published_versions(spark, tmp_path):
    folder = str(tmp_path / "t")
    writers.snapshot(spark.range(3), folder)
    writers.snapshot(readers.published(spark, folder).where("id > 0"), folder)  # reads the version that it replaces
    assert sorted(r.id for r in readers.published(spark, folder).collect()) == [1, 2]
    with pytest.raises(Exception):
        writers.snapshot(spark.range(1).selectExpr("raise_error('lost')"), folder)
    assert readers.published(spark, folder).count() == 2
    both = str(tmp_path / "b")
    writers.completed(spark.range(1), spark.range(2), both, "v1")
    writers.completed(spark.range(5), spark.range(6), both, "v2")
    writers.completed(spark.range(7), spark.range(8), both, "v1")  # again: a folder of its own
    assert [readers.published(spark, both, "embeddings", v).count() for v in ("v1", "v2", None)] == [8, 6, 8]
    with pytest.raises(ValueError):
        readers.published(spark, both, "index", "v3")
    writers.report(spark.range(2), str(tmp_path / "r"))
    assert readers.published(spark, str(tmp_path / "r"), "report", kind="json").count() == 2
