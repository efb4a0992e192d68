"""Bucketed snapshots: equal to plain upserts and comparisons, and only touched files change."""

import datetime

import pytest
from pyspark.sql import functions as F

from catalux.operators import sync
from catalux.sources import buckets

DAY = datetime.datetime(2024, 1, 1)


def table(spark, folder, number=16, digested=("id", "size")):
    return buckets.Buckets(spark, folder, "id", digested, number)


def frames(spark):
    old = spark.range(200).selectExpr("id", "id * 2 AS size", "concat('n', id) AS name", "TIMESTAMP '2024-01-01' AS first_seen", "TIMESTAMP '2024-01-01' AS last_seen")
    new = spark.createDataFrame([(3, 7, None, DAY + datetime.timedelta(9)), (500, 8, "new", DAY + datetime.timedelta(9))], "id long, size long, name string, observed_at timestamp")
    return old, new


def test_upsert_rewrites_what_it_touches(spark, tmp_path):
    old, new = frames(spark)
    t = table(spark, f"{tmp_path}/t")
    t.write(old, "one")
    before = {f.split("/t/")[1] for f in t.read().inputFiles()}
    touched = t.upsert(new, "two")
    assert 1 <= len(touched) <= 2
    after = {f.split("/t/")[1] for f in t.read().inputFiles()}
    gone = {int(f.split("bucket=")[1].split("/")[0]) for f in before - after}
    assert gone == touched and len(before & after) == len({f for f in before if int(f.split("bucket=")[1].split("/")[0]) not in touched}) > 0
    want = sync.upsert(old, new, "id")
    assert sorted(map(repr, t.read().select(want.columns).collect())) == sorted(map(repr, want.collect()))
    assert t.read("one").count() == 200, "the version before is still there"
    assert sum(r.rows for r in t.manifest().values()) == 201


def test_no_rows(spark, tmp_path):
    old, new = frames(spark)
    t = table(spark, f"{tmp_path}/t")
    t.write(old.limit(0), "one")
    assert t.read().count() == 0 and t.manifest() == {}
    t.upsert(new, "two")
    assert t.read().count() == 2
    assert t.upsert(new.limit(0), "three") == set() and t.read().count() == 2


def test_only_differing_buckets_are_read(spark, tmp_path):
    base = spark.range(300).selectExpr("id AS file_id", "'2024-01-01T00:00:00Z' AS modified_at", "id AS size_bytes", "'m' AS mime_type", "CAST(NULL AS STRING) AS checksum")
    stored = buckets.Buckets(spark, f"{tmp_path}/s", "file_id", buckets.COMPARED, 32)
    found = buckets.Buckets(spark, f"{tmp_path}/d", "file_id", buckets.COMPARED, 32)
    old = base.where("file_id <> 299").withColumn("is_missing", F.col("file_id").isin(7, 9))
    stored.write(buckets.comparable(old), "v")
    now = base.where("file_id <> 5").withColumn("size_bytes", F.when(F.col("file_id") == 6, -1).otherwise(F.col("size_bytes"))).withColumn("modified_at", F.lit("2024-01-01T01:00:00+01:00"))
    now = now.withColumn("accessible", ~F.col("file_id").isin(8, 9))
    found.write(buckets.comparable(now), "v")
    only = found.differing(stored)
    assert 1 <= len(only) <= 6
    got = buckets.changes(found, stored)
    assert {int(f.split("bucket=")[1].split("/")[0]) for f in got.inputFiles()} == only
    assert {(r.file_id, r.classification) for r in got.where("classification <> 'UNCHANGED'").collect()} == {(5, "REMOVED_FROM_SOURCE"), (6, "CHANGED"), (7, "CHANGED"), (8, "INACCESSIBLE"), (9, "INACCESSIBLE"), (299, "NEW")}
    every = {r.file_id: r.classification for r in buckets.classified(found, stored).collect()}
    assert every == {r.file_id: r.classification for r in sync.classify(now, old).collect()}
    assert found.differing(found) == set() and buckets.changes(found, found).count() == 0
    with pytest.raises(ValueError):
        found.differing(table(spark, f"{tmp_path}/x"))
