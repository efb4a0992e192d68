"""Long sequences in several tasks, and numbered manifests."""

import csv
import random

import pytest

from catalux.operators import lifecycle, longruns
from catalux.sources import readers


def test_equals_the_window(spark):
    r = random.Random(1)
    rows = [(run, k, *(r.choice([True, True, False, None]) for _ in range(3))) for run in (1, 2, None) for k in range(r.choice([1, 90, 400]))] + [(3, k, True, True, True) for k in range(300)]
    df = spark.createDataFrame(rows, "run long, k long, mismatch boolean, exhausted boolean, severe boolean").repartition(3)
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = longruns.stop_conditions(df, "run", "k")
        clean = df.fillna(False)
        want = lifecycle.stop_conditions(clean, "run", "k")
        columns = ["run", "k", "attempted", "severe_so_far", "mismatches", "exhaustions", "stop_reason"]
        have = got.select(columns).collect()
        assert sorted(map(repr, have)) == sorted(map(repr, want.select(columns).collect()))
        streak = longruns.running(df, "run", "k", (), ("mismatch",)).where("run = 3").agg({"mismatch_streak": "max"}).first()[0]
        assert streak == 300, "a streak goes on over partitions"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])


def test_a_long_run_lies_in_several_tasks(spark):
    df = spark.range(5000).selectExpr("0 AS run", "id AS k", "true AS severe")
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        parts = df.repartitionByRange("run", "k").selectExpr("spark_partition_id() AS p").distinct().count()
        assert parts > 1
        assert longruns.running(df, "run", "k", ("severe",)).where("severe_so_far <> k + 1 or n_so_far <> k + 1").count() == 0
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert longruns.running(df.limit(0), "run", "k", ("severe",), ("severe",)).count() == 0


LINK = "https://drive.google.com/drive/folders/"
HEADER = ["source_name", "account_name", "folder_url", "notes", "active"]


def put(path, rows, header=HEADER, mark=""):
    with open(path, "w", newline="", encoding="utf-8") as f:
        f.write(mark)
        w = csv.writer(f)
        w.writerow(header)
        w.writerows(rows)


def test_rows_of_a_split_file_are_numbered(spark, tmp_path):
    rows = [(f"s{i}", "a", f"{LINK}F{i % 900}", "x" * (i % 50), "yes") for i in range(1000)]
    put(f"{tmp_path}/m.csv", rows)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        numbered = readers.numbered_csv(spark, f"{tmp_path}/m.csv")
        got = readers.manifest(spark, f"{tmp_path}/m.csv").collect()
        assert spark.read.csv(f"{tmp_path}/m.csv").rdd.getNumPartitions() > 3
        assert sorted((r.row_number, r.source_name) for r in numbered.collect()) == [(i + 2, x[0]) for i, x in enumerate(rows)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    assert sorted(r.row_number for r in got if r.reason == "DUPLICATE_FOLDER_ID") == [i + 2 for i in range(900, 1000)]
    assert all(r.reason is None for r in got if r.row_number < 902)


def test_rejected_rows_keep_their_numbers(spark, tmp_path):
    put(f"{tmp_path}/m.csv", [("", "a", f"{LINK}F1", "", ""), ("s", "a", f"{LINK}F1", "", ""), ("s", "a", "x", "", ""), ("s", "a", f"{LINK}F1", "", "perhaps"), ("t", "a", f"{LINK}F1", "", "no"), ("t", "a", f"{LINK}F2", "", "no")], mark="﻿")
    got = sorted((r.row_number, r.reason, r.is_active) for r in readers.manifest(spark, f"{tmp_path}/m.csv").collect())
    assert [x[:2] for x in got] == [(2, "MISSING_SOURCE_NAME"), (3, None), (4, "INVALID_FOLDER_URL"), (5, "INVALID_ACTIVE"), (6, "DUPLICATE_FOLDER_ID"), (7, None)]
    assert got[1][2] is True and got[5][2] is False
    put(f"{tmp_path}/u.csv", [], [*HEADER, "colour"])
    put(f"{tmp_path}/v.csv", [], HEADER[1:])
    for name, said in (("u", "unknown columns: colour"), ("v", "missing columns: source_name")):
        with pytest.raises(ValueError, match=said):
            readers.manifest(spark, f"{tmp_path}/{name}.csv")
